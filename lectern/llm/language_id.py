"""Language identification by nearest centroid.

A text becomes a vector of byte 3-grams of its letters (lower case, everything else one blank), hashed to DIMENSIONS
places, with weights (1 + ln tf) * idf, of length 1. Each language has several centroids, found by spherical k-means
over a bounded sample of its labelled texts; a text gets the language of the centroid with the largest cosine. A text
is rejected where it has no letter, or where it has MIN_GRAMS grams and that cosine is below a bound learned from the
training texts' own (short texts have small cosines by nature, and are not rejected for them).

The model is fitted on at most `per_language` rows of each language (whole texts, those with the smallest hashes of id and
text; of equal ones one counts), of every language found, whatever the ids are: the share of hashes that is taken comes from
a sketch of how many different ones a language has, so neither an id that all rows share nor a text that fills a language
lets its sample run empty or over; a language's centroids are found in one task, and the driver gets the model alone: document
frequencies, centroids and a histogram of the training texts' own cosines, some 70 kilobytes a language however long
the texts are. Prediction reads nothing but the text.

Defined results: null text, or text without a letter: `und`, score 0, rejected; no labelled row at all: `und` for
all; of centroids as near as one another the first in order of languages counts; rows with equal texts get equal
results; a text is read as a whole, so the longest one bounds memory; empty tables give empty results; other columns
are not read but for those that `keep` names, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle, small_batches
from lectern.llm.textblocks import LOWER, blocks, forget

DIMENSIONS = 1 << 12
UNKNOWN = "und"
#: Most languages whose sampling bounds are broadcast; those of more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
MIN_GRAMS = 100
#: Rows that pass the sampling bounds, for each that is wanted: the sketch errs by some 5 %.
MARGIN = 1.25
#: Steps of cosines in the histogram from which rejection is learned.
COSINES = 1000
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
FOLD = np.where(IS_LETTER, LOWER, 32).astype(np.uint8)


def gram_counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, count) of the hashed 3-grams of each text."""
    n = len(at) - 1
    if len(data) < 3:
        return (np.zeros(0, np.int64),) * 3
    low = FOLD[data]
    # capitals of the Latin-1 letters: C3 80-9E without 97
    second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[second] |= 0x20
    gram = low[:-2].astype(np.uint32) | low[1:-1].astype(np.uint32) << 8 | low[2:].astype(np.uint32) << 16
    row = np.repeat(np.arange(n), np.diff(at))
    inside = (row[:-2] == row[2:]) & (gram != 0x202020) & ((gram & 0xFFFF) != 0x2020)
    place = ((gram[inside] * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    cell = np.bincount(row[:-2][inside] * DIMENSIONS + place, minlength=0)
    some = np.flatnonzero(cell)
    return some // DIMENSIONS, some % DIMENSIONS, cell[some]


def dense(row: np.ndarray, place: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """Vectors of length 1 (or 0, without a known gram)."""
    x = np.zeros((n, DIMENSIONS), np.float32)
    x[row, place] = (1 + np.log(count)) * idf[place]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    langs: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: float


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start; deterministic."""
    centre = x.mean(0)
    chosen = [centre / max(np.linalg.norm(centre), 1e-12)]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[(x @ np.array(chosen).T).max(1).argmin()])
    c = np.array(chosen)
    for _ in range(rounds):
        best = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (mine := best == j).any():
                mean = x[mine].mean(0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for lo, hi, data, at in blocks(batch.column(2), rows=256):
            row, place, count = gram_counts(data, at)
            cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v.astype(np.int32))) for v in (place, count)]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *lists], names=["lang", "nth", "place", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1500, clusters: int = 4, reject: float = 0.5) -> Model:
    """A model from the rows of docs with text and language; rejection starts at `reject` times the training texts' 1st percentile of cosines."""
    # null ids and ids that rows share tell nothing apart: the text counts too
    nth = F.xxhash64(F.lit("sample"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    rows = small_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), nth.alias("nth"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("nth", 0.05).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0, int), np.zeros((0, DIMENSIONS), np.float32), np.zeros(DIMENSIONS, np.float32), 0.0)
    # about per_language of each, and rather more, of which `_sampled` takes the first
    bounds = [(lang, min(2**63 - 1, int(2**64 * min(1.0, MARGIN * per_language / max(1, n))) - 2**63)) for lang, n in sizes.items()]
    bound = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
    # a row a language: whole texts are not to be shuffled for it
    some = rows.join(F.broadcast(bound) if len(bounds) <= BROADCAST_LANGUAGES else bound, "lang").where("nth <= bound").select("lang", "nth", "text")
    sample = some.mapInArrow(_vectors, "lang string, nth long, place array<int>, n array<int>").dropDuplicates(["lang", "nth"])
    sample = settle(sample)
    df, texts = np.zeros(DIMENSIONS, np.int64), 0
    for r in sample.groupBy("lang").applyInArrow(_frequencies(per_language), "texts long, df binary").toLocalIterator():
        df += np.frombuffer(r["df"], "<i8")
        texts += r["texts"]
    idf = (np.log((1 + texts) / (1 + df)) + 1).astype(np.float32)
    found = sample.groupBy("lang").applyInArrow(_fit(per_language, clusters, idf), "lang string, centroids binary, cosines binary").collect()
    parts = sorted((r["lang"], np.frombuffer(r["centroids"], "<f4").reshape(-1, DIMENSIONS), np.frombuffer(r["cosines"], "<i8")) for r in found)
    langs = sorted(sizes)
    if not sum(len(c) for _, c, _ in parts):
        return Model([], np.zeros(0, int), np.zeros((0, DIMENSIONS), np.float32), idf, 0.0)
    of = np.concatenate([np.full(len(c), langs.index(lang)) for lang, c, _ in parts])
    upto = np.cumsum(np.sum([h for _, _, h in parts], axis=0))
    low = float(np.searchsorted(upto, 0.01 * upto[-1], "right")) / COSINES if upto[-1] else 0.0
    return Model(langs, of, np.concatenate([c for _, c, _ in parts]), idf, reject * low)


def _sampled(table: pa.Table, per_language: int) -> list[tuple[list[int], list[int]]]:
    rows = sorted(zip(table.column("nth").to_pylist(), table.column("place").to_pylist(), table.column("n").to_pylist(), strict=True))
    return [r[1:] for r in rows[:per_language]]


def _frequencies(per_language: int):
    def run(table: pa.Table) -> pa.Table:
        rows = _sampled(table, per_language)
        df = np.bincount(np.concatenate([np.zeros(0, np.int64), *(p for p, _ in rows)]).astype(np.int64), minlength=DIMENSIONS)
        return pa.table({"texts": pa.array([len(rows)], pa.int64()), "df": pa.array([df.astype("<i8").tobytes()], pa.binary())})

    return run


def _fit(per_language: int, clusters: int, idf: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        rows = [r for r in _sampled(table, per_language) if r[0]]
        c, own = np.zeros((0, DIMENSIONS), np.float32), np.zeros(0)
        if rows:
            x = dense(np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows]), np.concatenate([p for p, _ in rows]), np.concatenate([n for _, n in rows]), len(rows), idf)
            c = _kmeans(x, clusters)
            own = (x @ c.T).max(1)[np.array([sum(n) >= MIN_GRAMS for _, n in rows])]
        cosines = np.bincount(np.clip(own * COSINES, 0, COSINES - 1).astype(np.int64), minlength=COSINES)
        return pa.table({"lang": pa.array([lang]), "centroids": pa.array([c.astype("<f4").tobytes()], pa.binary()), "cosines": pa.array([cosines.astype("<i8").tobytes()], pa.binary())})

    return run


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            width = batch.num_columns - 2
            for lo, hi, data, at in blocks(batch.column(width), rows=256):
                n = hi - lo
                lettered = np.array(batch.column(width + 1).slice(lo, n).to_pylist(), bool)
                lang, cosine = np.full(n, UNKNOWN, object), np.zeros(n)
                row, place, count = gram_counts(data, at)
                long = np.bincount(row, count, n) >= MIN_GRAMS
                if model.langs:
                    sims = dense(row, place, count, n, model.idf) @ model.centroids.T
                    best = sims.argmax(1)
                    cosine = np.where(lettered, np.clip(sims[np.arange(n), best], 0, 1), 0.0).astype(float)
                    lang[lettered] = np.array(model.langs, object)[model.of[best[lettered]]]
                rejected = ~lettered | long & (cosine < model.reject_below) | (not model.langs)
                own = [batch.column(i).slice(lo, n) for i in range(width)]
                yield pa.record_batch([*own, pa.array(lang, pa.string()), pa.array(cosine), pa.array(rejected)], names=[*batch.schema.names[:width], "lang_pred", "score", "rejected"])

    return predict


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, keep: dict[str, Column] | None = None, text_col: str = "text") -> DataFrame:
    """One row per row of docs: the columns `keep` (names and expressions), lang_pred, score, rejected."""
    keep = keep or {"doc_id": F.col("doc_id")}
    rows = small_batches(docs).select(*[c.alias(k) for k, c in keep.items()], F.coalesce(F.col(text_col), F.lit("")).alias("__text"), has_letter(text_col).alias("__lettered"))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(_predictor(model), schema)
