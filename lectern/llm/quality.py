"""Quality rules: base counts of a text, and the Jensen-Shannon distance of its histograms from language references.

A first pass over all labelled documents counts, for each language, the classes of characters and the words (hashed
to BUCKETS buckets, so that a task's counts have a fixed size); a language's `top` fullest buckets are its common
words. A second pass compares each document's two histograms with each language's, by the square root of the
Jensen-Shannon divergence to base 2, and takes the nearest language (of equally near ones the first). A document fails
where it has at least `min_words` words (for classes) or `min_words_common` (for common words) and lies beyond the
distance allowed. What is allowed can be learned from documents known to be good: `margin` times the largest distance
among them. The references have some 130 kilobytes a language, and every language found has them.

Defined results: a null text has no words and fails the base rules; a null language counts for no reference; with no
reference at all every document that passes the base rules is kept; an empty table gives an empty result; a text is
read as a whole, so the longest one bounds memory; other columns are not read and may have any names; each row is judged by itself, so repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import settle, small_batches
from lectern.llm.textblocks import IS_WORD, LOWER, VALUE, blocks, forget, gram_hash, mix, runs, span_hash

BUCKETS = 1 << 14
#: Symbols that are counted. Fixed values.
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
#: Classes of bytes: other control, white space, lower, upper, digit, sentence marks, other ASCII marks, symbols, lead bytes of others, continuation bytes (not counted).
CLASSES = 9
BYTE_CLASS = np.full(256, 6, np.int64)
BYTE_CLASS[:32] = BYTE_CLASS[127] = 0
BYTE_CLASS[~IS_WORD] = 1
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58] = 2, 3, 4
BYTE_CLASS[list(b".,;:!?'\"-()")] = 5
BYTE_CLASS[IS_SYMBOL] = 7
BYTE_CLASS[128:192], BYTE_CLASS[192:] = CLASSES, 8
#: For common words: case and ASCII marks do not count.
WORD_VALUE = VALUE[LOWER]
WORD_VALUE[[b for b in range(128) if BYTE_CLASS[b] not in (2, 3, 4)]] = 0


def _per_row(where: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(where, minlength=n)[:n]


def _histograms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class counts by row, starts and ends of words, row of each word, bucket of each word."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    classes = np.bincount(row * (CLASSES + 1) + BYTE_CLASS[data], minlength=n * (CLASSES + 1)).reshape(n, -1)[:, :CLASSES]
    starts, ends = runs(IS_WORD[data], at)
    bucket = (span_hash(data, starts, ends, WORD_VALUE, lengths=False) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return classes, starts, ends, row[starts], bucket


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, data, at in blocks(batch.column(1)):
            classes, _, _, row, bucket = _histograms(data, at)
            of = np.array(langs[lo:hi], object)
            for lang in set(langs[lo:hi]):
                mine = of == lang
                c, w = totals.setdefault(lang, (np.zeros(CLASSES, np.int64), np.zeros(BUCKETS, np.int64)))
                c += classes[mine].sum(0)
                w += np.bincount(bucket[mine[row]], minlength=BUCKETS)
    for lang, (c, w) in totals.items():
        counts = np.concatenate([c, w])
        some = np.flatnonzero(counts)
        yield pa.record_batch({"lang": pa.array([lang] * len(some), pa.string()), "cell": some.astype(np.int64), "n": counts[some]})


class References:
    """Histograms of the languages: `classes` (languages x classes), `words` (languages x top + 1, the last for all other words) and `common` (bucket to place, by language)."""

    def __init__(self, rows: list, top: int):
        self.langs = sorted({r["lang"] for r in rows})
        self.classes = np.zeros((len(self.langs), CLASSES))
        self.words = np.zeros((len(self.langs), top + 1))
        self.common = np.full((len(self.langs), BUCKETS), top, np.int64)
        used = [0] * len(self.langs)
        place = {lang: k for k, lang in enumerate(self.langs)}
        totals = {r["lang"]: r["words"] for r in rows}
        for r in sorted(rows, key=lambda r: (r["lang"], -r["n"], r["cell"])):
            k = place[r["lang"]]
            if r["cell"] < CLASSES:
                self.classes[k, r["cell"]] = r["n"]
            else:
                self.common[k, r["cell"] - CLASSES] = used[k]
                self.words[k, used[k]] = r["n"]
                used[k] += 1
        for k, lang in enumerate(self.langs):
            self.words[k, top] = totals[lang] - self.words[k, :top].sum()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 200) -> References:
    """References from every document that has a language."""
    rows = small_batches(docs).where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    is_word = F.col("cell") >= CLASSES
    by = W.partitionBy("lang")
    ranked = settle(counts).withColumn("words", F.coalesce(F.sum(F.when(is_word, F.col("n"))).over(by), F.lit(0))).withColumn("nth", F.row_number().over(W.partitionBy("lang", is_word).orderBy(F.desc("n"), "cell")))
    kept = ranked.where(~is_word | (F.col("nth") <= top))
    return References(kept.collect(), top)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts from a histogram; 1 for a row without counts."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0)


def _repeats(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that lie in a window of three words found twice or more in the row."""
    if len(h) < 3:
        return np.zeros(n, np.int64)
    same = row[:-2] == row[2:]
    place = np.flatnonzero(same)
    key = mix(gram_hash(h, 3)[same] + row[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    twin = np.zeros(len(k), bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= twin[1:]
    hit = place[order[twin]]
    words = np.zeros(len(h), bool)
    for step in range(3):
        words[hit + step] = True
    return _per_row(row[words], n)


def _dup_lines(data: np.ndarray, at: np.ndarray, word_starts: np.ndarray, n: int) -> np.ndarray:
    """Lines of each row that have a word and equal an earlier line of the row."""
    starts, ends = runs(data != 10, at)
    if not len(starts):
        return np.zeros(n, np.int64)
    some = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[some], ends[some]
    row = np.searchsorted(at, starts, "right") - 1
    h = mix(span_hash(data, starts, ends) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(h, return_index=True)
    again = np.ones(len(h), bool)
    again[first] = False
    return _per_row(row[again], n)


def _measured(refs: References, base_words: int, repeat_percent: int):
    schema = pa.schema([("doc_id", pa.int64())] + [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(1)):
                n = hi - lo
                classes, starts, ends, row, bucket = _histograms(data, at)
                n_words = _per_row(row, n)
                first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                chars = first[at[1:]] - first[at[:-1]] - classes[:, 1]
                dups = _dup_lines(data, at, starts, n)
                again = _repeats(row, span_hash(data, starts, ends), n)
                failed = (n_words < base_words) | (100 * again > repeat_percent * n_words)
                by_class = np.array([js_distance(classes, c) for c in refs.classes]) if refs.langs else np.zeros((1, n))
                by_word = np.ones((max(len(refs.langs), 1), n)) * (not refs.langs)
                top = refs.words.shape[1]
                for k in range(len(refs.langs)):
                    counts = np.bincount(row * top + refs.common[k][bucket], minlength=n * top).reshape(n, top)
                    by_word[k] = js_distance(counts, refs.words[k])
                nearest = (by_class + by_word).argmin(0)
                class_d, word_d = by_class[nearest, np.arange(n)], by_word[nearest, np.arange(n)]
                if not refs.langs:
                    word_d = class_d
                symbols = _per_row(np.searchsorted(at, np.flatnonzero(IS_SYMBOL[data]), "right") - 1, n)
                yield pa.record_batch([batch.column(0).slice(lo, n).cast(pa.int64()), *map(pa.array, (n_words, chars, symbols, dups, again, failed, class_d, word_d))], schema=schema)

    return measure


@dataclass(frozen=True)
class Limits:
    """From how many words on the two distances count, and how large they may be."""

    min_words: int = 50
    min_words_common: int = 50
    class_distance: float = 0.29
    word_distance: float = 0.6


def measure(docs: DataFrame, refs: References, id_col: str = "doc_id", text_col: str = "text", base_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return rows.mapInArrow(_measured(refs, base_words, repeat_percent), f"doc_id long, {counts}, base_failed boolean, class_distance double, word_distance double")


def learn_limits(good: DataFrame, margin: float = 1.05, limits: Limits = Limits()) -> Limits:
    """`limits` with distances from `good`, measured documents that are known to be good; its own where there is none."""
    passed = good.where("NOT base_failed")
    one = passed.agg(
        F.max(F.when(F.col("n_words") >= limits.min_words, F.col("class_distance"))).alias("c"),
        F.max(F.when(F.col("n_words") >= limits.min_words_common, F.col("word_distance"))).alias("w"),
    ).first()
    return replace(limits, class_distance=limits.class_distance if one["c"] is None else margin * one["c"], word_distance=limits.word_distance if one["w"] is None else margin * one["w"])


def verdicts(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """measured with kept."""
    far_class = (F.col("n_words") >= limits.min_words) & (F.col("class_distance") > limits.class_distance)
    far_words = (F.col("n_words") >= limits.min_words_common) & (F.col("word_distance") > limits.word_distance)
    return measured.withColumn("kept", ~F.col("base_failed") & ~far_class & ~far_words)


def score(docs: DataFrame, refs: References, limits: Limits = Limits(), **options) -> DataFrame:
    """`measure` with the verdicts."""
    return verdicts(measure(docs, refs, **options), limits)
