"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text is a weighted set of its shingles of `words` words (letters and digits, case ignored; a text with fewer words
has one shingle of all): weight (1 + ln tf) * idf, with idf = floor + (1 - floor) * ln(n / df) / ln(n), which is 1 for
a shingle of one document and `floor` for one that all n have. Document frequencies are counted over all documents in
a sketch of fixed size (DF_ROWS hashed rows of DF_CELLS cells): of a shingle's cells the smallest counts, less what
other shingles put into a cell on average and three standard deviations of that. So they are exact while shingles
are few for the sketch, and in a large corpus the df of rare shingles is taken as 1.

Each of bands * rows samples picks the shingle with the smallest a = c / (y e^r), y = e^(r (t - b)),
t = floor(ln(weight) / r + b), with r, c from Gamma(2, 1) and b uniform, all from the shingle's hash; two texts pick
the same (shingle, t) with the probability of their weighted Jaccard similarity. For sampling alone, ln(weight) is
rounded to STEP, so that a sample is one look-up. Samples are hashed in bands.

Texts with the same words are one vertex. Members of band buckets are sorted by ranges of (bucket, next band's hash, id),
so that a hot bucket takes several tasks, and each is linked to the WIDTH members before it. Links are verified by the
weighted Jaccard similarity of the whole texts, and components are built. Members of buckets that still hold several
components are compared across components by an exact weighted prefix filter: no candidate is dropped, and members of
one component are not compared again.

Defined results: a text without a letter or digit (null, empty) is a class of its own; rows that share an id are one
vertex; a row with a null id gets the class of its words; of equal ids and hashes the smallest leads; an empty table
gives an empty result; a text is read as a whole, so the longest one bounds memory; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import settle, small_batches
from lectern.llm.components import components
from lectern.llm.textblocks import LOWER, VALUE, blocks, forget, gram_hash, mix, powers, runs, span_hash

#: The sketch of document frequencies. Its cells are sent in parts, so that several tasks add them up.
DF_ROWS, DF_CELLS, DF_PARTS = 2, 1 << 19, 64
TABLE_BITS = 16
TABLE = 1 << TABLE_BITS
#: Groups that a bucket's members are dealt over where buckets are joined.
SALTS = 64
#: Neighbours before it in a bucket's order that a member is linked to.
WIDTH = 3
#: Samples round ln(weight) to STEP; weights outside of these levels count as the nearest.
STEP, LEVELS, LEVEL_ZERO = 0.1, 34, 8
IS_TOKEN = np.zeros(256, bool)
IS_TOKEN[48:58] = IS_TOKEN[65:91] = IS_TOKEN[97:123] = IS_TOKEN[128:] = True
FOLDED = VALUE[LOWER]

_rng = np.random.default_rng(20240301)
GAMMA_R, GAMMA_C = (_rng.gamma(2, 1, TABLE).astype(np.float32) for _ in range(2))
LOG_C, BETA = np.log(GAMMA_C), _rng.random(TABLE).astype(np.float32)
FACTORS = _rng.integers(1, 2**62, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _ordered(x: np.ndarray) -> np.ndarray:
    """float32 as uint64 in the same order, in the upper half."""
    bits = x.astype(np.float32).view(np.uint32)
    return (bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))).astype(np.uint64) << np.uint64(32)


@lru_cache(1)
def level_keys() -> np.ndarray:
    """By level of weight and place: ln a in the upper half, a name of t in the lower one."""
    out = np.empty((LEVELS, TABLE), np.uint64)
    for level in range(LEVELS):
        t = np.floor(np.float32((level - LEVEL_ZERO) * STEP) / GAMMA_R + BETA)
        out[level] = _ordered(LOG_C - GAMMA_R * (t - BETA) - GAMMA_R) | (mix(t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF))
    return out.reshape(-1)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of a block."""
    starts, ends = runs(IS_TOKEN[data], at)
    return np.searchsorted(at, starts, "right") - 1, span_hash(data, starts, ends, FOLDED)


def shingles(row: np.ndarray, h: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times) of the distinct shingles of each row, in order."""
    gram = gram_hash(h, k)
    inside = row[: len(gram)] == row[k - 1 : k - 1 + len(gram)]
    rows, grams = [row[: len(gram)][inside]], [gram[inside]]
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    for few in range(1, k):
        short = np.flatnonzero(count == few)
        if len(short):
            rows.append(short)
            grams.append(mix(gram_hash(h, few)[first[short]] + np.uint64(few)))
    row, gram = np.concatenate(rows), np.concatenate(grams)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    if not len(row):
        return row, gram, row
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])]))
    return row[new], gram[new], np.diff(np.append(new, len(row)))


@dataclass
class Idf:
    """Document frequencies of n documents, by row of the sketch and cell, and how idf comes from them."""

    n: int
    df: np.ndarray  # DF_ROWS x DF_CELLS, noise taken off
    floor: float

    def of(self, gram: np.ndarray) -> np.ndarray:
        return idf_of(np.minimum.reduce([self.df[r][cells(gram, r)] for r in range(DF_ROWS)]), self.n, self.floor)


def idf_of(df: np.ndarray, n: int, floor: float) -> np.ndarray:
    return floor + (1 - floor) * np.log(max(n, 2) / np.clip(df, 1, max(n, 2))) / np.log(max(n, 2))


def cells(gram: np.ndarray, row: int) -> np.ndarray:
    return ((gram * FACTORS[-1 - row]) >> np.uint64(64 - DF_CELLS.bit_length() + 1)).astype(np.int64)


def weights(gram: np.ndarray, times: np.ndarray, idf: Idf) -> np.ndarray:
    return (1 + np.log(times)) * idf.of(gram)


def samples(row: np.ndarray, gram: np.ndarray, weight: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a shingle, and their samples (rows x number)."""
    if not len(row):
        return row, np.zeros((0, number), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    out = np.empty((number, len(first)), np.uint64)
    low = gram & np.uint64(0xFFFFFFFF)
    level = np.clip(np.rint(np.log(weight) / STEP).astype(np.int64) + LEVEL_ZERO, 0, LEVELS - 1).astype(np.uint64) << np.uint64(TABLE_BITS)
    table = level_keys()
    for j in range(number):
        key = table[level | (gram * FACTORS[j]) >> np.uint64(64 - TABLE_BITS)] ^ low
        out[j] = np.minimum.reduceat(key, first)
    return row[first], out.T


def _df(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        count, docs = np.zeros((DF_ROWS, DF_CELLS), np.int64), 0
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(0)):
                _, gram, _ = shingles(*words_of(data, at), hi - lo, k)
                for r in range(DF_ROWS):
                    count[r] += np.bincount(cells(gram, r), minlength=DF_CELLS)
                docs += hi - lo
        if docs:
            narrow = np.int32 if count.max() < 2**31 else np.int64
            parts = [x.astype(narrow).astype(np.int64) for x in count.reshape(DF_PARTS, -1)]
            yield pa.record_batch({"part": pa.array([*range(DF_PARTS), -1], pa.int64()), "n": pa.array([pack(x) for x in parts] + [pack(np.array([docs]))], pa.binary())})

    return run


def pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<i8").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


def _add(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, part = None, None
    for batch in batches:
        for p, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
            part, total = p, unpack(n) if total is None else total + unpack(n)
    yield pa.record_batch({"part": pa.array([part], pa.int64()), "n": pa.array([pack(total)], pa.binary())})


def inverse_frequencies(texts: DataFrame, k: int, floor: float) -> Idf:
    """idf from all documents; the driver gets a sketch of fixed size."""
    parts = texts.select("text").mapInArrow(_df(k), "part long, n binary").groupBy("part").applyInArrow(_add, "part long, n binary").collect()
    found = {r["part"]: unpack(bytes(r["n"])) for r in parts}
    if not found:
        return Idf(0, np.ones((DF_ROWS, DF_CELLS), np.float32), floor)
    count = np.concatenate([found[i] for i in range(DF_PARTS)]).reshape(DF_ROWS, DF_CELLS)
    noise = count.sum(1, keepdims=True) / DF_CELLS
    return Idf(int(found[-1][0]), np.maximum(count - np.floor(noise + 3 * np.sqrt(noise)), 1).astype(np.float32), floor)


def _signed(k: int, bands: int, rows: int, idf: Idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(1)):
                n = hi - lo
                row, h = words_of(data, at)
                count = np.bincount(row, minlength=n)
                first = np.cumsum(count) - count
                place = powers(int(count.max()) + 1 if n else 1)[np.arange(len(row)) - first[row]]
                whole = np.zeros((2, n), np.uint64)
                some = np.flatnonzero(count)
                if len(some):
                    for i, x in enumerate((h, mix(h ^ np.uint64(0x5851F42D4C957F2D)))):
                        whole[i, some] = mix(np.add.reduceat(x * place, first[some]) + count[some].astype(np.uint64))
                srow, gram, times = shingles(row, h, n, k)
                has, s = samples(srow, gram, weights(gram, times, idf), bands * rows)
                band = gram_hash_rows(s.reshape(len(has), bands, rows)) if len(has) else np.zeros((0, bands), np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.isin(np.arange(n), has) * bands)]).astype(np.int32)), pa.array(band.reshape(-1).view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(lo, n).cast(pa.int64()), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), lists], names=["id", "w1", "w2", "bands"])

    return run


def gram_hash_rows(x: np.ndarray) -> np.ndarray:
    """One hash of each band's samples."""
    h = np.zeros(x.shape[:2], np.uint64)
    for i in range(x.shape[2]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i] + np.uint64(i + 1))
    return h


def weighted_jaccard(row: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int, one: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Similarity of each of n weighted sets (row, gram, weight) and the set `one` (gram in order, weight)."""
    gram1, weight1 = one
    total = np.bincount(row, weight, n) + weight1.sum()
    if not len(gram1):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(gram1, gram), len(gram1) - 1)
    both = np.where(gram1[at] == gram, np.minimum(weight1[at], weight), 0)
    shared = np.bincount(row, both, n)
    return shared / np.maximum(total - shared, 1e-12)


def _verified(k: int, threshold: float, idf: Idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, lead = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(a):  # rows come in order of a
                end = at + 1
                while end < len(a) and a[end] == a[at]:
                    end += 1
                if (a[at], head := batch.column(2)[at].as_py()) != known:
                    known = (a[at], head)
                    _, _, data, start = next(blocks(pa.array([head])))
                    _, gram, times = shingles(*words_of(data, start), 1, k)
                    lead = (gram, weights(gram, times, idf))
                for lo, hi, data, start in blocks(batch.column(3).slice(at, end - at)):
                    row, gram, times = shingles(*words_of(data, start), hi - lo, k)
                    near = np.flatnonzero(weighted_jaccard(row, gram, weights(gram, times, idf), hi - lo, lead) >= threshold)
                    if len(near):
                        yield pa.record_batch({"a": pa.array([a[at]] * len(near), pa.int64()), "b": pa.array([b[at + lo + i] for i in near.tolist()], pa.int64())})
                at = end

    return run


def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: float, idf: Idf) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar. texts: (id, text).

    Both joins are plain ones, so that one with a hot side is split as it runs.
    """
    dealt = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    heads = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    both = dealt.join(heads, "a").select("a", "b", "a_text", "b_text").sortWithinPartitions("a")
    return both.mapInArrow(_verified(k, threshold, idf), "a long, b long")


def _weighed(k: int, idf: Idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(2), rows=512):
                row, gram, times = shingles(*words_of(data, at), hi - lo, k)
                weight = weights(gram, times, idf).astype(float)
                total = np.bincount(row, weight, hi - lo)
                v, c = (batch.column(i).slice(lo, hi - lo).to_numpy()[row] for i in (0, 1))
                yield pa.record_batch({"v": v, "c": c, "gram": gram.view(np.int64), "weight": weight, "total": total[row]})

    return run


def prefix_pairs(docs: DataFrame, k: int, threshold: float, idf: Idf) -> DataFrame:
    """All pairs (a, b), a < b, of docs (v, c, text) with different c that can reach the threshold.

    Weighted prefix filter: shingles in one order, rarest first, a pair as similar as that has its rarest shared
    shingle among the first of either text, those before which at most 1 - threshold of its weight has passed.
    """
    each = settle(docs.select("v", "c", "text").mapInArrow(_weighed(k, idf), "v long, c long, gram long, weight double, total double").distinct())
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    before = F.coalesce(F.sum("weight").over(W.partitionBy("v").orderBy(F.coalesce("df", F.lit(1)), "gram").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    index = each.join(shared, "gram", "left").withColumn("before", before).where((F.col("before") <= (1 - threshold) * F.col("total") + 1e-9) & F.col("df").isNotNull()).select("v", "c", "gram", "total", (F.col("total") - F.col("before")).alias("ahead"))
    x, y = index.alias("x"), index.alias("y")
    # a pair's rarest shared shingle leaves at least the shared weight ahead in both
    near = F.least("x.ahead", "y.ahead") + 1e-9 >= threshold / (1 + threshold) * (F.col("x.total") + F.col("y.total"))
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.v") < F.col("y.v")) & (F.col("x.c") != F.col("y.c")) & near)
    return pairs.select(F.col("x.v").alias("a"), F.col("y.v").alias("b")).distinct()


def _swept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(k).to_numpy() for k in ("key", "v", "c")] for b in batches if b.num_rows]
        if not parts:
            return
        key, v, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        same = key[1:] == key[:-1]
        # what a range's first and last row share with rows of other ranges is not known here
        shared = np.concatenate([[True], same]) | np.concatenate([same, [True]])
        yield pa.record_batch({"pair": pa.array(np.zeros(int(shared.sum()), bool)), "x": key[shared], "y": v[shared]})
        for d in range(1, width + 1):
            both = np.flatnonzero((key[d:] == key[:-d]) & (v[d:] != v[:-d]) & (c[d:] != c[:-d]))
            if len(both):
                x, y = v[both], v[both + d]
                yield pa.record_batch({"pair": pa.array(np.ones(len(both), bool)), "x": np.minimum(x, y), "y": np.maximum(x, y)})

    return run


def sweep(buckets: DataFrame, order: Column, width: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b), a < b, of members of buckets (key, v, c) and of the `width` ones before them, where c differs; members (key, v) of buckets with several)."""
    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = buckets.select("key", order.alias("o"), "v", "c").repartitionByRange(n, "key", "o", "v").sortWithinPartitions("key", "o", "v")
    found = settle(rows.select("key", "v", "c").mapInArrow(_swept(width), "pair boolean, x long, y long"))
    return found.where("pair").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), found.where("NOT pair").select(F.col("x").alias("key"), F.col("y").alias("v"))


def _open(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members of those buckets (key, v) that are in several components, with c, the component."""
    at = buckets.join(found, F.col("v") == F.col("id"), "left").select("key", "v", F.coalesce("component", "v").alias("c"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"))
    # at most SALTS rows a bucket
    local, all_ = at.groupBy("key", "salt").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), W.partitionBy("key")
    open_ = local.select("key", "salt", F.min("lo").over(all_).alias("lo"), F.max("hi").over(all_).alias("hi")).where("lo <> hi").select("key", "salt")
    return at.join(open_, ["key", "salt"]).select("key", "v", "c")


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    known = tested.select(F.col("a").alias("x"), F.col("b").alias("y"))
    return pairs.join(known, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 16, rows: int = 4, floor: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id of its class)."""
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    idf = inverse_frequencies(texts, words, floor)
    signed = settle(texts.mapInArrow(_signed(words, bands, rows, idf), "id long, w1 long, w2 long, bands array<long>"))
    # texts with the same words are one vertex; so are rows with the same id
    vertices = settle(signed.where(F.size("bands") > 0).groupBy("w1", "w2").agg(F.min("id").alias("v"), F.any_value("bands").alias("bands")).where("v IS NOT NULL"))
    after = F.get("bands", F.pmod(F.col("band") + 1, F.size("bands")))
    buckets = vertices.select("v", "bands", F.posexplode_outer("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("key"), "v", F.col("v").alias("c"), after.alias("after"))
    tested, buckets = sweep(buckets, F.col("after"), WIDTH)
    texts = settle(texts.join(buckets.select(F.col("v").alias("id")).distinct(), "id"))
    links = settle(verify(tested, texts, words, threshold, idf))
    found = settle(components(links))
    left = settle(_open(buckets, found))
    if left.limit(1).count():
        ends = left.select("v", "c").distinct()
        more = prefix_pairs(texts.join(ends, F.col("id") == F.col("v")), words, threshold, idf)
        more = verify(settle(_untested(more, tested)), texts, words, threshold, idf)
        found = settle(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)))
    names = vertices.join(found, F.col("v") == F.col("id"), "left").select("w1", "w2", F.coalesce("component", "v").alias("class_id"))
    return signed.join(names, ["w1", "w2"], "left").select(F.col("id").alias("doc_id"), F.when(F.size("bands") > 0, F.least("class_id", "id")).otherwise(F.col("id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class, that with the smallest id; columns as in docs. Rows that share an id stay or go together."""
    gone = near_duplicate_classes(docs, id_col, text_col, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
