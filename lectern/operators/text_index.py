"""Literal search by an index of three-byte grams with coarse positions.

`build` cuts each text into pages of PAGE bytes and lists, for each gram, the pages where it starts. A page belongs to one
text; pages are numbered within a batch of texts, and a row holds a gram's pages of one batch, so a gram that every text has is
many rows and no large one. Rows are written by BUCKETS of grams and sorted within, so a search reads the buckets of its grams
and, inside them, the row groups that may have them.

`search` takes each term's rarest grams (FEW of them, by their numbers of pages), keeps the pages where all of these can
belong to one occurrence, and then looks the term up in the texts of those pages. No occurrence is lost: an occurrence that
starts in page s has its gram at offset o in page s + o div PAGE or the one after. Terms shorter than a gram are looked up
in all texts.

Texts are told apart by a whole number `id`. A null text or term is not searched, nor is an empty term; rows that share an
id are one hit. Bytes of UTF-8 are compared, which is the same as letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.dedup import settle
from lectern.sources.catalog import dim

PAGE, BUCKETS, FEW = 1024, 64, 4
#: Bytes of text whose grams are listed together.
BATCH_BYTES = 4 << 20
#: Bytes of text of which a bucket's rows are dealt to four files, and of which a task sorts the rows.
SLICE_BYTES, SORT_BYTES = 1 << 30, 2 << 20
#: Batches whose pages a task compares with the terms.
BATCHES_AT_ONCE = 4
#: The row of a batch that names its texts has this instead of a gram.
NAMES = -1
ROW = "gram int, batch long, pages array<int>, ids array<long>"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts, and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # a task that runs again reads the same rows in the same order, and names its batches alike
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        data, at = _bytes(whole.column(1))
        lo = 0
        while lo < whole.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BATCH_BYTES, "right")) - 1)
            yield from _batch(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], whole.column(0).slice(lo, hi - lo), number)
            number, lo = number + 1, hi


def _batch(data: np.ndarray, at: np.ndarray, ids: pa.Array, number: int) -> Iterator[pa.RecordBatch]:
    size = np.diff(at)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // PAGE)))])
    row = np.repeat(np.arange(len(size)), size)
    page = first[row] + (np.arange(len(data)) - at[row]) // PAGE
    wide = data.astype(np.int64)
    inside = row[:-2] == row[2:] if len(data) > 2 else np.zeros(0, bool)
    gram = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])[inside] if len(data) > 2 else wide[:0]
    pair = np.unique(gram << 32 | page[: len(inside)][inside])
    gram, page = pair >> 32, (pair & (2**32 - 1)).astype(np.int32)
    cut = np.flatnonzero(np.diff(gram, prepend=-1))
    yield _rows(np.array([NAMES]), number, first[:-1].astype(np.int32), np.array([0, len(size)]), ids)
    yield _rows(gram[cut], number, page, np.append(cut, len(page)), None)


def _rows(gram: np.ndarray, number: int, pages: np.ndarray, ends: np.ndarray, ids: pa.Array | None) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pages))
    named = pa.array([None] * len(gram), pa.list_(pa.int64())) if ids is None else pa.array([ids.to_pylist()], pa.list_(pa.int64()))
    return pa.record_batch([pa.array(gram.astype(np.int32)), pa.array(np.full(len(gram), number)), lists, named], names=["gram", "batch", "pages", "ids"])


def build(rows: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes an index of the texts below path."""
    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    listed = texts.mapInArrow(_listed, ROW).withColumn("bucket", F.pmod(F.hash("gram"), F.lit(BUCKETS)))
    # a partition is sorted in memory: their number grows with the texts
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, parts = 4 * max(1, -(-size // SLICE_BYTES)), max(1, -(-size // SORT_BYTES))
    listed = listed.repartition(min(parts, BUCKETS * slices), "bucket", F.pmod("batch", F.lit(slices))).sortWithinPartitions("bucket", "gram", "batch")
    listed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/grams")
    # a row a gram, of at most 2^24
    kept = _grams(rows.sparkSession, path).where(F.col("gram") >= 0)
    kept.groupBy("gram").agg(F.sum(F.size("pages")).alias("n")).write.mode("overwrite").parquet(f"{path}/often")


def _grams(spark: SparkSession, path: str) -> DataFrame:
    # an index of no texts has no files to read a schema from
    return spark.read.schema(f"{ROW}, bucket int").parquet(f"{path}/grams")


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term, at, gram = [], [], []
        for t in batch.column(0).to_pylist():
            b = t.encode()
            seen = {b[i : i + 3]: i for i in range(len(b) - 3, -1, -1)}
            for g, i in seen.items():
                term.append(t), at.append(i), gram.append(int.from_bytes(g, "big"))
        yield pa.record_batch([pa.array(term, pa.string()), pa.array(at, pa.int32()), pa.array(gram, pa.int32())], names=["term", "at", "gram"])


def rarest(spark: SparkSession, path: str, terms: DataFrame, few: int = FEW) -> DataFrame:
    """(term, at, gram, needed): of each term that may occur at all its rarest grams, where they stand in it, and how many there are."""
    own = terms.select("term").distinct().mapInArrow(_grams_of, "term string, at int, gram int")
    counted = own.join(spark.read.parquet(f"{path}/often"), "gram", "left")
    by = W.partitionBy("term")
    ranked = counted.withColumn("rank", F.row_number().over(by.orderBy(F.coalesce("n", F.lit(0)), "at"))).where(F.col("rank") <= few)
    return ranked.withColumns({"needed": F.count(F.lit(1)).over(by), "found": F.count("n").over(by)}).where("found = needed").select("term", "at", "gram", "needed")


def candidates(spark: SparkSession, path: str, terms: DataFrame, few: int = FEW) -> DataFrame:
    """(term, id): texts with a page where the term's rarest grams can stand together."""
    picked = settle(rarest(spark, path, terms, few))
    # at most BUCKETS numbers
    buckets = [r[0] for r in picked.select(F.pmod(F.hash("gram"), F.lit(BUCKETS)).alias("b")).distinct().collect()]
    grams = _grams(spark, path)
    # the first page of each text of a batch
    names = grams.where((F.col("bucket") == F.pmod(F.hash(F.lit(NAMES)), F.lit(BUCKETS))) & (F.col("gram") == NAMES))
    parts = max(1, -(-names.count() // BATCHES_AT_ONCE))
    # a gram's pages are sent once, to their batch, and meet the terms there: what a task holds does not grow with the texts
    lists = grams.where(F.col("bucket").isin(buckets)).select("gram", "batch", "pages").join(dim(picked.select("gram").distinct()), "gram", "left_semi").repartition(parts, "batch")
    back = F.floor(F.col("at") / PAGE).cast("int")
    starts = F.when(F.col("at") % PAGE == 0, F.transform("pages", lambda p: p - back)).otherwise(F.array_union(F.transform("pages", lambda p: p - back), F.transform("pages", lambda p: p - back - 1)))
    each = lists.join(dim(picked), "gram").select("term", "needed", "batch", starts.alias("starts"))
    # lists of one batch are short; exploded, the places of all grams would be counted one by one
    both = each.groupBy("term", "batch").agg(F.collect_list("starts").alias("all"), F.first("needed").alias("needed")).where(F.size("all") == F.col("needed"))
    left = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), lambda s, x: F.array_intersect(s, x))
    # read twice below: the places that are left are few
    pages = settle(both.select("term", "batch", F.explode_outer(left).alias("page")).where("page >= 0"))
    of = names.select("batch", F.explode_outer(F.arrays_zip("ids", "pages")).alias("s")).select("batch", F.col("s.ids").alias("id"), F.col("s.pages").alias("page"))
    met = pages.select("batch", "page").distinct()
    # a text's pages follow one another: the last first page up to one is its text's
    both = of.unionByName(met.withColumn("id", F.lit(None).cast("long")))
    latest = F.last("id", ignorenulls=True).over(W.partitionBy("batch").orderBy("page", F.col("id").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow))
    named = both.withColumn("of", latest).where("id IS NULL").select("batch", "page", F.col("of").alias("id"))
    return pages.join(named, ["batch", "page"]).select("term", "id").distinct()


def search(spark: SparkSession, path: str, rows: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """(term, id): all texts of rows, which the index at path is of, that hold a term (column term), letter for letter."""
    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    terms = terms.select("term").where("term <> ''").distinct()
    found = candidates(spark, path, terms.where(F.octet_length("term") >= 3), few)
    hits = texts.join(found, "id").where(F.contains("text", F.col("term"))).select("term", "id")
    short = terms.where(F.octet_length("term") < 3)
    if not short.isEmpty():
        # two bytes at most: fewer than 2^16 terms of them
        every = F.filter(F.lit([r["term"] for r in short.collect()]), lambda t: F.contains("text", t))
        every = texts.select("id", F.explode_outer(every).alias("term"))
        hits = hits.unionByName(every.where("term IS NOT NULL").select("term", "id"))
    return hits.distinct()
