"""Mixing sources to target weights by Pareto order sampling.

Sources share `total` words by weight, none beyond `cap` times its own words: targets are min(cap * size, c * weight)
with the one c that gives the total, which is what sharing an excess again and again comes to. Within a source each
document expects e = min(cap, c * w) copies, w its weight: a column's, or a function of its size (1 if neither is
given), rounded to a power of LEVEL. Its floor(e) whole copies are
certain; the fraction left, p, is an inclusion probability, and the fractions' words are filled in order of
Q = (u / (1 - u)) / (p / (1 - p)), u a hash of seed and id: Pareto order sampling. Words are filled to the nearest
document, so a source ends within half a document of its target.

The order is never a sort of a whole source: words are summed per source and bucket of Q / (1 + Q), the bucket in
which the words run out is found from those sums, and only that bucket's documents are ranked. The result is one
threshold per source, so documents are selected where they are read. Sources too may be many: their ranks and sums are
taken by ranges (common.running), not in one task.

Defined results: a null text has size 0; a null source is a source of its own, the last; documents of size 0 take 0
words (and no copy); rows that share an id share u, ties fall by id, size and a hash of the text; an empty table gives
an empty result. Columns other than those named are not read, and `mix` passes them through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import WORD, running, settle

#: Largest table of thresholds (one row a source and weight level) that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
BUCKETS = 4096
#: Weights are rounded to powers of this number.
LEVEL = 1.1


def n_words(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) from seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def fill_level(parts: DataFrame, weight: str, cap: str, total: float, order: list[Column]) -> float:
    """The c with which the shares min(cap, c * weight) of all parts add up to total; infinity if the caps don't."""
    ratio = F.try_divide(F.col(cap), F.col(weight))
    x = running(parts.select("*", ratio.alias("ratio")), [F.col("ratio"), *order], full=cap, wide=weight)
    everything = parts.agg(F.sum(weight)).first()[0] or 0
    x = x.withColumn("c", F.try_divide((F.lit(total) - F.col("full")).cast("double"), (F.lit(everything) - F.col("wide")).cast("double")))
    # in order of cap / weight the first parts are full; c is that of the first part which isn't
    return x.where((F.col(weight) > 0) & (F.col("c") * F.col(weight) <= F.col(cap))).agg(F.min(F.struct("ratio", "c"))["c"]).first()[0] or float("inf")


def water_fill(parts: DataFrame, group: list[str], weight: str, cap: str, total: str) -> DataFrame:
    """parts with `share` = min(cap, c * weight), c such that the shares of a group add up to its total (or to all caps). A group has a row a level."""
    by = W.partitionBy(*group)
    order = by.orderBy(F.try_divide(F.col(cap), F.col(weight)), *[c for c in parts.columns if c not in (cap, weight, total)])
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    x = parts.withColumn("full", F.coalesce(F.sum(cap).over(upto), F.lit(0))).withColumn("open", F.sum(weight).over(by) - F.coalesce(F.sum(weight).over(upto), F.lit(0)))
    x = x.withColumn("c", F.try_divide(F.col(total) - F.col("full"), F.col("open")))
    x = x.withColumn("c", F.coalesce(F.min(F.when((F.col(weight) > 0) & (F.col("c") * F.col(weight) <= F.col(cap)), F.struct(F.try_divide(F.col(cap), F.col(weight)), F.col("c").alias("c")))).over(by)["c"], F.lit(float("inf"))))
    return x.withColumn("share", F.least(F.col(cap).cast("double"), F.col("c") * F.col(weight))).drop("full", "open", "c")


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, target) of sources (source, source_size), which may be many."""
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running(sources.withColumn("one", F.lit(1)), by_name, nth="one")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = settle(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("limit")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    c = fill_level(ranked, "weight", "limit", total, by_name)
    return ranked.select("source", "source_size", F.least(F.col("limit").cast("double"), F.lit(c) * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: int, weight_of_size: Callable[[Column], Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, level, u, tie) of docs, and the columns `keep`."""
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = docs.select(*keep, F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), w.alias("w"), uniform(id_col, seed).alias("u"), F.xxhash64(text_col).alias("tie"))
    w = F.greatest(F.coalesce(weight_of_size(F.col("size")).cast("double") if weight_of_size else F.col("w"), F.lit(1.0)), F.lit(1e-6))
    level = F.round(F.log(w) / F.log(F.lit(LEVEL))).cast("int") if weight_col or weight_of_size else F.lit(0)
    return rows.select(*keep, "id", "source", "size", level.alias("level"), "u", "tie")


def _join(left: DataFrame, right: DataFrame, small: bool, level: bool = True) -> DataFrame:
    on = F.col("source").eqNullSafe(F.col("r_source")) & ((F.col("level") == F.col("r_level")) if level else F.lit(True))
    right = right.withColumnsRenamed({"source": "r_source", "level": "r_level"})
    return left.join(F.broadcast(right) if small else right, on).drop("r_source", "r_level")


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> tuple[DataFrame, bool]:
    """A row per source and level of `sized`: source_size, target, whole, p, and the threshold (q_to, id_to, ...) up to which documents get a further copy."""
    parts = sized.groupBy("source", "level").agg(F.sum("size").alias("part_size"))
    sources = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    sources = source_targets(settle(sources), weights, cap)
    parts = _join(parts, sources, False, level=False)
    parts = parts.withColumn("w", F.pow(F.lit(LEVEL), F.col("level")) * F.col("part_size")).withColumn("limit", F.col("part_size") * cap)
    parts = water_fill(parts, ["source"], "w", "limit", "target")
    # the share of an only level is the target itself
    e = F.try_divide(F.when(F.count(F.lit(1)).over(W.partitionBy("source")) == 1, F.col("target")).otherwise(F.col("share")), F.col("part_size"))
    parts = parts.withColumn("e", F.coalesce(e, F.lit(0.0))).withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("part_size")).over(W.partitionBy("source"))
    parts = settle(parts.select("source", "level", "source_size", "target", "whole", "p", rest.alias("rest")))
    small = parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ranked = _ranked(_join(sized.where("size > 0"), parts, small)).where("p > 0")
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the one bucket in which the words run out
    sums = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    last = _join(ranked.drop("rest"), sums.withColumnRenamed("bucket", "r_bucket").drop("words"), small, level=False).where("bucket = r_bucket")
    run = W.partitionBy("source").orderBy("q", "id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))).where(F.col("upto") + F.col("size") / 2.0 <= F.col("rest"))
    edge = last.groupBy("source").agg(F.max(F.struct("q", "id", "size", "tie")).alias("edge"))
    ends = _left(parts, sums.select("source", F.col("bucket").alias("end_bucket")))
    return settle(_left(ends, edge)), small


def _left(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.withColumnRenamed("source", "r_source"), F.col("source").eqNullSafe(F.col("r_source")), "left").drop("r_source")


def _ranked(rows: DataFrame) -> DataFrame:
    # none is to be picked where p is 0: the order is null there
    q = F.try_divide(F.col("u") / (1 - F.col("u")), F.col("p") / (1 - F.col("p")))
    return rows.withColumn("q", q).withColumn("bucket", F.least(F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def _copies() -> Column:
    here = F.struct("q", "id", "size", "tie") <= F.col("edge")
    more = F.when(F.col("p") > 0, F.when(F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")), True).when(F.col("bucket") == F.col("end_bucket"), F.coalesce(here, F.lit(False))).otherwise(False)).otherwise(False)
    return F.when(F.col("size") > 0, F.col("whole") + more.cast("int")).otherwise(0)


def mix_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, weight_col: str | None = None, weight_of_size: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words), copies."""
    sized = settle(_sized(docs, id_col, text_col, source_col, weight_col, seed, weight_of_size))
    plan, small = plan_mix(sized, weights, cap)
    out = _ranked(_join(sized, plan, small)).withColumn("copies", _copies().cast("long"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, weight_col: str | None = None, weight_of_size: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, with the columns of docs."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[docs[c].alias(f"__mix_{k}") for k, c in (("id", id_col), ("text", text_col), ("source", source_col))], *([docs[weight_col].alias("__mix_weight")] if weight_col else []))
    args = ("__mix_id", "__mix_text", "__mix_source", "__mix_weight" if weight_col else None, seed, weight_of_size)
    plan, small = plan_mix(settle(_sized(own, *args)), weights, cap)
    sized = _sized(own, *args, keep=("row",))
    out = _ranked(_join(sized, plan, small)).withColumn("copies", _copies().cast("int")).where("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__nth"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def bits(size: Column) -> Column:
    """A document's weight by its size: one more for twice the words."""
    return F.length(F.bin(size))
