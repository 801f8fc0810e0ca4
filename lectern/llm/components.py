"""Connected components of an edge table, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import settle


#: Keys that a vertex with many neighbours is dealt over.
SALTS = 32
#: Edges that a partition may have, and the least number of partitions.
PART_ROWS, LEAST_PARTS = 200_000, 12


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex u joins its larger neighbours to the smallest of all its neighbours and itself. A centre may have any number of them."""
    rows = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    # at most SALTS rows a vertex
    least = rows.groupBy("a", "salt").agg(F.min("b").alias("m")).withColumn("m", F.least("a", F.min("m").over(W.partitionBy("a"))))
    return rows.where("b > a").join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex u joins itself and its smaller neighbours to the smallest of them. After a large star these are few."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return out.where("a <> b").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that has an edge to another: the smallest id of its component.

    Edges with a null end or to themselves are ignored; repeated edges count once; no edges give an empty table.
    """
    now = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    before, state = None, _print(now)
    while state != before and state[0]:
        # a few rows in many partitions would make many files in each of the shuffles to come
        now = now.coalesce(max(LEAST_PARTS, -(-state[0] // PART_ROWS)))
        now = settle(_small_star(_large_star(now)))
        before, state = state, _print(now)
    # every edge leads to the smallest id now
    found = now.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("component"))
    return found.union(found.select("component", "component").distinct()).distinct()
