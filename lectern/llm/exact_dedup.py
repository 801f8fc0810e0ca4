"""Exact duplicates: rows grouped by a 128-bit content hash, bytes compared inside the groups.

The grouping key is (hash, text): the hash decides where a row goes and the text, compared byte by byte by the
aggregation, keeps different texts with one hash apart. Copies are pre-aggregated in the task that reads them, so
of a group that holds a third of all rows each map task sends one row.

Defined results: a null text counts as empty and is a copy of other empty texts; rows that repeat id and text are
one document, flagged alike by `exact_groups`, of which `drop_copies` keeps one row; a null id loses to any other.
Equal ids are ties, decided by a hash of the row. A text is grouped as a whole, so the longest one bounds memory.
An empty table gives an empty result; columns other than id and text are not read by `exact_groups` and are passed
through unchanged by `drop_copies`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(body: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(body))


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).alias("body"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (`keep`: the smallest or largest id of the group), group_size, kept, text_sha256."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    keyed = _keyed(docs, id_col, text_col, normalise).withColumn("h", content_hash(F.col("body")))
    groups = keyed.groupBy("h", "body").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("h", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    # (md5, sha256) names a text here: two texts that share the first are told apart by the second
    rows = keyed.select("id", "h", F.unhex(F.sha2("body", 256)).alias("sha"))
    return rows.join(groups, ["h", "sha"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with one whole row of each group of equal texts, the one with the smallest or largest id; columns as in docs."""
    pick = {"smallest": F.min_by, "largest": F.max_by}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = normalise(text) if normalise else text
    # the text itself travels once, in the key; a null text is told from an empty one by a flag
    rest = [c for c in docs.columns if normalise or c != text_col]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.col(text_col).isNull().alias("was_null"))
    order = F.struct(F.col(id_col).alias("o"), F.xxhash64(*[docs[c] for c in docs.columns if dict(docs.dtypes)[c].find("map<") < 0]).alias("tie"))
    first = docs.select(content_hash(body).alias("h"), body.alias("body"), row.alias("row"), order.alias("o")).groupBy("h", "body").agg(pick("row", "o").alias("row"))
    at = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)}
    own = F.when(~F.col("row.was_null"), F.col("body"))
    return first.select(*[at.get(c, own).alias(c) for c in docs.columns])
