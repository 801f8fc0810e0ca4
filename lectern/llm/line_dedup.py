"""Line de-duplication: lines whose normalised form is found in many documents go, but for one document.

Lines are exploded and hashed to 128 bits once and kept (hashes, id and position only), distinct documents counted per
hash (a map-side combine first, so a line that every document holds sends one row per task and document group), and the
positions to drop go back to their documents, where the lines left are joined again. Keys with more than one in HOT of
all common lines, of which there can only be fewer than HOT, are broadcast: their lines are found where they are read,
and what is left to the join by key has no key of more than that share. Texts move once, in the join that reassembles
them.

Defined results: a null text is one empty line; an empty table gives an empty result; the table's other columns are
not read and may have any names. Of documents with the same largest id all keep their line; a text is split as a whole,
so the longest one bounds memory. A row with a null id is a document of its own for counting, the smallest of all. Rows that share an id are
one document for counting, and each keeps its own row in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WHITE, settle

#: A key with more than one in so many of all common lines is joined by broadcast; there are fewer such keys than this.
HOT = 1000
#: Letters that are lower-cased in keys. Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text.

    Keys of at least min_chars code points found in at least min_docs documents lose all lines except those in the
    document with the largest id.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    # outer: an inner explode makes the optimiser repeat the array's expressions in a filter below it
    lines = rows.select("id", F.posexplode_outer(F.split("body", "\n", -1)).alias("pos", "line")).select("id", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.length("key") >= min_chars).select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    lines = settle(lines)
    holders = lines.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n"))
    common = holders.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.max("id").alias("last"))
    common = settle(common.where(F.col("docs") >= min_docs).select("h1", "h2", "n", "last"))
    total = common.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > total
    hot, cold = common.where(is_hot).drop("n"), common.where(~is_hot).drop("n")
    found = lines.join(F.broadcast(hot), ["h1", "h2"])
    rest = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"])
    drops = found.unionByName(rest).where(~F.col("id").eqNullSafe(F.col("last")))
    drops = drops.groupBy("id").agg(F.collect_set("pos").alias("drop"))
    split = F.split("body", "\n", -1)
    out = rows.join(drops.withColumnRenamed("id", "drop_id"), F.col("id").eqNullSafe(F.col("drop_id")), "left")
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    left = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone))
    kept = F.when(F.size(gone) == 0, F.col("body")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("parts"), i)), "\n"))
    out = out.select("id", "body", "drop", split.alias("parts"))
    return out.select(F.col("id").alias("doc_id"), F.size("parts").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept_text"))
