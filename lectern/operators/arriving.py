"""Duplicates of sections that arrive batch by batch: a batch is joined to an index of what came before, and components grow.

Kept below a path, a folder a batch: `forms` (a row a different normal form, with its shingles), `prefixes` (the shingles it is
found by), `members` (which form a section has), `labels` (the component that a form was put into) and `merges` (components
that a batch found to be one). Old labels are never rewritten: a label stands for what the merges, followed to their end,
make of it, so a batch writes what it changes and no more.

The prefix filter of `dedup` needs one order of shingles for all texts. It is that of their frequencies in the first batch, of
those that OFTEN texts of it have; all others come before them. It is kept; later batches do not change it, so an index never
has to be made anew. Of the prefixes only those that a new text shares with another go on to be compared. Two texts are compared as there: first
with the first of a shingle, then only across components. Pairs of two old texts are not compared again.

`clusters` gives the same components as `dedup.clusters` over all sections so far. A batch has a name; one that is there already
is left alone, and what a failed one has left is written over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.dedup import components, keyed, normalized, settle, shingles_of, similar
from lectern.sources.catalog import dim

#: Texts of the first batch that a shingle must stand in to be put late in the order. Any number gives the same pairs.
OFTEN = 8
#: Rows of these up to which they are broadcast; more are joined as Spark sees fit.
LISTED = 1_000_000
PARTS = ("forms", "prefixes", "members", "labels", "merges")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def _names(spark: SparkSession, path: str) -> list[str]:
    """Batches that are there whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if n.startswith("batch=") and _exists(spark, f"{path}/{n}/done/_SUCCESS"))


def _all(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    names = _names(spark, path)
    return spark.read.parquet(*[f"{path}/{n}/{part}" for n in names]) if names else None


def _same(a: str, b: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]


def _resolved(labels: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, label): labels after all merges."""
    ends = components(merges.select(F.col("old").alias("a"), F.col("new").alias("b"))).toDF("m_id", "m_end")
    return labels.join(ends, F.col("label") == F.col("m_id"), "left").select("id", F.coalesce("m_end", "label").alias("label"))


def _keys(forms: DataFrame, by: list[str]) -> DataFrame:
    """(id, sh): a row a shingle of each form, as `dedup.keyed` names it."""
    each = forms.select(*by, "id", F.explode_outer("s").alias("sh")).where("sh IS NOT NULL")
    return each.select("id", keyed(by, F.col("sh")).alias("sh"))


def _prefixes(forms: DataFrame, often: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(sh, id): the shingles of each form that it is found by, rarest of the first batch first. Only those that the first batch had often are joined on."""
    listed = _keys(forms, by).join(dim(often, LISTED), "sh").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "sh"))).alias("r"))
    own = F.transform("s", lambda x: keyed(by, x))
    late = F.coalesce(F.transform("r", lambda x: x["sh"]), F.array().cast("array<bigint>"))
    first = F.slice(F.concat(F.array_sort(F.array_except(own, late)), late), F.lit(1), F.size("s") - F.ceil(F.size("s") * threshold).cast("int") + 1)
    return forms.join(listed.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select(F.explode_outer(first).alias("sh"), "id").where("sh IS NOT NULL")


def _shared(new: DataFrame, old: DataFrame | None, forms: DataFrame, by: list[str]) -> DataFrame:
    """(by..., sh, id, size, n, fresh) of the prefixes that a new text and any other share; no other row can make a pair."""
    every = new.withColumn("fresh", F.lit(True))
    if old is not None:
        every = every.union(old.select("sh", "id", F.lit(False)))
    key = W.partitionBy("sh")
    live = every.withColumns({"texts": F.count(F.lit(1)).over(key), "any": F.max("fresh").over(key)}).where("texts > 1 AND any")
    live = live.select("sh", F.col("id").alias("of"), "fresh")
    return live.join(forms.select(*by, "id", "size", F.size("s").alias("n")), F.col("of") == F.col("id")).select(*by, "sh", "id", "size", "n", "fresh")


def _pairs(new: DataFrame, every: DataFrame, by: list[str], threshold: float, tolerance: float, *also: Column) -> DataFrame:
    """(a, b), a < b: a new text and any one that share a shingle and whose sizes allow the similarity."""
    ratio = lambda c: F.least(f"x.{c}", f"y.{c}") / F.greatest(f"x.{c}", f"y.{c}")
    on = [*_same("x", "y", by), F.col("x.sh") == F.col("y.sh"), F.col("x.id") != F.col("y.id"), ratio("size") >= 1 - tolerance, ratio("n") >= threshold]
    met = new.alias("x").join(every.alias("y"), [*on, *also])
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def add(sections: DataFrame, path: str, name: str, by: list[str], k: int = 10, threshold: float = 0.6, tolerance: float = 0.3) -> None:
    """Takes the batch `name` of sections (by..., seq, text) into the index at path; seqs are unique over all batches."""
    spark, here = sections.sparkSession, f"{path}/batch={name}"
    if _exists(spark, f"{here}/done/_SUCCESS"):
        return
    write = lambda df, part: df.write.mode("overwrite").parquet(f"{here}/{part}")
    old = {p: _all(spark, path, p) for p in PARTS}
    rows = settle(normalized(sections).select(*by, "seq", "norm", "norm_hash"))
    forms = rows.groupBy(*by, "norm_hash").agg(F.min("seq").alias("id"), F.first("norm").alias("norm"))
    if old["forms"] is not None:
        forms = forms.alias("f").join(old["forms"].alias("o"), _same("f", "o", [*by, "norm_hash"]), "left_anti")
    size = F.length("norm")
    forms = forms.select(*by, "norm_hash", "id", size.alias("size"), F.when(size >= 3 * k, shingles_of(F.col("norm"), k)).otherwise(F.array().cast("array<bigint>")).alias("s"))
    write(forms, "forms")
    forms = spark.read.parquet(f"{here}/forms")
    shingled = forms.where(F.size("s") > 0)
    if not _exists(spark, f"{path}/often/_SUCCESS"):
        _keys(shingled, by).groupBy("sh").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= OFTEN).write.mode("overwrite").parquet(f"{path}/often")
    write(_prefixes(shingled, spark.read.parquet(f"{path}/often"), by, threshold), "prefixes")
    both = lambda part, own: own if old[part] is None else old[part].select(*own.columns).union(own)
    every_form = both("forms", forms)
    sets = every_form.select("id", "s").withColumnRenamed("id", "seq")
    every = settle(_shared(spark.read.parquet(f"{here}/prefixes"), old["prefixes"], every_form, by))
    new = every.where("fresh")
    # what is new stands for itself, what is old for its component
    labels = forms.select("id", F.col("id").alias("label"))
    if old["labels"] is not None:
        labels = _resolved(old["labels"], old["merges"]).union(labels)
    labels = settle(labels)
    first = every.groupBy(*by, "sh").agg(F.min_by(F.struct("id", "size", "n"), "id").alias("f")).select(*by, "sh", "f.*")
    tried = settle(_pairs(new, first, by, threshold, tolerance))
    links = settle(_of_labels(similar(tried, sets, threshold), labels))
    now = settle(_joined(labels, links))
    held = lambda df: df.join(now, "id")
    more = _pairs(held(new), held(every), by, threshold, tolerance, F.col("x.label") != F.col("y.label")).join(tried, ["a", "b"], "left_anti")
    links = settle(links.union(_of_labels(similar(more, sets, threshold), labels)).distinct())
    ends = settle(components(links).toDF("l", "end"))
    own = forms.select("id").join(ends, F.col("id") == F.col("l"), "left").select("id", F.coalesce("end", "id").alias("label"))
    write(own, "labels")
    write(ends.where("l <> end").select(F.col("l").alias("old"), F.col("end").alias("new")), "merges")
    write(rows.select(*by, "seq", "norm_hash"), "members")
    write(spark.range(1), "done")


def _of_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b) of the labels that pairs (a, b) of texts join."""
    out = pairs.select("a", "b").join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la <> lb")
    return out.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    ends = components(links).toDF("l", "end")
    return labels.join(ends, F.col("label") == F.col("l"), "left").select("id", F.coalesce("end", "label").alias("label"))


def clusters(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """(seq, component, norm_hash) of all sections so far; component is the smallest seq."""
    members, forms = _all(spark, path, "members"), _all(spark, path, "forms").select(*by, "norm_hash", "id")
    labels = _resolved(_all(spark, path, "labels"), _all(spark, path, "merges"))
    rows = members.alias("m").join(forms.alias("f"), _same("m", "f", [*by, "norm_hash"])).select("m.seq", "m.norm_hash", "f.id").join(labels, "id")
    least = rows.groupBy("label").agg(F.min("seq").alias("component"))
    return rows.join(least, "label").select("seq", "component", "norm_hash")
