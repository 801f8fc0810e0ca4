"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space: the separators of words, and what is stripped from lines. Fixed value.
WHITE = " \t\n\x0b\x0c\r"
#: A word is a maximal run of other characters. Fixed value.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own_dir(spark)


def _own_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return spark.sparkContext.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one, with all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows and bytes of an Arrow batch: memory holds the texts of so many at once, on either side.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def small_batches(df: DataFrame) -> DataFrame:
    """df, after seeing to it that its session's Arrow batches keep to BATCH_LIMITS. Spark reads the settings when the plan runs, so they stay."""
    conf, number = df.sparkSession.conf, df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in BATCH_LIMITS.items():
        now = 0 if conf.get(key).startswith("-") else number(conf.get(key))
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, its lineage cut; survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    kept = df.checkpoint(eager=True)
    # Spark deletes shuffle files once the driver has collected what refers to them: many short jobs would let them pile up
    spark._jvm.System.gc()
    return kept


def running(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """df with, for each name, the sum of a column (long or double) over all rows before it in `order`; no window over one task.

    Rows are dealt by ranges; the driver gets one row a range, as many as there are shuffle partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    rows = sorted(dealt.groupBy("__range").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).collect())
    upto, at = [], [0] * len(sums)
    for r in rows:
        upto.append((r["__range"], *at))
        at = [x + (r[k] or 0) for x, k in zip(at, sums, strict=True)]
    kinds = {k: dealt.select(F.sum(c).alias("s")).dtypes[0][1] for k, c in sums.items()}
    upto = [(r[0], *(float(x) if kinds[k] == "double" else x for x, k in zip(r[1:], sums, strict=True))) for r in upto]
    starts = spark.createDataFrame(upto, "__range int" + "".join(f", __{k} {t}" for k, t in kinds.items()))
    before = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(k) for k, c in sums.items()]).join(F.broadcast(starts), "__range")
    return out.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__range", *[f"__{k}" for k in sums])


def whole_text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))
