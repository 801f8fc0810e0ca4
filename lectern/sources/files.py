"""Text, JSON-lines and vector files, and the download that fills a raw folder."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import unix_newlines
from lectern.operators.dedup import settle

SECTION = "seq bigint, author_key string, author_display string, mode string, work_title string, section_title string, section_index int, text string, source_ref string"
#: Where the raw text of a work is published, by number. Fixed value.
SOURCE_URL = "https://www.gutenberg.org/cache/epub/{id}/pg{id}.txt"


def slug(title: str) -> str:
    return "-".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in title.lower()).split()) or "untitled"


def fetch(url: str) -> str:
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as r:
        return r.read().decode("utf-8")


def download(works: list[tuple[str, str, str, int]], raw_dir: str, get: Callable[[str], str] = fetch, wait: float = 1.0) -> list[Path]:
    """Files raw_dir/author/mode/slug.txt of (author_key, mode, title, id) that are not there yet. A step of the driver, before any job; errors are raised."""
    made = []
    for author, mode, title, number in works:
        path = Path(raw_dir, author, mode, f"{slug(title)}.txt")
        if not path.exists():
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(get(SOURCE_URL.format(id=number)), encoding="utf-8")
            made.append(path)
            time.sleep(wait)
    return made


def read_raw(spark: SparkSession, raw_dir: str) -> DataFrame:
    """(author_key, mode, slug, raw) of the files raw_dir/author/mode/slug.txt, with line ends as \\n. Works without a file are simply not there."""
    files = spark.read.text(f"{raw_dir}/*/*/*.txt", wholetext=True).select(F.col("value"), F.split(F.col("_metadata.file_path"), "/").alias("p"))
    part = lambda i: F.url_decode(F.element_at("p", i))
    return files.select(part(-3).alias("author_key"), part(-2).alias("mode"), F.regexp_replace(part(-1), r"\.txt$", "").alias("slug"), unix_newlines(F.col("value")).alias("raw"))


def read_jsonl(spark: SparkSession, path: str, schema: str = SECTION) -> DataFrame:
    """Rows of JSON lines; blank lines are left out."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_vectors(chunks: DataFrame, path: str) -> None:
    """Replaces the collection; searches prune files by author and mode."""
    chunks.write.mode("overwrite").partitionBy("author_key", "mode").parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        settle(spark.range(1))
    return f"{spark.conf.get('spark.checkpoint.dir', None) or sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, with all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, path: str) -> DataFrame:
    """df computed now, so that the folder it reads can go; the folder is deleted."""
    out = settle(df)
    remove(df.sparkSession, path)
    return out


def lookup(chunks: DataFrame, **where) -> DataFrame:
    """Chunks whose columns have these values (or one of a list of values)."""
    for name, value in where.items():
        chunks = chunks.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name).eqNullSafe(F.lit(value)))
    return chunks
