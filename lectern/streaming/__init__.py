"""Streams.

The column expressions of lectern.functions and the row-wise operators (cleaning, splitting, chunking, routing) keep
no state, so they can be applied to a streaming DataFrame as they are; `clean_stream` does so for text files. The
conversation log keeps state: `lectern.streaming.log`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import clean_text, unix_newlines


def clean_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """(path, text) of the text files that arrive in folder, cleaned."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), clean_text(unix_newlines(F.col("value"))).alias("text"))
