"""The conversation log as a stream: the list of conversations kept up to date while messages arrive.

Messages are rows (conversation_id, seq, content, at, deleted). State is one short row a conversation: its first message's
seq and the title cut from it, the times of its first and last message, and whether it has been deleted. All of these are
minima and maxima, so neither the order in which messages arrive nor one that arrives twice changes them. Each micro-batch
gives the conversations that it touches, and the sink writes it below the batch's number, over what a failed try of the same
batch has left: `listed` is the same after a restart at any place.

Messages may be `delay` late, behind the latest that has been seen; later ones are not looked at. A deleted conversation
stays so, whatever still comes for it in that time; then its state goes. A null conversation, seq or time is not looked at; a
null text gives a null title.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.sources.conversations import TITLE_CHARS

ROW = "id bigint, title string, created_us bigint, updated_us bigint, deleted boolean"
STATE = "seq bigint, title string, created_us bigint, updated_us bigint, deleted boolean"


def _updated(hold_ms: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, title, created, updated, deleted = state.get if state.exists else (None, None, None, None, False)
        latest = 0
        for p in parts:
            latest = max(latest, int(p["us"].max()) // 1000)
            deleted = bool(deleted or p["deleted"].any())
            said = p[~p["deleted"]]
            if len(said):
                first = said.loc[said["seq"].idxmin()]
                if seq is None or first["seq"] < seq:
                    seq, title = int(first["seq"]), None if pd.isna(first["title"]) else str(first["title"])
                lo, hi = int(said["us"].min()), int(said["us"].max())
                created, updated = (lo, hi) if created is None else (min(created, lo), max(updated, hi))
        state.update((seq, title, created, updated, deleted))
        if deleted:
            # the watermark is behind what was seen, and 0 at the start
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), latest) + hold_ms)
        yield pd.DataFrame({"id": [key[0]], "title": [title], "created_us": pd.array([created], "Int64"), "updated_us": pd.array([updated], "Int64"), "deleted": [deleted]})

    return run


def conversations(messages: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of (id, title, created_us, updated_us, deleted): the conversations that each micro-batch touches, as they are after it."""
    hold = int(pd.Timedelta(delay).total_seconds() * 1000)
    rows = messages.where("conversation_id IS NOT NULL AND at IS NOT NULL AND (seq IS NOT NULL OR deleted)").withWatermark("at", delay)
    rows = rows.select("conversation_id", "at", F.coalesce("seq", F.lit(0)).alias("seq"), F.substring("content", 1, TITLE_CHARS).alias("title"), F.unix_micros("at").alias("us"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return rows.groupBy("conversation_id").applyInPandasWithState(_updated(hold), ROW, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def store(path: str):
    """What writes a micro-batch: whole, below its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def start(messages: DataFrame, path: str, checkpoint: str, delay: str = "7 days", **trigger) -> StreamingQuery:
    """Keeps the list below path up to date. A query started again with its checkpoint goes on where it was."""
    return conversations(messages, delay).writeStream.outputMode("update").foreachBatch(store(path)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, created_at, updated_at) of the conversations that are there, latest first."""
    rows = spark.read.schema(f"{ROW}, batch bigint").parquet(path)
    last = rows.groupBy("id").agg(F.max_by(F.struct("title", "created_us", "updated_us", "deleted"), "batch").alias("c")).where("NOT c.deleted AND c.created_us IS NOT NULL")
    out = last.select("id", "c.title", F.timestamp_micros("c.created_us").alias("created_at"), F.timestamp_micros("c.updated_us").alias("updated_at"))
    return out.orderBy(F.desc("updated_at"), F.desc("id"))
