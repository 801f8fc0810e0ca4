"""The log as a stream: any order, restarts, late and repeated messages, deletions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.sources import conversations as C
from lectern.streaming import log

MESSAGE = "conversation_id long, seq long, content string, at timestamp, deleted boolean"
T0 = pd.Timestamp("2024-03-01 12:00:00")


def at(minutes: int) -> pd.Timestamp:
    return T0 + pd.Timedelta(minutes=minutes)


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def arrive(*rows):
        spark.createDataFrame([(c, s, t, at(m).to_pydatetime(), d) for c, s, t, m, d in rows], MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(**options):
        stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        log.start(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), **options).awaitTermination()
        return {r.id: (r.title, r.created_at, r.updated_at) for r in log.listed(spark, str(tmp_path / "out")).collect()}

    arrive.run, arrive.path = run, tmp_path
    return arrive


def listed(spark, rows) -> dict:
    """What `list_conversations` gives for the same messages."""
    df = spark.createDataFrame([(c, s, t, at(m).to_pydatetime(), d) for c, s, t, m, d in rows], MESSAGE)
    gone = df.where("deleted").select(F.col("conversation_id").alias("id")).distinct()
    said = df.where("NOT coalesce(deleted, false) AND conversation_id IS NOT NULL AND seq IS NOT NULL")
    talks = said.groupBy(F.col("conversation_id").alias("id")).agg(F.min_by("content", "seq").alias("title"), F.min("at").alias("created_at"))
    talks, messages = C.without(C.new_conversations(talks.withColumns({"author_key": F.lit("a"), "mode": F.lit("m")})), said.select("conversation_id", F.col("at").alias("created_at")), gone)
    return {r.id: (r.title, r.created_at, r.updated_at) for r in C.list_conversations(talks, messages).collect()}


def test_any_order_and_restarts_give_one_list(spark, folder):
    rng = random.Random(4)
    rows = [(c, s, None if (c + s) % 9 == 0 else f"message {s} of {c} " * 8, 60 * c + 7 * s, False) for c in range(12) for s in range(rng.randint(1, 9))]
    rows += [(3, None, None, 500, True), (7, None, None, 501, True), (None, 1, "of none", 3, False), (5, None, "no seq", 9, False), (6, 50, "null flag", 450, None)]
    rng.shuffle(rows)
    done = []
    for lo in range(0, len(rows), 9):
        # some messages come again
        part = rows[lo : lo + 9] + rng.sample(rows[: lo + 1], 1)
        folder(*part)
        done += part
        if lo % 2 == 0:
            got = folder.run()  # a new query each time, from the checkpoint
            assert got == listed(spark, done)
    assert folder.run() == listed(spark, rows) and len(got) >= 9


def test_a_batch_written_twice_counts_once(spark, folder):
    folder((1, 0, "title", 0, False))
    folder((1, 1, "more", 5, False), (2, 0, "other", 6, False))
    got = folder.run()
    out = str(folder.path / "out")
    # the last batch fails after its sink has written half of it, and runs again
    last = spark.read.parquet(f"{out}/batch=1")
    again = spark.createDataFrame(last.collect(), last.schema)
    log.store(out)(again.limit(1), 1)
    log.store(out)(again, 1)
    assert {r.id: (r.title, r.created_at, r.updated_at) for r in log.listed(spark, out).collect()} == got and len(got) == 2


def test_late_messages_and_deletions(spark, folder):
    folder((1, 5, "five", 100, False), (2, 0, "two", 100, False))
    folder((1, 0, "the first", 50, False))  # fifty minutes late
    assert folder.run(delay="1 hours")[1] == ("the first", at(50).to_pydatetime(), at(100).to_pydatetime())
    folder((2, None, None, 110, True))
    folder((2, 1, "after it was deleted", 115, False))
    folder((3, 0, "three", 900, False))
    assert set(folder.run(delay="1 hours")) == {1, 3}
    # far behind the watermark: not looked at
    folder((1, -1, "an old one", 1, False), (3, 1, "new", 901, False))
    got = folder.run(delay="1 hours")
    assert got[1][0] == "the first" and got[3][2] == at(901).to_pydatetime() and set(got) == {1, 3}
