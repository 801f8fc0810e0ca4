"""What lies on disk while duplicates are found and questions searched."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import dedup, search

BY, SCHEMA = ["mode"], "seq long, mode string, work_title string, section_title string, text string, priority int"


@pytest.fixture(scope="module")
def copies(spark):
    """Exact and near copies among texts of their own."""
    rnd, rows = random.Random(3), []
    for i in range(60):
        words = [f"w{rnd.randrange(400)}" for _ in range(80)]
        for j in range(i % 4):
            rows.append((len(rows), f"m{i % 2}", f"work {i % 5}", f"part {j}", " ".join(["other", *words[1:]] if j == 1 else words), i % 3))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def shuffled(spark):
    return {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}


def test_settled_rows_leave_no_shuffle_files(spark):
    before, was = shuffled(spark), spark.conf.get(dedup.CLEANUP, None)
    df = spark.range(2000).groupBy((F.col("id") % 50).alias("k")).count()
    settled = dedup.settle(df)
    end = time.time() + 20
    while shuffled(spark) - before and time.time() < end:  # files go in the background
        time.sleep(0.2)
    assert not shuffled(spark) - before and spark.conf.get(dedup.CLEANUP, None) == was
    assert settled.agg(F.sum("count")).first()[0] == df.agg(F.sum("count")).first()[0] == 2000


def test_shingles_sent_in_rounds_give_the_same_pairs(spark, copies, monkeypatch):
    found = lambda: sorted(map(tuple, dedup.near_pairs(copies, BY).collect()))
    whole, sent, keep = found(), [], dedup._often
    monkeypatch.setattr(dedup, "SENT", 100)
    monkeypatch.setattr(dedup, "_often", lambda each, i, rounds: sent.append((i, rounds)) or keep(each, i, rounds))
    assert found() == whole and whole
    assert sent == [(i, dedup.ROUNDS) for i in range(dedup.ROUNDS)]


def test_a_report_keeps_no_texts(spark, copies, monkeypatch):
    kept, keep = [], dedup.settle
    monkeypatch.setattr(dedup, "settle", lambda df: kept.append(df.columns) or keep(df))
    got = dedup.report(copies, BY, F.col("priority")).collect()
    assert {r.match_type for r in got} == {"exact", "near"} and kept and not any({"text", "norm"} & set(c) for c in kept)
    assert dedup.keep_first(copies, BY, F.col("priority")).count() == copies.count() - len(got)
    texts = {r.seq: r for r in copies.collect()}
    grams = lambda r: {tuple(w[i : i + 10]) for w in [r.text.split()] for i in range(len(w) - 9)}
    for r in got:
        a, b = texts[r.dropped_seq], texts[r.kept_seq]
        assert (a.work_title, a.section_title, b.work_title, b.section_title) == (r.dropped_work_title, r.dropped_section_title, r.kept_work_title, r.kept_section_title)
        assert r.similarity == round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 3) and (r.match_type == "exact") == (a.text == b.text)


def test_questions_are_searched_block_by_block(spark, monkeypatch):
    rnd = random.Random(5)
    text = lambda: " ".join(f"w{rnd.randrange(60)}" for _ in range(12))
    rows = [("ada", ["literature", "life_process"][i % 2], f"work {i % 3}", "part", 1, i, text(), [float(rnd.randrange(9)) for _ in range(4)], f"ref{i}") for i in range(80)]
    held = spark.createDataFrame(rows, "author_key string, mode string, work_title string, section_title string, section_index int, chunk_index int, page_content string, embedding array<float>, source_ref string").repartition(3)
    asked = [(i, "ada", ["oeuvre", "life_process"][i % 2], None, None, 5, [float(rnd.randrange(9)) for _ in range(4)], None, None, ["w7", "w8"] if i % 3 else None, None) for i in range(20)]
    asked = spark.createDataFrame(asked, "qid long, author_key string, scope string, work_titles array<string>, only_works array<string>, top_k int, qvec array<float>, entity_terms array<string>, topic_groups array<array<string>>, variants array<string>, chapter string")
    found = lambda: sorted(tuple(r) for r in search._channels(asked, held).select("qid", "channel", "pos", "distance", *search.CHUNK_KEY, "page_content").collect())
    whole, met, keep = found(), [], search.grid
    monkeypatch.setattr(search, "WIDE_QUESTIONS", 7)
    monkeypatch.setattr(search, "grid", lambda q, v, by, blocks: met.append((blocks[0], v.columns)) or keep(q, v, by, blocks))
    assert found() == whole and len(whole) >= 20 * 5
    # before, one grid sent all chunks as they are, as often as there were blocks of questions
    assert met == [(1, ["author_key", "mode", "packed"])] * 3
