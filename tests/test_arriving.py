"""Duplicates of arriving sections are those of a full run, after each batch."""

import random

import pytest

from lectern.operators import arriving, dedup

SCHEMA = "seq long, mode string, text string"
BY = ["mode"]


def texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base, chain, out = rng.choices(words, k=120), rng.choices(words, k=150), []
    for i in range(14):  # near copies of one text
        out.append(" ".join(base[:60] + rng.choices(words, k=2) + base[60:]))
    for _ in range(12):  # each is near the one before alone
        out.append(" ".join(chain))
        chain = chain[25:] + rng.choices(words, k=25)
    out += [" ".join(rng.choices(words, k=100)) for _ in range(8)]
    out += [out[0].upper() + "!", out[3], out[20], "é ?", "--", "", "short one", "short one", None]
    rng.shuffle(out)
    seqs = rng.sample(range(1000), len(out))  # smaller ids may come later
    return [(s, None if i % 8 == 0 else "m" if i % 9 else "n", t) for i, (s, t) in enumerate(zip(seqs, out, strict=True))]


def found(df) -> dict:
    rows = [(r.seq, r.component, r.norm_hash) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("seed", [1])
def test_each_batch_gives_what_a_full_run_gives(spark, tmp_path, seed):
    rows, path, done = texts(seed), str(tmp_path), []
    for i, lo in enumerate(range(0, len(rows), 16)):
        batch = rows[lo : lo + 16]
        done += batch
        arriving.add(spark.createDataFrame(batch, SCHEMA), path, f"b{i}", BY)
        want = found(dedup.clusters(spark.createDataFrame(done, SCHEMA), BY))
        assert found(arriving.clusters(spark, path, BY)) == want
    assert len({c for c, _ in want.values()}) < len(rows) - 15


def test_replays_and_failed_batches(spark, tmp_path, monkeypatch):
    rows, path = texts(3), str(tmp_path)
    arriving.add(spark.createDataFrame(rows[:20], SCHEMA), path, "a", BY)
    # fails in the middle: what it wrote does not count
    joined = arriving._joined
    monkeypatch.setattr(arriving, "_joined", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        arriving.add(spark.createDataFrame(rows[20:], SCHEMA), path, "b", BY)
    before = found(arriving.clusters(spark, path, BY))
    assert set(before) == {r[0] for r in rows[:20]}
    monkeypatch.setattr(arriving, "_joined", joined)
    for _ in range(2):
        arriving.add(spark.createDataFrame(rows[20:], SCHEMA), path, "b", BY)
    want = found(dedup.clusters(spark.createDataFrame(rows, SCHEMA), BY))
    assert found(arriving.clusters(spark, path, BY)) == want


def test_only_shared_prefixes_go_on(spark, tmp_path, monkeypatch):
    rows, path, sent = texts(1), str(tmp_path), []
    pairs = arriving._pairs
    monkeypatch.setattr(arriving, "_pairs", lambda new, every, *a: sent.append(every) or pairs(new, every, *a))
    monkeypatch.setattr(arriving, "OFTEN", 3)
    arriving.add(spark.createDataFrame(rows[:20], SCHEMA), path, "a", BY)
    arriving.add(spark.createDataFrame(rows[20:], SCHEMA), path, "b", BY)
    # before, every prefix of every batch was joined
    last = sent[-1].groupBy("mode", "sh").count().collect()
    assert last and all(r["count"] > 1 for r in last)
    assert found(arriving.clusters(spark, path, BY)) == found(dedup.clusters(spark.createDataFrame(rows, SCHEMA), BY))
