"""A collection that grows: appends, replays, writers at once, readers during a write, compaction."""

import pytest

from lectern.sources import collection as C

SCHEMA = "author_key string, mode string, work_title string, section_title string, section_index int, chunk_index int, page_content string"


def rows(spark, *named):
    return spark.createDataFrame([("a", "m" if i % 2 else "l", None if i == 5 else "w", "s", 1, i, t) for i, t in named], SCHEMA)


def texts(df) -> dict:
    out = [(r.chunk_index, r.page_content) for r in df.collect()]
    assert len(out) == len(dict(out))
    return dict(out)


def test_batches_replace_and_drop(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError, match="append"):
        C.read(spark, path)
    assert C.append(rows(spark, (1, "one"), (2, "two"), (5, "five")), path, "x") == 1
    assert texts(C.read(spark, path)) == {1: "one", 2: "two", 5: "five"}
    assert C.append(rows(spark, (2, "TWO"), (3, "three")), path, "y", gone=rows(spark, (1, ""), (3, ""), (9, ""))) == 2
    want = {2: "TWO", 3: "three", 5: "five"}
    assert texts(C.read(spark, path)) == want
    # a key that went can come again; a null in a key is a value
    C.append(rows(spark, (1, "again"), (5, "FIVE")), path, "z")
    want = {**want, 1: "again", 5: "FIVE"}
    assert texts(C.read(spark, path)) == want and texts(C.read(spark, path, 1)) == {1: "one", 2: "two", 5: "five"}
    # files of other modes are not read
    assert "PartitionFilters: [isnotnull(mode" in C.read(spark, path).where("mode = 'l'")._jdf.queryExecution().simpleString()


def test_a_batch_that_failed_is_sent_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    C.append(rows(spark, (1, "one")), path, "x")
    commit = C._commit
    monkeypatch.setattr(C, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        C.append(rows(spark, (2, "two")), path, "y")
    # its rows are written and do not count
    assert texts(C.read(spark, path)) == {1: "one"}
    monkeypatch.setattr(C, "_commit", commit)
    assert C.append(rows(spark, (2, "two")), path, "y") == 2
    assert C.append(rows(spark, (2, "other rows, one name")), path, "y") == 2
    assert texts(C.read(spark, path)) == {1: "one", 2: "two"}
    # the folder that was left behind goes, once it is old enough
    assert C.vacuum(spark, path) == [] and len(C.vacuum(spark, path, older=-5)) == 1
    assert texts(C.read(spark, path)) == {1: "one", 2: "two"}


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """Another writer commits between this one's look and its own commit."""
    path = str(tmp_path / "c")
    C.append(rows(spark, (1, "one")), path, "x")
    commit, others = C._commit, [("p", (2, "two")), ("q", (3, "three"))]

    def late(*a):
        if others:
            name, row = others.pop()
            monkeypatch.setattr(C, "_commit", commit)
            C.append(rows(spark, row), path, name)
            monkeypatch.setattr(C, "_commit", late)
        return commit(*a)

    monkeypatch.setattr(C, "_commit", late)
    assert C.append(rows(spark, (4, "four")), path, "y") == 4
    monkeypatch.setattr(C, "_commit", commit)
    assert texts(C.read(spark, path)) == {1: "one", 2: "two", 3: "three", 4: "four"}
    monkeypatch.setattr(C, "_commit", lambda *a: False)
    with pytest.raises(OSError, match="first"):
        C.append(rows(spark, (5, "five")), path, "never")


def test_a_reader_sees_one_version(spark, tmp_path):
    path = str(tmp_path / "c")
    C.append(rows(spark, (1, "one"), (2, "two")), path, "x")
    before = C.read(spark, path)
    C.append(rows(spark, (2, "TWO")), path, "y")
    C.compact(spark, path)
    assert texts(before) == {1: "one", 2: "two"} and texts(C.read(spark, path)) == {1: "one", 2: "TWO"}


def test_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    for i in range(4):
        C.append(rows(spark, (1, f"one {i}"), (10 + i, "x")), path, f"b{i}", gone=rows(spark, (9 + i, "")))
    want = texts(C.read(spark, path))
    assert want == {1: "one 3", 13: "x"}
    # a batch comes while it is written
    counted = C._counted
    monkeypatch.setattr(C, "_counted", lambda *a: (monkeypatch.setattr(C, "_counted", counted), C.append(rows(spark, (20, "late")), path, "late"), counted(*a))[2])
    C.compact(spark, path)
    now = C.manifest(spark, path)["batches"]
    assert len(now) == 2 and texts(C.read(spark, path)) == {**want, 20: "late"}
    # names of what was compacted stay known
    assert C.append(rows(spark, (1, "old")), path, "b2") == C.manifest(spark, path)["version"]
    C.compact(spark, path)
    assert len(C.vacuum(spark, path, older=-5)) > 5 and texts(C.read(spark, path)) == {**want, 20: "late"}
    assert len(C._versions(spark, path)) == 1
