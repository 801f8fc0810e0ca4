"""Indexes of vectors and texts against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import search, text_index, vector_index


def vectors(n: int, dims: int, seed: int = 1, groups: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    if groups:
        x = 0.4 * x + rng.normal(size=(groups, dims))[rng.integers(0, groups, n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)


def asked_of(df):
    return df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


@pytest.mark.parametrize("groups", [0, 12])
def test_recall_and_pruning(spark, tmp_path, groups):
    v = frame(spark, vectors(3000, 20, groups=groups))
    path = str(tmp_path / "index")
    vector_index.build(v, path, k=8)
    rows = spark.read.parquet(f"{path}/rows")
    # every row, once, in the cell whose centre is nearest
    model = vector_index.open_model(spark, path)
    got = {r.vec_id: r.cell for r in rows.select("vec_id", "cell").collect()}
    x = {r.vec_id: np.array(r.embedding, np.float32) for r in v.collect()}
    assert len(got) == rows.count() == 3000
    assert all(((model.centres[c] - x[i]) ** 2).sum() <= ((model.centres - x[i]) ** 2).sum(1).min() + 1e-5 for i, c in got.items())
    asked = asked_of(v)
    found = vector_index.search(spark, path, asked, 8)
    exact = search.nearest(asked, v, 8)
    hits = vector_index.recall(found, exact).collect()
    assert len(hits) == 150 and np.mean([h.recall for h in hits]) >= 0.9
    # distances are exact, in order, of different vectors
    true = {(r.qid, r.vec_id): ((x[r.qid] - x[r.vec_id]) ** 2).sum() for r in found.collect()}
    assert len(true) == found.count() == 8 * 150
    by = {}
    for r in found.orderBy("qid", "rank").collect():
        assert r.distance == pytest.approx(true[r.qid, r.vec_id], abs=1e-5) and r.distance >= by.get(r.qid, 0)
        by[r.qid] = r.distance
    if groups:
        # neighbours lie close together: few cells are read
        assert model.probes < len(model.centres) / 3
        one = vector_index.search(spark, path, asked.where("qid = 0"), 8)
        files = [f for f in rows.inputFiles() if int(f.split("cell=")[1].split("/")[0]) in set(model.cells_of(x[0][None], model.probes)[0].tolist())]
        assert one.count() == 8 and len(files) < len(rows.inputFiles()) / 2


def test_all_cells_and_candidates_are_exact(spark, tmp_path):
    v = frame(spark, vectors(400, 7))
    vector_index.build(v, str(tmp_path / "i"), cells=9, parts=3, codes=8)
    asked = asked_of(v)
    found = vector_index.search(spark, str(tmp_path / "i"), asked, 5, probes=9, candidates=400)
    key = lambda df: sorted((r.qid, r.rank, r.vec_id) for r in df.collect())
    assert key(found) == key(search.nearest(asked, v, 5))


def test_hot_vector_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SPLIT_ROWS", 100)
    monkeypatch.setattr(vector_index, "QUESTIONS", 7)
    x = vectors(600, 6)
    x[200:400] = x[0]
    odd = spark.createDataFrame([(None, [1.0] * 6), (9001, None), (9002, [1.0] * 5), (9003, [float("nan")] * 6), (9004, [None] * 6)], "vec_id long, embedding array<float>")
    v = frame(spark, x)
    path = str(tmp_path / "i")
    vector_index.build(v.union(odd), path)
    rows = spark.read.parquet(f"{path}/rows")
    assert rows.count() == 600 and rows.groupBy("cell", "split").count().agg(F.max("count")).first()[0] <= 200
    found = vector_index.search(spark, path, asked_of(v), 4)
    # of the copies those with the smallest ids
    assert [r.vec_id for r in found.where("qid = 0").orderBy("rank").collect()] == [0, 200, 201, 202]
    assert np.mean([r.recall for r in vector_index.recall(found, search.nearest(asked_of(v), v, 4)).collect()]) >= 0.9


def test_nothing_to_index(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    vector_index.build(none, str(tmp_path / "i"))
    v = frame(spark, vectors(3, 4))
    assert vector_index.search(spark, str(tmp_path / "i"), asked_of(v), 3).count() == 0
    vector_index.build(v, str(tmp_path / "j"))
    assert vector_index.search(spark, str(tmp_path / "j"), asked_of(v), 8).count() == 3


# Texts


def letters(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé中 ") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = [(i * 7 - 3, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 50, 400])))) for i in range(n)]
    return [*rows, (9001, None), (None, "abc needle abc"), (9002, ""), (9003, "ab"), (9004, "x" * 1022 + "needle" + "y" * 3000 + "needle"), (9005, "the same id"), (9005, "needle twice"), (9006, "a" * 5000)]


TERMS = ["needle", "xneed", "y" * 1500, "needle" + "y" * 3000 + "needle", "a", "é", "中", "ab", "é中", "zzz", "needles", "", None, "a" * 4999, "e id", "eb ", "bc d"]


@pytest.mark.parametrize("few", [1, 4])
def test_every_occurrence_is_found(spark, tmp_path, monkeypatch, few):
    rows = letters(200, 2)
    texts = [t for _, t in rows if t]
    rng = random.Random(few)
    terms = TERMS + [t[a : a + n] for t in rng.choices(texts, k=60) for n in [rng.choice([3, 4, 9, 40])] for a in [rng.randrange(len(t))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    text_index.build(docs, str(tmp_path / "i"))
    got = text_index.search(spark, str(tmp_path / "i"), docs, spark.createDataFrame([(t,) for t in terms], "term string"), few=few)
    found = [(r.term, r.id) for r in got.collect()]
    want = {(t, i) for t in terms if t for i, x in rows if i is not None and x is not None and t in x}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 200


def test_batches_and_pages(spark, tmp_path):
    """Texts of many pages in many batches; few candidates are not hits."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.choice([10, 900, 30_000, 150_000])))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "i")
    text_index.build(docs, path)
    terms = [rows[i][1][k : k + 12] for i in (3, 40, 80) for k in (0, 500, 1020, 29_990) if len(rows[i][1]) > k + 12]
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    want = {(t, i) for t in terms for i, x in rows if t in x}
    assert {(r.term, r.id) for r in text_index.search(spark, path, docs, asked).collect()} == want
    assert text_index.candidates(spark, path, asked).count() < 3 * len(want) + 20
    # a rare term reads its grams' buckets alone
    one = asked.where(F.col("term") == terms[0])
    picked = [r.gram for r in text_index.rarest(spark, path, one).collect()]
    plan = text_index.candidates(spark, path, one)._jdf.queryExecution().simpleString()
    assert len(picked) == text_index.FEW and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN \(|= )", plan)


def test_index_of_no_texts(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    text_index.build(none, str(tmp_path / "i"))
    asked = spark.createDataFrame([("needle",), ("x",)], "term string")
    assert text_index.search(spark, str(tmp_path / "i"), none, asked).count() == 0


def test_a_search_of_texts_holds_a_few_batches_at_once(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choices("abc", k=rng.choice((2, 900, 4000))))) for i in range(200)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(30)
    text_index.build(rows, str(tmp_path))
    seen, keep = [], text_index.settle
    monkeypatch.setattr(text_index, "settle", lambda df: seen.append(df) or keep(df))
    terms = ["abcabcab", "aaaabbbb", "cabbac", *("".join(rng.choices("abc", k=9)) for _ in range(40))]
    found = text_index.search(spark, str(tmp_path), rows, spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {(r.term, r.id) for r in found.collect()} == {(t, i) for t in terms for i, x in texts if t in x}
    plan = seen[1]._jdf.queryExecution().optimizedPlan().toString()
    # before, every page of every gram was a row of an aggregate in the tasks that read the index
    assert plan.index("Generate") < plan.index("Aggregate") < plan.index("RepartitionByExpression")
    assert 7 <= int(re.search(r"RepartitionByExpression \[batch#\d+L\], (\d+)", plan)[1]) <= 8
