"""Null ids, all-null columns, ids that different texts share, and tables of one hot group."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, exact_dedup, language_id, line_dedup, minhash, mixing, quality, repeats, substring_dedup, suffix_dedup

LONG = " ".join(f"word{i % 37}x{i}" for i in range(60))
ROWS = [(None, LONG, "en", "s"), (None, LONG, None, None), (7, LONG, "en", "s"), (7, "another text", "en", None), (7, None, None, None), (3, LONG + " end", "en", "s"), (None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None, None, None, None)] * 5, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def hot(spark):
    rows = [(i, LONG if i % 3 else f"{LONG} tail {i // 30}", "en", "only") for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(9)


def every(docs, path):
    model, refs = language_id.train(docs), quality.learn(docs)
    return {
        "exact": exact_dedup.exact_groups(docs), "lines": line_dedup.dedup_lines(docs), "bytes": suffix_dedup.remove_repeated_bytes(docs), "words": substring_dedup.remove_repeated_words(docs),
        "near": minhash.near_duplicate_classes(docs), "mix": mixing.mix_table(docs), "language": language_id.identify(docs, model), "quality": quality.score(docs, refs), "bpe": bpe.encode(docs, path),
    }


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_a_row_for_every_row(odd, nulls, path):
    for docs in (odd, nulls):
        for name, out in every(docs, path).items():
            assert out.count() == docs.count(), name


def test_null_ids(odd):
    got = {(r.doc_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd, keep="largest").collect()}
    assert got == {(None, 3, False), (7, 3, True), (7, 1, True), (3, 1, True), (7, 2, True), (None, 2, False)}
    # the row with a null id comes first, so the others repeat it
    removed = {(r.doc_id, r.n_units): r.n_removed for r in suffix_dedup.remove_repeated_bytes(odd).collect()}
    assert removed[None, len(LONG)] == 0 and removed[7, len(LONG)] == len(LONG) and removed[3, len(LONG) + 4] == len(LONG)
    classes = [(r.doc_id, r.class_id) for r in minhash.near_duplicate_classes(odd).collect()]
    assert (3, 3) in classes and classes.count((7, 3)) >= 1


def test_hot_group(hot):
    assert {r.keep_id for r in exact_dedup.exact_groups(hot).where("group_size = 600").collect()} == {1}
    assert minhash.near_duplicate_classes(hot).select("class_id").distinct().count() == 1
    words = substring_dedup.remove_repeated_words(hot).where("n_removed < n_units").collect()
    assert {r.doc_id for r in words} >= {0} and all(r.n_units - r.n_removed <= 62 for r in words)
    mix = mixing.mix_table(hot)
    assert mix.agg(F.sum("taken")).first()[0] == mix.agg(F.sum("size")).first()[0]


def tongues(n: int, each: int) -> list[tuple[str, str]]:
    """(text, lang) of n invented languages, each with words of its own."""
    rng = random.Random(n)
    out = []
    for i in range(n):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzéöñçàüîø", 7)
        vocab = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(30)]
        out += [(" ".join(rng.choices(vocab, k=60)), f"l{i}") for _ in range(each)]
    return out


@pytest.mark.parametrize("ids", [[None], [5], [6], [7], [8], [9], [None, 3]])
def test_languages_are_learned_whatever_the_ids(spark, ids):
    rows = [(ids[i % len(ids)], *x) for i, x in enumerate(tongues(3, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, per_language=10)
    assert model.langs == ["l0", "l1", "l2"] and set(model.of) == {0, 1, 2}
    got = language_id.identify(docs, model, {"lang": F.col("lang")}).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_sample_is_bounded_and_never_empty(spark, monkeypatch):
    """One row repeated fills a language; another has one text; the sample holds each once."""
    (a, _), (b, _), (c, _) = tongues(3, 1)
    rows = [(1, a, "many")] * 3000 + [(1, b, "one")] + [(None, f"{c} {i}", "all") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    kept, settle = [], language_id.settle
    monkeypatch.setattr(language_id, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    model = language_id.train(docs, per_language=20)
    sizes = {r["lang"]: r["count"] for r in kept[0].groupBy("lang").count().collect()}
    assert sizes["many"] == sizes["one"] == 1 and 10 <= sizes["all"] <= 40
    got = language_id.identify(docs.dropDuplicates(["text"]), model, {"lang": F.col("lang")}).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_three_hundred_languages(spark):
    rows = [(None, *x) for x in tongues(300, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language_id.train(docs)
    assert len(set(model.of)) == 300
    got = language_id.identify(docs, model, {"lang": F.col("lang")}).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.99 * len(rows) and all(r.lang_pred != "und" for r in got)


@pytest.mark.parametrize(("blocks", "each", "shared", "hot"), [(200, 3999, False, True), (200, 30, False, True), (200, 15, False, False), (200, 1, True, False), (1, 4100, False, True), (1, 3000, False, False)])
def test_hot_anchors_are_counted_over_all_blocks(blocks, each, shared, hot):
    """Blocks that each have fewer than HOT segments of an anchor make it hot together, unless they are the same ones."""
    rng = np.random.default_rng(blocks + each)
    lists = []
    for b in range(blocks):
        content = np.unique(rng.integers(0, 2**32, each, dtype=np.uint64).astype(np.uint32)) if not shared else np.array([77], np.uint32)
        least = pa.ListArray.from_arrays(pa.array([0, min(len(content), repeats.KINDS), min(len(content), repeats.KINDS) + 1], pa.int32()), pa.array(np.append(content[: repeats.KINDS], np.uint32(5))))
        lists.append(repeats.pack(h=np.array([11, 12], np.uint64), many=np.array([False, False]), kinds=np.array([len(content), 1], np.int32), least=least))
    table = pa.table({"block": pa.array(range(blocks), pa.int64()), "data": pa.array(lists, pa.binary())})
    out = repeats._shared_hashes(repeats.HOT)(table)
    for data in out.column("data").to_pylist():
        found = dict(zip(*(x.to_pylist() for x in (repeats.unpack(data)["h"], repeats.unpack(data)["hot"])), strict=True))
        assert found[11] is hot and found[12] is False
    # an anchor that one block alone has, once, is not told on
    assert out.num_rows == (blocks if blocks > 1 else 0)


def test_one_line_among_ever_other_neighbours(spark, monkeypatch):
    """An anchor that is hot over several blocks and in none of them: results are those of brute force."""
    monkeypatch.setattr(repeats, "HOT", 40)
    line = "this very line stands in every document of them all, between ever other neighbours, and is a hundred bytes or more long"
    rows = [(i, f"{i * 7919 % 1000:04d} {'abcdefghij'[i % 10] * 60}{i} {line} {i}{'klmnopqrst'[i % 7] * 70}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen, want = set(), {}
    for i, text in rows:
        b, covered = text.encode(), set()
        for at in range(len(b) - 99):
            if b[at : at + 100] in seen:
                covered.update(range(at, at + 100))
            seen.add(b[at : at + 100])
        want[i] = len(covered)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_bytes(docs).collect()}
    assert got == want and sum(v > 0 for v in want.values()) >= 119
