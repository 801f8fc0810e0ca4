"""Queries over small tables of their own: nothing of the input is left out."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunks, dedup, routing, search
from lectern.plans import queries, views

DOCS = [
    (0, "the lamp was lit by the harbour wall each evening", "en", "src0"), (1, "letters came from the sister in winter", "en", "src4"),
    (2, "zebra quagga okapi grazed upon silver plains", "en", "src7"), (3, "kettle drum trumpet sounded before dawn", "fr", None),
    (4, "walrus tusk ivory traded along frozen coasts", None, "hot"), (5, None, "en", "src1"),
]
TURNS = [(c, t, x) for c, t, x in [(0, 0, "zebra quagga okapi grazed upon silver plains"), (0, 1, "kettle drum trumpet sounded before dawn"), (0, 2, "walrus tusk ivory traded along frozen coasts"), (1, 7, "letters came"), (1, 0, None), (2, 3, "")]]


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_every_source_is_searched_and_every_turn_answered(spark, folder, monkeypatch):
    path = folder(documents=(DOCS, "doc_id long, text string, lang string, source string"), conversations=(TURNS, "conv_id long, turn long, text string"))
    works = {(r.mode, r.work_title) for r in views.source_works(spark, path).collect()}
    assert len(works) == views.source_works(spark, path).count() == 5 + 3  # src7, hot and none
    assert {(r.mode, r.work_title) for r in views.source_sections(spark, path).collect()} <= works
    seen = []
    keep = queries.jobs.answer
    monkeypatch.setattr(queries.jobs, "answer", lambda q, w, a, e, index, **kw: seen.append(index) or keep(q, w, a, e, index, **kw))
    got = {r.qid: r for r in queries.answer_questions(spark, path).collect()}
    assert set(got) == {c * 1000 + t for c, t, _ in TURNS}
    assert {r.page_content for r in seen[0].select("page_content").collect()} == {t for _, t, *_ in DOCS if t}
    # brute force: all pairs of a plain question and a chunk of its mode, by distance
    asked = [r for r in views.questions(spark, path).collect() if got[r.qid].scope in ("oeuvre", "life_process")]
    assert asked
    vectors = {r.id: r.embedding for r in chunks.hash_embedding(spark.createDataFrame([(r.qid, r.question) for r in asked], "id long, t string"), "id", "t").collect()}
    index = seen[0].collect()
    for r in asked:
        mode = "life_process" if got[r.qid].scope == "life_process" else "literature"
        near = [x for x in index if r.qid in vectors and x.mode == mode and sum((a - b) ** 2 for a, b in zip(x.embedding, vectors[r.qid], strict=True)) <= search.MAX_DISTANCE]
        assert got[r.qid].grounded == bool(near) and got[r.qid].n_sources == min(len(near), search.TOP_K)


def test_questions_are_whole_turns(spark, folder):
    opener = "so much has been said of this and yet so little of it was ever written down by hand " * 2
    # conv_id + turn of 7: no start is put before these
    turns = [(0, 7, opener + "and then 'The Lantern Keeper' came up."), (2, 5, opener + "was it Captain Orlo Vane?"), (4, 3, opener + "new tales")]
    path = folder(conversations=(turns, "conv_id long, turn long, text string"))
    assert {r.qid: r.question for r in views.questions(spark, path).collect()} == {c * 1000 + t: x for c, t, x in turns}
    routed = {r.qid: r for r in queries.route_questions(spark, path).collect()}
    assert routed[7].scope == "specific_work" and routed[7].work_title == "The Lantern Keeper" and routed[2005].scope == "oeuvre"
    assert {r.qid: r.phrases for r in queries.key_phrases(spark, path).collect()}[2005] == "Captain Orlo Vane"
    # the slip names Harbour of Broken Glass by two of three words; the end of the turn has both words of another title
    assert {r.qid: r.title for r in queries.typo_match(spark, path).collect()}[7] == "The Lantern Keeper"


def of_sql(path: str, name: str, *tables: str) -> list[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return sorted(con.execute(queries.SQL[name]).fetchall())


def test_notices_after_line_ends_and_blanks(spark, folder):
    odd = ["\nstarts a line", "x" * 49 + "\n and on", "\t tab \t", "\u00a0\u3000wide\u2003", "\n", " \u00a0 ", "", " plain "]
    turns = [(i, t, x) for i, x in enumerate(odd) for t in (1, 3, 9)]
    path = folder(conversations=(turns, "conv_id long, turn long, text string"))
    assert sorted(map(tuple, queries.truncation_notice(spark, path).collect())) == of_sql(path, "truncation_notice", "conversations")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quotations_are_looked_for_once_a_row(spark, folder):
    path = folder(documents=(DOCS, "doc_id long, text string, lang string, source string"))
    # before, the filter had its own copy, and a form took four passes over the source
    assert plan(queries.unmatched_quotes(spark, path)).count("[^”]{6,}") == 1
    assert sorted(map(tuple, queries.unmatched_quotes(spark, path).collect())) == of_sql(path, "unmatched_quotes", "documents")


def test_quote_form_of_odd_texts(spark):
    def by_rule(t: str) -> str:
        t = re.sub("[^a-z0-9' ]+", " ", re.sub("[–—]|-{2,}", " ", t.lower().replace("‘", "'").replace("’", "'")))
        return re.sub(" +", " ", re.sub("(?<![a-z])'|'(?![a-z])", " ", t)).strip(" ")

    rng = random.Random(5)
    texts = ["", " ", "'", "''a''", "don’t", "‘tis said’ ", "a--b-c—d", "é'e 9'9 x'", *("".join(rng.choices("aZ9'’‘-– —.\né ", k=30)) for _ in range(400))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.quote_form(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == {t: by_rule(t) for t in texts}


def test_questions_are_read_twice_for_their_route(spark, folder):
    path = folder(conversations=(TURNS, "conv_id long, turn long, text string"))
    routed = queries.route_questions(spark, path)
    # once for those that may name a work, which are kept, and once for the rows that are given back
    assert plan(routed).count("parquet") == 1
    assert routed.count() == len(TURNS)


def test_neighbours_within_a_hot_label(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random(), rng.random()], 0 if i % 9 else i % 4 or None) for i in range(300)]
    rows += [(i, rows[i - 300][1], 0) for i in range(300, 320)]  # equally far
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")
    held = {r.vec_id: (r.embedding, r.label) for r in v.collect()}
    want = set()
    for q in (r.qid for r in asked.collect() if r.label is not None):
        d = sorted((round(sum((a - b) ** 2 for a, b in zip(x, held[q][0], strict=True)), 10), i) for i, (x, n) in held.items() if n == held[q][1])
        want |= {(q, held[q][1], i, rank) for rank, (_, i) in enumerate(d[:6], 1)}
    found = search.nearest(asked, v, 6, by=["label"], digits=10)
    assert {(r.qid, r.label, r.vec_id, r.rank) for r in found.collect()} == want
    # no task has all rows of a label: they are dealt to blocks
    few = search.ROWS_AT_ONCE
    try:
        search.ROWS_AT_ONCE = 40
        assert {(r.qid, r.label, r.vec_id, r.rank) for r in search.nearest(asked, v, 6, by=["label"], digits=10).collect()} == want
    finally:
        search.ROWS_AT_ONCE = few


def test_only_shingles_of_several_texts_are_put_in_order(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:50], "x"]), " ".join(f"own{i}" for i in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").withColumn("mode", F.lit(None).cast("string"))
    forms, index = dedup._indexed(df, ["mode"], 10, 0.6)
    # before, all shingles were gathered again by text
    gathered = plan(index).split("collect_list")[1]
    assert "Window" in gathered and "LeftOuter" not in gathered and "(df" in gathered
    # 41 shingles are shared; 10 and 1 of one text alone stand before them in the order: prefixes are 21 and 17 of 51 and 42
    assert {r.seq: r["count"] for r in index.groupBy("seq").count().collect()} == {0: 21 - 10, 1: 17 - 1}
    assert [(r.a, r.b, round(r.similarity, 6)) for r in dedup.near_pairs(df, ["mode"]).collect()] == [(0, 1, round(41 / 52, 6))]


def test_blocks_of_a_search_are_wide(spark, monkeypatch):
    class Met(Exception):
        pass

    def met(questions, rows, by, blocks):
        raise Met(*blocks)

    monkeypatch.setattr(search, "grid", met)
    none = {c: F.lit(None).cast("string") for c in ("author_key", "scope", "chapter", "qvec", "page_content", "embedding", *search.CHUNK_KEY)}
    none |= {c: F.array().cast("array<string>") for c in ("work_titles", "only_works", "entity_terms", "topic_groups", "variants")}
    many = lambda n: spark.range(n).withColumns({**none, "embedding": F.lit(1)}).withColumns({"qid": F.col("id"), "top_k": F.lit(5)})
    with pytest.raises(Met) as blocks:
        search._channels(many(134_000), many(1_000_000))
    # before, 67 and 250: each chunk and its text was sent 67 times
    asked, held = blocks.value.args
    assert asked <= 5 and held <= 16
    # few are still enough for all cores
    assert search.wide_blocks_of(spark.range(5000), spark.range(40_000))[1] >= min(10, spark.sparkContext.defaultParallelism)


def test_a_block_lists_what_pairs_would(monkeypatch):
    rng = np.random.default_rng(4)
    n, m = 400, 90
    x = rng.random((n, 6)).astype(np.float32)
    x[50:90] = x[50]  # equally far
    keys = [("a", "literature", f"w{i % 4}", None if i % 7 == 0 else f"c{i % 3}", 1 + i % 2, i) for i in range(n)]
    texts = ["".join(rng.choice(list("abc"), 4)) if i % 9 else None for i in range(n)]
    asked = [
        {
            "qid": j, "scope": ["oeuvre", "specific_work"][j % 2], "work_titles": [f"w{j % 4}", f"w{j // 2 % 4}"][: 1 + j % 3 // 2] if j % 2 else None, "only_works": ["w1", "w2"] if j % 5 == 0 else None,
            "chapters": ["c1", "c2"] if j % 7 == 0 else None, "top_k": 5 + j % 4, "entity_terms": ["ab", "ca"] if j % 3 else None, "topic_groups": [["bc"], ["aa", "cc"]] if j % 6 == 1 else None, "variants": ["cb", "zz", ""] if j % 4 else [],
        }
        for j in range(m)
    ]
    q = np.concatenate([rng.random((m - 1, 6)), [x[50]]])

    def pairs():
        for r, v in zip(asked, q.astype(np.float32), strict=True):
            titles, named = r["work_titles"] or [], r["scope"] == "specific_work"
            fit = [i for i, k in enumerate(keys) if (not named or k[2] in titles) and (r["only_works"] is None or k[2] in r["only_works"]) and (r["chapters"] is None or k[3] in r["chapters"])]
            d = np.round(((x.astype(float) - v) ** 2).sum(1), 12)
            has = lambda terms, i: any(t and t in (texts[i] or "") for t in terms or [])
            tiers = [0 if not r["topic_groups"] or not has(r["topic_groups"][0], i) else -1 if not has(r["topic_groups"][1], i) else -2 for i in range(n)]
            lists = [(4, 0, fit, r["top_k"], False)]
            if named and len(titles) > 1:
                lists = [(4, p + 1, [i for i in fit if keys[i][2] == t], max(2, -(-r["top_k"] // 2)), False) for p, t in enumerate(titles) if t not in titles[:p]]
            lists += [(1, 0, [i for i in fit if has(r["entity_terms"], i)], 8, True), (2, 0, [i for i in fit if has(r["variants"], i)], 6, False)]
            for channel, pos, some, k, tiered in lists:
                for i in sorted(some, key=lambda i: (tiers[i] if tiered else 0, d[i], keys[i][2], keys[i][3] or "", keys[i][4:]))[:k]:  # noqa: B023
                    yield r["qid"], channel, pos, tiers[i] if tiered else 0, d[i], keys[i][5]

    texts_of = pa.list_(pa.string())
    kinds = {"qid": pa.int64(), "scope": pa.string(), "top_k": pa.int32(), "topic_groups": pa.list_(texts_of)}
    questions = pa.table({c: pa.array([r[c] for r in asked], kinds.get(c, texts_of)) for c in asked[0]} | {"qvec": pa.array(q.astype(np.float32).tolist(), pa.list_(pa.float32()))})
    rows = pa.table({c: pa.array([k[i] for k in keys]) for i, c in enumerate(search.CHUNK_KEY)} | {"page_content": pa.array(texts), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))})
    want = sorted(pairs())
    for tile, head, some in ((256, 8192, 1 << 14), (32, 50, 64)):
        monkeypatch.setattr(search, "TILE", tile), monkeypatch.setattr(search, "HEAD", head), monkeypatch.setattr(search, "PAIRS", some)
        got = search._block_channels(questions, rows)
        assert sorted(zip(*(got.column(c).to_pylist() for c in ("qid", "channel", "title_pos", "tier", "distance", "chunk_index")), strict=True)) == want
