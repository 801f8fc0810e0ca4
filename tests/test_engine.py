"""Operators on small inline cases."""

import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answers, chunks, dedup, routing, search, sections
from lectern.plans import jobs, views
from lectern.sources import catalog as cat
from lectern.sources import conversations, files

CATALOG = {
    "authors": {
        "mt": {
            "display_name": "Mark T",
            "literature": [
                {"title": "The Adventures of Tom Sawyer", "gutenberg_id": 74, "aliases": ["Tom Sawyer"]},
                {"title": "Adventures of Huckleberry Finn", "gutenberg_id": 76, "aliases": ["Huckleberry Finn", "Huck Finn"]},
                {"title": "The Prince and the Pauper", "gutenberg_id": 1837, "aliases": ["Prince and Pauper"]},
            ],
            "life_process": [{"title": "Letters, Volume 4 (1886-1900)", "gutenberg_id": 1}, {"title": "Letters, Volume 5 (1901-1906)", "gutenberg_id": 2}],
            "retrieval_aliases": [
                {"mode": "life_process", "role": "entity", "name": "wife", "triggers": ["wife", "mrs. clemens"], "terms": ["Livy", "Olivia", "my wife", "Livy"]},
                {"mode": "life_process", "role": "topic", "name": "death", "triggers": ["death", "died"], "terms": ["died", "death"]},
                {"mode": "life_process", "role": "topic", "name": "feeling", "triggers": ["feel"], "terms": ["grief"]},
                {"mode": "literature", "role": "entity", "name": "frog", "triggers": ["jumping frog"], "terms": ["Smiley"]},
            ],
            "event_windows": [{"when": ["wife", "death"], "only_works": ["Letters, Volume 5 (1901-1906)"]}],
        }
    }
}
ASKED = [
    ("What works are available?", "literature"),
    ("What books appear on the table in Chapter XVII of Huckleberry Finn?", "literature"),
    ("How is Tom Sawyer related to Huckleberry Finn?", "literature"),
    ("Tell me about the jumping frog story", "literature"),
    ("How did he feel about the death of his wife?", "life_process"),
    ("What of death?", "life_process"),
    ("Who is huckelberry fin and what are his adventures?", "literature"),
    ("What happens in the last chapter of Tom Sawyer?", "literature"),
    ("", "literature"),
]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, q, "mt", m) for i, (q, m) in enumerate(ASKED)], "qid long, question string, author_key string, mode string")


@pytest.fixture(scope="module")
def tables(spark):
    return cat.works(spark, CATALOG), cat.alias_groups(spark, CATALOG), cat.event_windows(spark, CATALOG)


@pytest.mark.parametrize(("text", "want"), [("A -- b!", "a-b"), ("!!", "untitled"), ("", "untitled"), ("Tom's 2nd", "tom-s-2nd")])
def test_slugs(spark, text, want):
    assert one(spark, text, T.slugify) == want == files.slug(text)


def test_boilerplate(spark):
    s, e = "*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** end of this project gutenberg ebook X ***"
    assert one(spark, f"a {s}\n body \n{e} b", T.strip_boilerplate) == "body"
    assert one(spark, f" a {s} b ", T.strip_boilerplate) == f"a {s} b"
    assert one(spark, f"{e} x {s}", T.strip_boilerplate) == ""
    assert one(spark, "a \t\nb\n\n\n\n c \n", T.clean_text) == "a\nb\n\n c"
    assert one(spark, "a\r\nb\rc", T.unix_newlines) == "a\nb\nc"


def test_numerals(spark):
    got = spark.range(1, 200).select("id", T.roman_value(T.to_roman(F.col("id"))).alias("back")).collect()
    assert all(r.id == r.back for r in got)
    assert one(spark, "civil", T.roman_value) == 153 and one(spark, "abc", T.roman_value) is None and one(spark, "", T.roman_value) is None


@pytest.mark.parametrize(("a", "b", "same"), [("CHAPTER XVII.", "Chapter 17", True), ("CHAPTER THE LAST.", "Chapter the Last", True), ("ACT I", "SCENE I", False), ("NOTICE.", "PREFACE", False)])
def test_identities(spark, a, b, same):
    assert (one(spark, a, T.heading_identity) == one(spark, b, T.heading_identity)) is same


BOOK = "front\n\nCHAPTER I.\n\nbody one\nmore\n\nTHE JUMPING FROG\n\nstory\n\nFROM MY LIFE.--III.\nlife\n\nXLV. LETTERS, 1906\ndear\n\nCHAPTER V\n\n"


def test_sections(spark):
    df = spark.createDataFrame([("w", BOOK), ("v", " no heading \n"), ("e", "")], "work string, text string")
    got = {(r.work, r.section_title): r.text for r in sections.split_works(df).collect()}
    assert got == {("w", "CHAPTER I."): "body one\nmore", ("w", "THE JUMPING FROG"): "story", ("w", "FROM MY LIFE.--III."): "life", ("w", "XLV. LETTERS, 1906"): "dear", ("v", "Full text"): " no heading \n", ("e", "Full text"): ""}


def test_stubs(spark):
    rows = [("w", 0, "CHAPTER I.", "x" * 100), ("w", 1, "Chapter 1", "y" * 5000), ("w", 2, "NOTICE.", "short"), ("w", 3, "CHAPTER II", "z" * 399), ("w", 4, "Chapter 2", "z" * 1995), ("u", 0, "CHAPTER I.", "x")]
    df = spark.createDataFrame(rows, "work string, pos int, section_title string, text string")
    kept = sections.number_sections(sections.drop_stubs(df, ["work"]), ["work"])
    assert sorted((r.work, r.pos, r.section_index) for r in kept.collect()) == [("u", 0, 1), ("w", 1, 1), ("w", 2, 2), ("w", 3, 3), ("w", 4, 4)]


def words(n, seed):
    return random.Random(seed).choices([f"w{i}" for i in range(500)], k=n)


def test_duplicates_are_transitive(spark):
    a = words(200, 1)
    b = a[:170] + words(30, 2)
    c = b[40:] + words(40, 3)
    texts = [" ".join(a), " ".join(b), " ".join(c), " ".join(words(200, 4)), " ".join(a).upper() + "!!", "é ?", "--", "tiny text"]
    rows = [(i, "mt", "m", f"work{i}", f"s{i}", t, None if i != 1 else 0) for i, t in enumerate(texts)] + [(9, "mt", "other", "w", "s", texts[0], None)]
    df = spark.createDataFrame(rows, "seq long, author_key string, mode string, work_title string, section_title string, text string, priority int")
    by = ["author_key", "mode"]
    pairs = {(r.a, r.b): r.similarity for r in dedup.near_pairs(df, by).collect()}
    s = [{tuple(x.split()[i : i + 10]) for i in range(len(x.split()) - 9)} for x in texts[:3]]
    j = lambda x, y: len(s[x] & s[y]) / len(s[x] | s[y])
    assert pairs == {(x, y): pytest.approx(j(x, y)) for x, y in ((0, 1), (1, 2)) if j(x, y) >= 0.6} and j(0, 2) < 0.6
    comp = {r.seq: r.component for r in dedup.clusters(df, by).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 5, 6: 5, 7: 7, 9: 9}
    assert [r.seq for r in dedup.keep_first(df, by, F.col("priority")).collect()] == [1, 3, 5, 7, 9]
    report = {r.dropped_seq: (r.kept_seq, r.match_type, r.similarity) for r in dedup.report(df, by, F.col("priority")).collect()}
    assert report == {0: (1, "near", round(j(0, 1), 3)), 2: (1, "near", round(j(1, 2), 3)), 4: (1, "near", round(j(0, 1), 3)), 6: (5, "exact", 1.0)}
    again = dedup.keep_first(df, by, F.col("priority"))
    assert dedup.keep_first(again, by, F.col("priority")).count() == 5


def test_components_of_many_near_copies(spark, monkeypatch):
    rng, base = random.Random(7), words(120, 8)
    texts = [" ".join(base[:60] + words(2, i) + base[60:]) for i in range(40)]  # one group of near copies
    chain = words(150, 9)
    for i in range(12):  # each is near the one before alone
        texts.append(" ".join(chain))
        chain = chain[25:] + words(25, 100 + i)
    texts += [" ".join(words(120, 200 + i)) for i in range(10)]
    rng.shuffle(texts)
    rows = [(i, "m" if i % 9 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "seq long, mode string, text string")
    pairs = [(r.a, r.b) for r in dedup.near_pairs(df, ["mode"]).collect()]
    least = {i: i for pair in pairs for i in pair}
    for _ in range(len(least)):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    compared, keep = [], dedup.similar
    monkeypatch.setattr(dedup, "similar", lambda p, f, t: compared.append(p.count()) or keep(p, f, t))
    got = {r.id: r.component for r in dedup.near_components(df, ["mode"]).collect()}
    assert got == least and Counter(got.values()) == {2: 34, 1: 12, 0: 6}  # a null group is a group
    assert sum(compared) < len(pairs) / 3
    assert dedup.near_components(df.where("seq < 0"), ["mode"]).count() == 0


@given(st.text(alphabet="ab. \n", max_size=400))
@settings(max_examples=200, deadline=None)
def test_chunks(text):
    cut = chunks.chunk_text(text, 40, 10)
    assert all(0 < len(c) <= 40 and c in text for c in cut)
    assert not set("".join(text.split())) - set("".join(cut))


def test_chunks_overlap():
    text = ". ".join(f"sentence number {i} of the text" for i in range(60))
    cut = chunks.chunk_text(text, 200, 60)
    assert all(b.split(" ")[3] in a for a, b in zip(cut, cut[1:], strict=False))
    at = 0
    for c in cut:
        found = text.find(c, max(0, at - 61))
        assert 0 <= found <= at + 2
        at = found + len(c)
    assert at == len(text)


def test_understanding(spark, asked, tables):
    got = {r.qid: r for r in routing.understand(asked, *tables).collect()}
    assert [got[i].scope for i in range(9)] == ["meta", "specific_work", "specific_work", "oeuvre", "life_process", "life_process", "specific_work", "specific_work", "oeuvre"]
    assert got[1].chapter == "XVII" and got[1].work_titles == ["Adventures of Huckleberry Finn"]
    assert got[2].work_titles == ["The Adventures of Tom Sawyer", "Adventures of Huckleberry Finn"] and got[2].chapter is None
    assert got[2].work_title == "The Adventures of Tom Sawyer + Adventures of Huckleberry Finn"
    assert got[3].entity_terms == ["Smiley"] and got[3].topic_groups == []
    assert got[4].entity_terms == ["Livy", "Olivia", "my wife"] and got[4].topic_groups == [["died", "death"], ["grief"]]
    assert got[4].only_works == ["Letters, Volume 5 (1901-1906)"] and got[5].entity_terms is None and got[5].only_works is None
    assert got[6].work_titles == ["Adventures of Huckleberry Finn"] and got[7].chapter == "THE LAST"


@pytest.mark.parametrize(("question", "label"), [("chapter 17", "XVII"), ("the final chapter", "THE LAST"), ("chapter civil", None), ("chapter 0", None), ("chapter 200", None), ("Chapter iv!", "IV"), ("no", None)])
def test_chapters(spark, question, label):
    assert one(spark, question, routing.parse_chapter) == label


def test_spellings(spark):
    assert len(one(spark, "XVII", routing.chapter_variants)) == 8 and len(one(spark, "THE LAST", routing.chapter_variants)) == 12
    assert routing.alike("huckelberry", "huckleberry") and routing.alike("fin", "finn") and not routing.alike("fi", "finn")


IGNORE = {"mark", "tom", "sawyer", "the", "adventures", "of", "huckleberry", "finn"}


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("Who is the Model Boy in The Adventures of Tom Sawyer?", ["Model Boy"]), ("Tom Sawyer's Aunt Polly", ["Aunt Polly"]), ("Did Jim say “go down the river” to Huck?", ["go down the river", "Jim", "Huck"]),
        ("What of Chapter One and USA?", []), ("Is Jim  Smith Jim smith?", ["Smith Jim", "Jim"]), ("", []), ("'Ann Lee' Bob Cox Dan Fox's, Eve Gum Hal", ["Ann Lee' Bob Cox Dan Fox", "Eve Gum Hal"]),
    ],
)
def test_key_phrases(question, want):
    assert routing.key_phrases(question, IGNORE) == want


def test_variants(spark):
    got = spark.createDataFrame([(["O'Neil"],), ([],)], "p array<string>").select(routing.phrase_variants("p").alias("v")).collect()
    assert got[0].v == ["O'Neil", "O’Neil", "o'neil", "o’neil", "O'NEIL", "O’NEIL"] and got[1].v == []


def test_nearest(spark):
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(5)]) for i in range(300)] + [(300 + i, [0.5] * 5) for i in range(6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    got = search.nearest(spark.createDataFrame([(1, [0.5] * 5), (2, [0.1] * 5)], "qid long, qvec array<double>"), v, 4).orderBy("qid", "rank").collect()
    assert [r.vec_id for r in got[:4]] == [300, 301, 302, 303]
    best = sorted((sum((x - 0.1) ** 2 for x in e), i) for i, e in ((r.vec_id, r.embedding) for r in v.collect()))[:4]
    assert [r.vec_id for r in got[4:]] == [i for _, i in best]


def test_gate(spark):
    hits = spark.createDataFrame([(1, 1.3, False), (1, 1.31, False), (1, 2.0, True), (1, 2.01, True)], "qid long, distance double, via_alias boolean")
    kept = hits.where(search.relevant(F.col("distance"), F.lit(False), F.col("via_alias")))
    assert sorted(r.distance for r in kept.collect()) == [1.3, 2.0]


def test_redaction(spark):
    text = 'Bad words, BAD, badly: "a bad quote" and “bad\nbad” then bad.'
    want = '[restricted term omitted] words, [restricted term omitted], badly: "a bad quote" and “bad\nbad” then [restricted term omitted].'
    assert one(spark, text, lambda c: answers.redact(c, ["bad", "", "REPLACE_WITH_YOUR_TERM"])) == want
    assert one(spark, text, lambda c: answers.redact(c, [])) == text


def test_quotes(spark):
    seen = "they were holding the oxygen pipe — so they’d said. Once upon a time."
    cases = {
        '"we were holding the oxygen pipe"': ["we were holding the oxygen pipe"], '"THEY were holding the oxygen pipe - so"': [], '"they were ... the oxygen pipe"': [], '"oxygen tank"': [], "“once upon [a] tide”": [],
        "“once upon a tide”": ["once upon a tide"], '"they\'d said once upon"': [], "none": [],
    }
    df = spark.createDataFrame([(a, seen) for a in cases], "a string, s string").select("a", answers.unmatched_quotes(F.col("a"), F.col("s")).alias("q"))
    assert {r.a: r.q for r in df.collect()} == cases
    note = spark.range(1).select(answers.quote_note(F.array(*[F.lit(f"{i} " * 100) for i in range(5)])).alias("n"), answers.quote_note(F.array().cast("array<string>")).alias("none")).first()
    assert note.n.count("“") == 3 and "(and 2 more)" in note.n and note.none == ""


def test_notices(spark):
    df = spark.createDataFrame([("some", "MAX_TOKENS"), (" ", "length"), ("x", "stop"), ("x", None)], "t string, f string")
    got = [r.y for r in df.select(answers.with_notice(F.col("t"), F.col("f")).alias("y")).collect()]
    assert got == ["some" + answers.CUT_OFF, answers.NOTHING_WRITTEN + answers.CUT_OFF, "x", "x"]


def test_from_raw_files_to_answers(spark, asked, tables, tmp_path):
    works = tables[0]
    texts = {74: "the quick aunt paints a white fence by the river. " * 30, 76: "a raft drifts down a wide river at night. " * 40, 1837: "a prince and a pauper change their clothes. " * 30, 1: "my wife Livy wrote a letter. " * 20, 2: "Livy died and the grief was long. " * 20}
    get = lambda url: f"Title: {url[-6:]}\r\n*** START OF THE PROJECT GUTENBERG EBOOK ***\r\nCHAPTER I.\r\n\r\n\r\n{texts[int(url.split('/pg')[1][:-4])]}\r\nCHAPTER XVII.\r\n{texts[int(url.split('/pg')[1][:-4])][:400]}more\r\n*** END OF THE PROJECT GUTENBERG EBOOK ***"
    listed = [(a, m, t, i) for m in cat.MODES for a, _, t, i in cat.iter_works(CATALOG, m)]
    assert len(files.download(listed, str(tmp_path / "raw"), get, 0)) == 5 and not files.download(listed, str(tmp_path / "raw"), get, 0)
    raw = files.read_raw(spark, str(tmp_path / "raw"))
    assert jobs.header_check(raw, works).where("differs").count() == 5
    found = jobs.build_sections(raw, works)
    assert found.count() == 10 and {r.section_title for r in found.collect()} == {"CHAPTER I.", "CHAPTER XVII."}
    files.write_jsonl(found, str(tmp_path / "sections"))
    assert files.read_jsonl(spark, str(tmp_path / "sections")).count() == 10
    index, _ = jobs.build_index(found)
    files.write_vectors(index, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert jobs.counts(index).count() == 5
    notes = {"mt": "Livy was his wife."}
    got = {r.qid: r for r in jobs.answer(asked, *tables, index, notes=notes).collect()}
    assert len(got) == len(ASKED)
    assert got[0].grounded and "* The Prince and the Pauper" in got[0].answer and got[0].sources is None
    assert got[1].grounded and {s.section_title for s in got[1].sources} == {"CHAPTER XVII."} and got[1].chapter == "XVII"
    assert {s.work_title for s in got[2].sources} == {"The Adventures of Tom Sawyer", "Adventures of Huckleberry Finn"}
    assert {s.work_title for s in got[4].sources} == {"Letters, Volume 5 (1901-1906)"}
    assert got[7].chapter is None  # no such heading: the restriction is dropped
    assert not got[8].grounded and got[8].answer == answers.NO_CONTEXT
    assert "Quotation check" not in got[1].answer
    wrong = jobs.answer(asked.where("qid = 1"), *tables, index, model=lambda s, h: ("He said “this was never written there at all”.", "length")).first()
    assert "Quotation check" in wrong.answer and answers.CUT_OFF.strip() in wrong.answer


def test_conversations(spark):
    rows = spark.createDataFrame([(1, "t" * 100, "a", "m", "2024-01-01 00:00:00"), (2, "u", "a", "m", "2024-01-02 00:00:00")], "id long, title string, author_key string, mode string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    talks = conversations.new_conversations(rows)
    said = spark.createDataFrame([(7, 1, "user", "hi", "2024-01-03 00:00:00"), (8, 1, "assistant", "ho", "2024-01-04 00:00:00")], "id long, conversation_id long, role string, content string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    messages = conversations.new_messages(said)
    listed = conversations.list_conversations(talks, messages).collect()
    assert [(r.id, len(r.title)) for r in listed] == [(1, 80), (2, 1)] and str(listed[0].updated_at) == "2024-01-04 00:00:00"
    assert [(r.role, r.sources) for r in conversations.thread(messages, 1).collect()] == [("user", []), ("assistant", [])]
    left, rest = conversations.without(talks, messages, talks.where("id = 1"))
    assert left.count() == 1 and rest.count() == 0


def test_catalog_from_a_file(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(CATALOG))
    assert [w[2] for w in cat.iter_works(cat.load(str(path)), "life_process")] == ["Letters, Volume 4 (1886-1900)", "Letters, Volume 5 (1901-1906)"]


def test_stream_of_texts_is_cleaned(spark, tmp_path):
    from lectern.streaming import clean_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a \r\nb\r\n\r\n\r\n\r\n")
    q = clean_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.text for r in spark.sql("SELECT text FROM cleaned").collect()] == ["a\nb"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "catalog.json").write_text(json.dumps(CATALOG))
    sections = spark.createDataFrame([(1, "mt", "Mark T", "literature", "The Adventures of Tom Sawyer", "CHAPTER I.", 1, "Tom painted the fence with a brush all day. " * 9, "ref", 0)], "seq long, author_key string, author_display string, mode string, work_title string, section_title string, section_index int, text string, source_ref string, priority int")
    files.write_vectors(jobs.build_index(sections)[0], str(tmp_path / "index"))
    jobs.main([str(tmp_path / "catalog.json"), str(tmp_path / "index"), "Who painted the fence in Tom Sawyer?", "--author", "mt", "--find", "brush"])
    out = capsys.readouterr().out
    assert "CHAPTER I." in out and "specific_work" in out and "brush" in out
    with pytest.raises(FileNotFoundError, match="build_index"):
        jobs.main([str(tmp_path / "catalog.json"), str(tmp_path / "none"), "x"])


A, B, C_ = "a" * 600, "b" * 300, "c" * 400
CHUNKS = {
    "": "", "  short \n": "short",
    # paragraphs first; two that fit go together, the separator before the second
    f"{A}\n\n{B}\n\n{C_}": f"{A}\n\n{B}|{C_}",
    # lines where a paragraph is too long
    f"{A}\n{C_}\n{B}": f"{A}|{C_}\n{B}",
    # a sentence of up to 150 characters is repeated at the start of the next chunk
    f"{A}. {'d' * 290}. {'e' * 90}. {C_}": f"{A}. {'d' * 290}. {'e' * 90}|. {'e' * 90}. {C_}",
    # words, then characters
    "f" * 2100: "|".join(["f" * 1000, "f" * 1000, "f" * 100]),
    f"{'g' * 999} hh": f"{'g' * 999}|hh",
}


@pytest.mark.parametrize(("text", "want"), CHUNKS.items())
def test_chunk_cases(text, want):
    assert "|".join(chunks.chunk_text(text)) == want


PHRASES = {
    "Did Captain Orlo Vane meet Nell?": "Captain Orlo Vane|Nell", "what of the Lantern Keeper": "", "Who saw Orlo's ship?": "Orlo",
    'She said "cold iron gate" twice': "cold iron gate|She", "Tell me of Mary Ann and Mary Ann": "Mary Ann", "In chapter IV of Glass": "", "NASA and Bo X": "",
}


def test_key_phrase_cases(spark):
    ignore = {r.author_key: set(r.ignore) for r in routing.ignore_words(views.works(spark)).collect()}["ada"]
    assert {q: "|".join(routing.key_phrases(q, ignore)) for q in PHRASES} == PHRASES


SLIPS = {
    "the harbor of brokn glas": "Harbour of Broken Glass", "lantren keepr": "The Lantern Keeper", "lantern": None, "broken glas and lanterns keeper": "The Lantern Keeper",
    "a kept light": None, "glass harbours": "Harbour of Broken Glass",
}


def test_slip_cases(spark):
    given = spark.createDataFrame([(i, q, "ada") for i, q in enumerate(SLIPS)], "qid long, question string, author_key string")
    got = {r.qid: r.title for r in routing.likely_work(given, views.works(spark)).collect()}
    assert got == {i: t for i, t in enumerate(SLIPS.values()) if t}
