"""Words, titles and triggers met by joins, against comparing everything with everything."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import routing

TITLE = "author_key string, author_display string, mode string, work_title string, source_id int, aliases array<string>, priority int"


def slipped(rng: random.Random, word: str) -> str:
    """word with some letters lost, doubled, changed or swapped."""
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(word) or 1)
        word = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("aeinrst") + word[i:], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :], word[:i] + rng.choice("abc") + word[i + 1 :]])
    return word


def lexicon(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("aeinrstlo") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8, 9, 11, 14, 21]))) for _ in range(n)]


def test_no_pair_of_alike_words_is_lost(spark):
    rng = random.Random(3)
    known = lexicon(rng, 300)
    asked = [slipped(rng, rng.choice(known)) for _ in range(1500)] + lexicon(rng, 300) + ["", "a" * 200, "ab" * 150]
    known += ["a" * 190, "ab" * 145, "", "42"]
    got = routing.alike_words(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w,) for w in known], "known string"))
    want = {(a, k) for a in set(asked) for k in set(known) if a and k and routing.alike(a, k)}
    rows = [(r.word, r.known) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert sum(a != k for a, k in want) > 300


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=3, max_size=24), st.data())
def test_a_stretch_is_always_left(word, data):
    """What `alike_words` stands on: of s + 1 stretches of a word one is in any other word of that ratio, moved by s at most."""
    other = list(word)
    for _ in range(data.draw(st.integers(0, 4))):
        i = data.draw(st.integers(0, len(other)))
        if data.draw(st.booleans()) and i < len(other):
            del other[i]
        else:
            other.insert(i, data.draw(st.sampled_from("abc")))
    other = "".join(other)
    if len(other) >= 3 and routing.alike(other, word):
        s = int((len(word) + len(other)) * (1 - routing.MIN_RATIO) + 1e-9)
        edges = [i * len(word) // (s + 1) for i in range(s + 2)]
        assert any(word[a:b] and word[a:b] in other[max(0, a - s) : b + s] for a, b in zip(edges, edges[1:], strict=False))


def plain(text: str) -> str:
    return re.sub("[^a-z0-9 ]", "", text.lower()).strip()


@pytest.fixture(scope="module")
def library(spark):
    """Invented titles and questions that name some, with slips."""
    rng = random.Random(11)
    words = lexicon(rng, 400) + ["the", "of", "and", "life", "life", "12"]
    rows = []
    for i in range(1500):
        title = " ".join(rng.choices(words, k=rng.randint(1, 5))).title()
        aliases = [" ".join(rng.choices(words, k=2))] if i % 7 == 0 else ["", "!?"] if i % 7 == 1 else None
        rows.append((f"a{i % 3}", "A", "literature" if i % 5 else "life_process", title, i, aliases, i))
    asked = []
    for i in range(400):
        said = [slipped(rng, w) for w in rng.choice(rows)[3].lower().split()] if i % 3 else rng.choice(rows)[3].split()
        asked.append((i, " ".join([*rng.choices(words, k=rng.randint(0, 6)), *said, *rng.choices(words, k=2)]) + "?", f"a{i % 3}", "literature"))
    asked += [(900, "", "a0", "literature"), (901, None, "a1", "literature"), (902, "life life life", "a2", "literature"), (903, "x", None, "literature")]
    return rows, asked, spark.createDataFrame(rows, TITLE), spark.createDataFrame(asked, "qid long, question string, author_key string, mode string")


def test_titles_are_those_of_comparing_all(library):
    rows, asked, works, questions = library
    want = {}
    for qid, question, author, _ in asked:
        titles = [r[3] for r in rows if r[0] == author and r[2] == "literature" and any(plain(p) and f" {plain(p)} " in f" {plain(question or '')} " for p in [r[3], *(r[5] or [])])]
        if titles:
            want[qid] = titles
    assert {r.qid: r.titles for r in routing.named_works(questions, works).collect()} == want and len(want) > 100


def test_likely_works_are_those_of_comparing_all(library):
    rows, asked, works, questions = library
    content = {r[6]: [w for w in plain(r[3]).split() if w not in routing.TITLE_STOPWORDS and not w.isdigit()] for r in rows}
    want = {}
    for qid, question, author, _ in asked:
        said, best = set(plain(question or "").split()), None
        for r in rows:
            own = content[r[6]]
            if r[0] == author and r[2] == "literature" and len(own) >= routing.MIN_HITS:
                hits = sum(any(routing.alike(x, w) for x in said) for w in own)
                if hits >= routing.MIN_HITS and hits / len(own) >= routing.MIN_FRACTION and (best is None or hits / len(own) > best[1]):
                    best = r[3], hits / len(own)
        if best:
            want[qid] = best
    got = {r.qid: (r.title, r.fraction) for r in routing.likely_work(questions, works).collect()}
    assert got == {q: (t, pytest.approx(f)) for q, (t, f) in want.items()} and len(want) > 60


def test_triggers_are_those_of_comparing_all(spark):
    rng = random.Random(5)
    triggers = ["wife", "mrs. clemens", "o'neil's", "été", "愛", "?!", "jumping frog", "x_y", "42", "Nell", "frog"]
    groups = [("a", i, rng.choice([None, "literature", "life_process"]), "entity", f"g{i}", rng.sample(triggers, 3), [f"t{i}"]) for i in range(25)]
    texts = ["My WIFE and Mrs. Clemens", "midwife", "an été of 愛愛, is it?!", "the jumping frogs", "a Jumping Frog", "x_y z", "_nell", "nell_", "O'Neil's 42", "x 愛", None, "", "?!"]
    asked = [(i, t, "a", s) for i, (t, s) in enumerate((t, s) for t in texts for s in ("life_process", "oeuvre"))]
    questions = spark.createDataFrame(asked, "qid long, question string, author_key string, scope string")
    table = spark.createDataFrame(groups, "author_key string, pos int, mode string, role string, name string, triggers array<string>, terms array<string>")
    every = questions.select("qid", "scope", F.lower("question").alias("l")).crossJoin(table)
    mode = F.when(F.col("scope") == "life_process", "life_process").otherwise("literature")
    want = every.where((F.col("mode").isNull() | (F.col("mode") == mode)) & routing.has_trigger(F.col("l"), F.col("triggers")))
    key = lambda df: sorted((r.qid, r.pos, r.role, r.name, tuple(r.terms)) for r in df.collect())
    assert key(routing.triggered_groups(questions, table)) == key(want) != []


def test_no_question_meets_all_titles(library, monkeypatch):
    """Candidates of the title join are few, and all words of a title are never joined with all questions."""
    _, _, works, questions = library
    seen, keep = [], routing.met_by_anchor
    monkeypatch.setattr(routing, "met_by_anchor", lambda a, p: seen.append(keep(a, p)) or seen[-1])
    routing.named_works(questions, works).collect()
    assert seen[0].count() < 0.05 * questions.count() * works.count() / 3
    plan = routing.likely_work(questions, works)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
