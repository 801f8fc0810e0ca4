"""Operators on copies, lines, passages and near copies, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, line_dedup, minhash, repeats, substring_dedup, suffix_dedup
from lectern.llm.components import components
from lectern.llm.repeats import common
from lectern.llm.suffix_dedup import merge_runs


def unique(rows):
    return sorted({(r[0], (r[1] or "")) for r in rows}, key=lambda r: (r[0], r[1].encode()))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(docs, empty, rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    pick = min if keep == "smallest" else max
    want = Counter((r[0], pick(g := groups[r[1] or ""]), len(g), r[0] == pick(g), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter(tuple(x) for x in exact_dedup.exact_groups(docs, keep=keep).collect()) == want
    left = exact_dedup.drop_copies(docs, keep=keep)
    assert left.columns == docs.columns
    assert sorted((x.doc_id, x.text or "") for x in left.collect()) == sorted((pick(g), t) for t, g in groups.items())
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.drop_copies(empty).count() == 0


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    """Texts with one content hash are compared byte by byte."""
    monkeypatch.setattr(exact_dedup, "content_hash", lambda body: F.lit(b"same").cast("binary"))
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, None)], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1), (4, 4, 1)}
    assert {r.doc_id for r in exact_dedup.drop_copies(df).collect()} == {1, 2, 4}


@pytest.mark.parametrize("hot", [1, 6, 1000])  # no key, some keys, all keys joined by broadcast
def test_lines(docs, empty, rows, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r[0])
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and max(holders[key(x)]) != r[0])]
        want[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert Counter(tuple(x) for x in line_dedup.dedup_lines(docs).collect()) == want
    assert any(k[2] for k in want)
    assert line_dedup.dedup_lines(empty).count() == 0


def brute(units_of, window, rows):
    """(id, text) -> covered flags of its units."""
    seen, out = set(), {}
    for i, text in unique(rows):
        u = units_of(text)
        cover = [False] * len(u)
        for p in range(len(u) - window + 1):
            w = tuple(u[p : p + window])
            if w in seen:
                cover[p : p + window] = [True] * window
            seen.add(w)
        out[i, text] = (u, cover)
    return out


def test_names_of_blocks(spark):
    x = [0, 1, -1, 41, 2**40 + 3, -(2**62)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in x], "i long").select(F.hash("i")).collect()]
    assert repeats.murmur(np.array(x)).tolist() == got
    assert sorted(repeats.murmur(np.array(repeats._block_names(211))) % 211) == list(range(211))


@pytest.mark.parametrize("hot", [0, 2])
def test_hot_anchors_go_window_by_window(spark, monkeypatch, hot):
    """One passage in every document, between ever other neighbours."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 60)
    monkeypatch.setattr(repeats, "CHUNK_BITS", 9)
    rng = np.random.default_rng(4)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 7))) for _ in range(n))
    passage = some(40)
    rows = [(i, f"{some(rng.integers(0, 30))} {passage} {some(rng.integers(0, 30))}" if i % 5 else some(40)) for i in range(80)]
    rows += [(200, rows[1][1]), (3, "other " + passage), (3, "other " + passage), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for units_of, window, out in ((lambda t: t.encode(), 100, suffix_dedup.remove_repeated_bytes(docs)), (lambda t: t.encode().split(), 20, substring_dedup.remove_repeated_words(docs))):
        want = brute(units_of, window, rows)
        expected = Counter()
        for i, t in rows:
            u, cover = want[i, t or ""]
            left = [x for x, c in zip(u, cover, strict=True) if not c]
            expected[i, len(u), sum(cover), bytes(left) if window == 100 else b" ".join(left)] += 1
        assert Counter((x.doc_id, x.n_units, x.n_removed, bytes(x.kept_text)) for x in out.collect()) == expected


def test_targets_are_ranges_of_suffixes():
    spec = repeats.Spec(False, 100, 24, 4, 1, (b"b", b"m", b"mm"))
    body = [bytes(c) * 1 for c in ([97] * 30, [98] * 30, [109] * 30, [122] * 30)]
    assert [spec.target(x, 0, 0, False) for x in body] == [0, 1, 3, 3]
    assert sorted(body) == sorted(body, key=lambda x: (spec.target(x, 0, 0, False), x))


def test_repeated_bytes(docs, empty, rows):
    want = brute(lambda t: t.encode(), 100, rows)
    got = suffix_dedup.remove_repeated_bytes(docs).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for r in rows:
        u, cover = want[r[0], r[1] or ""]
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        expected[r[0], len(u), sum(cover), spans, bytes(x for x, c in zip(u, cover, strict=True) if not c)] += 1
    assert Counter((x.doc_id, x.n_units, x.n_removed, x.n_spans, bytes(x.kept_text)) for x in got) == expected
    assert sum(x.n_removed for x in got)
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_repeated_words(docs, empty, rows):
    want = brute(lambda t: t.encode().split(), 20, rows)
    got = substring_dedup.remove_repeated_words(docs).collect()
    expected = Counter()
    for r in rows:
        u, cover = want[r[0], r[1] or ""]
        expected[r[0], len(u), sum(cover), b" ".join(x for x, c in zip(u, cover, strict=True) if not c)] += 1
    assert Counter((x.doc_id, x.n_units, x.n_removed, bytes(x.kept_text)) for x in got) == expected
    assert sum(x.n_removed for x in got)
    assert substring_dedup.remove_repeated_words(empty).count() == 0


@given(st.lists(st.lists(st.text("ab\x00", max_size=6), max_size=8), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_loser_tree(lists):
    runs = [sorted(x.encode() for x in r) for r in lists]
    shared = [[0, *map(common, r, r[1:])][: len(r)] for r in runs]
    run, place, know = merge_runs(runs, shared)
    merged = [runs[i][p] for i, p in zip(run, place, strict=True)]
    assert merged == sorted(x for r in runs for x in r)
    assert know == [0, *map(common, merged, merged[1:])][: len(merged)]


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=6), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_suffix_automaton(texts, window):
    a, starts, at = substring_dedup.SuffixAutomaton(), [], 0
    for t in texts:
        starts.append(at)
        a.add(t, at)
        at += len(t) + 1
    seen = set()
    for t, s in zip(texts, starts, strict=True):
        want = []
        for i in range(len(t) - window + 1):
            w = tuple(t[i : i + window])
            want += [i] if w in seen else []
            seen.add(w)
        assert a.repeats(t, s, window) == want


def tokens(text):
    return [x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


def test_near_duplicates(docs, empty, rows):
    ids = sorted({r[0] for r in rows})
    sets, df = defaultdict(list), Counter()
    for r in rows:
        w = tokens(r[1])
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        sets[r[0]].append({k: 1 + np.log(v) for k, v in c.items()})
        df.update(c.keys())
    for of_id in sets.values():
        for x in of_id:
            for k in x:
                x[k] *= minhash.idf_of(np.array(df[k]), len(rows), 0.5)
    # all that is shared weighs less
    assert all(minhash.idf_of(np.array(v), len(rows), 0.5) < 0.95 for v in df.values() if v > 1)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(a and b and (m := sum(min(v, b.get(k, 0)) for k, v in a.items())) >= 0.8 * (sum(a.values()) + sum(b.values()) - m) for a in sets[i] for b in sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = minhash.near_duplicate_classes(docs).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: x.class_id for x in got} == {i: root(i) for i in ids}
    assert len({root(i) for i in ids}) < len(ids)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {x.doc_id for x in left.collect()} == {root(i) for i in ids}
    assert minhash.near_duplicate_classes(empty).count() == 0


def test_document_frequencies(spark, docs, rows):
    """Exact while shingles are few; what other shingles put into cells is taken off where they are many."""
    df = Counter(g for r in rows for g in {tuple(w[i : i + 5]) for w in [tokens(r[1])] for i in range(len(w) - 4)})
    idf = minhash.inverse_frequencies(docs.select("text"), 5, 0.5)
    assert idf.n == len(rows)
    text = next(r[1] for r in rows if r[1] and len(tokens(r[1])) > 60)
    w = tokens(text)
    _, _, data, at = next(minhash.blocks(minhash.pa.array([text])))
    _, gram, _ = minhash.shingles(*minhash.words_of(data, at), 1, 5)
    want = sorted(minhash.idf_of(np.array(df[g]), len(rows), 0.5) for g in {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert np.allclose(np.sort(idf.of(gram)), want)
    assert minhash.idf_of(np.array([1, len(rows)]), len(rows), 0.5).tolist() == [1.0, 0.5]


def test_consistent_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(3)
    gram = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    for many in ([0.3, 1.0, 2.5], [0.5, 0.62, 0.8, 1.0, 1.7]):
        a, b = rng.choice(many, (2, len(gram)))
        b = np.where(rng.random(len(gram)) < 0.7, a, b)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        row = np.zeros(len(gram), int)
        s = [minhash.samples(row, gram, w, 2000)[1][0] for w in (a, b)]
        assert abs((s[0] == s[1]).mean() - want) < 0.05


def test_sweep_links_neighbours_of_a_hot_bucket(spark):
    buckets = spark.createDataFrame([(k, v, v // 2) for k, n in ((1, 3000), (2, 3), (3, 70), (4, 1)) for v in range(n)], "key long, v long, c long")
    pairs, members = minhash.sweep(buckets, F.col("v"), 3)
    got = {(r.a, r.b) for r in pairs.collect()}
    want = {(v - d, v) for v in range(3000) for d in (1, 2, 3) if v >= d and v // 2 != (v - d) // 2}
    # but for those that the bounds of ranges part
    assert got <= want and len(want - got) <= 6 * 4
    assert {(r.key, r.v) for r in members.collect()} >= {(k, v) for k, n in ((1, 3000), (2, 3), (3, 70)) for v in range(n)}


def test_prefix_filter_loses_no_pair(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, 60)] = f"n{rng.integers(0, 6)}"
        texts.append((i, i, " ".join(w)))
    df = spark.createDataFrame(texts, "v long, c long, text string")
    idf = minhash.Idf(60, np.ones((minhash.DF_ROWS, minhash.DF_CELLS), np.float32), 0.5)
    got = {(r.a, r.b) for r in minhash.prefix_pairs(df, 5, 0.8, idf).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, _, t in texts]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want and want <= got


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 30), (31, 40), (50, 50), (None, 3)]
    got = {(r.id, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(21)} | {(30, 30), (31, 30), (40, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
