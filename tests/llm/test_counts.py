"""The filter audit, packing and phrases against plain Python."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import filter_audit, packing, phrases

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Filter audit

LABELS = [(0, 1, 0), (3, 1, 1), (6, 0, 1), (6, 1, 0), (9, None, 1), (None, 1, 1), (500, 1, None), (777, 1, 1)]


def failures(rows: list[tuple]) -> list[str]:
    """The letters that each (id, text) fails, by the definition."""
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        out.append("".join(k for k, v in tests.items() if v))
    return out


def by_hand(rows: list[tuple], labels: list[tuple]) -> set[tuple]:
    """rows of (id, text, part): every order applied to every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = failures([r[:2] for r in rows])
    shapley = Counter()
    for (_, _, part), f in zip(rows, fails, strict=True):
        for order in permutations("ABCDE"):
            if hit := [c for c in order if c in f]:
                shapley[part or "", hit[0]] += 1
    out = set()
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            for step, c in enumerate(order):
                before = set(order[:step])
                gone = [(i, f) for i, f in own if c in f and not before & set(f)]
                kept = sum(not (before | {c}) & set(f) for _, f in own)
                late = sum(c in f and bool(before & set(f)) for _, f in own)
                out.add((part, "".join(order), step + 1, kept, len(gone), late, sum(f == c for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), shapley[part, c]))
    return out


def test_audit_by_hand(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    extra = [(700, "Word " * 300 + "#", "en", "a", 1, None, "x", None, 7, "b", 3, "p"), (None, rows[0][1], "en", "a", 1, None, "x", None, 7, "b", 3, "p"), (701, " ".join(f"w{i}" for i in range(250)), "en", "a", 1, None, "x", None, 7, "b", 3, "p")]
    got = filter_audit.audit(docs.union(spark.createDataFrame(extra, docs.schema)), labels)
    assert {tuple(r) for r in got.collect()} == by_hand([(r[0], r[1], r[2]) for r in [*rows, *extra]], LABELS)


def test_audit_of_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, lang string")
    got = filter_audit.audit(nulls, labels).collect()
    # none repeats another, as none has an id; an empty text has too few words and nothing else
    assert len(got) == 600 and {r.part for r in got} == {""}
    assert {(r.filter_order[r.step - 1], r.removed, r.shapley) for r in got} == {("A", 3, 360), *((c, 0, 0) for c in "BCDE")}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 10**12), min_size=32, max_size=32))
def test_inverse_is_exact(counts):
    signs = np.array([[-1 if (s & m).bit_count() % 2 else 1 for m in range(32)] for s in range(32)], object)
    sums = signs @ np.array(counts, object)
    assert [x >> 5 for x in signs @ sums] == counts


def test_parity_sums_and_cells(spark):
    rows = [("x", 0, 0, m) for m in range(32) for _ in range(m % 5)] + [("x", 1, 0, 7)] * 3 + [("y", 0, 1, 31)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, good int, toxic int, mask int"), ["part", "good", "toxic"])
    got = {r.part: r for r in filter_audit.cells(sums).collect()}
    assert got["x"]["all"] == [m % 5 + 3 * (m == 7) for m in range(32)] and got["x"]["good"] == [3 * (m == 7) for m in range(32)]
    assert sum(got["y"]["toxic"]) == got["y"]["toxic"][31] == 1 and not any(got["x"]["toxic"])


# Packing


def valid(got: list, texts: dict) -> int:
    """Checks pieces and places, gives the number of sequences."""
    library = Tokenizer.from_file(PATH)
    library.no_truncation(), library.no_padding()
    of, seq = defaultdict(list), defaultdict(list)
    for r in got:
        of[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        seq[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] += [(k, k * 2048, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(np.split(ids, range(2048, len(ids), 2048)))]
    assert {i: sorted(x) for i, x in of.items()} == {i: sorted(x) for i, x in want.items()}
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(seq)


def test_packing_places_every_token(docs, rows, empty):
    out = packing.pack(docs, PATH)
    n = valid(out.collect(), [(r[0], r[1]) for r in rows])
    lengths = [r.length for r in out.collect()]
    assert n == -(-sum(lengths) // 2048) or n <= sum(lengths) / 2048 * 1.02 + 1
    assert packing.pack(empty, PATH).count() == 0
    again = packing.pack(docs, PATH)
    key = lambda df: sorted((r.doc_id or -1, r.piece, r.sequence_id, r.offset) for r in df.collect())
    assert key(out) == key(again)


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (None, "a null id"), (2, "same id"), (3, "<|endoftext|> inside<|startoftext|>of it"), (4, "x" * 9000), (5, "l' été d́ja 中文 Ᲊ end"), (6, "tok " * 2047), (7, "tok " * 2048)]
    assert valid(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH).collect(), texts) <= 7


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB'tsé1 .\t\n\x1c\x85\xa0\u0130ß\u0301\u4e2d<|endoftx>", max_size=60), min_size=1, max_size=8))
def test_packed_ids_are_the_librarys(texts):
    library = Tokenizer.from_file(PATH)
    packed = packing.PackedIds(packing.bpe.load(PATH))
    for _ in range(2):  # the second time from what is remembered
        got = [np.frombuffer(x, "<u4").tolist() for x in packed(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        packed.bytes = packing.CACHE_BYTES + 1


def test_pairs_are_found_by_one_look():
    packed = packing.PackedIds(packing.bpe.load(PATH))
    coder, rng = packed.coder, np.random.default_rng(3)
    left = np.concatenate([coder.pair >> 20, rng.integers(-1, 49_408, 200_000), [-1, 0, -1]])
    right = np.concatenate([coder.pair & 0xFFFFF, rng.integers(-1, 49_408, 200_000), [0, -1, -1]])
    assert (packed.ranks(left, right) == coder.ranks(left, right)).all()
    # before, each look at a pair searched the sorted list of all
    looks, keep = [], coder.ranks
    coder.ranks = lambda a, b: looks.append(len(a)) or keep(a, b)
    try:
        packed.ranks(left, right)
    finally:
        del coder.ranks
    assert sum(looks) < len(left) // 10


def test_a_failed_batch_leaves_no_number_without_ids(monkeypatch):
    packed = packing.PackedIds(packing.bpe.load(PATH))
    want = packed(["a few words"])
    monkeypatch.setattr(packed, "merged", lambda words: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        packed(["and some more words"])
    monkeypatch.undo()
    assert packed(["a few words"]) == want and packed(["and some more words"]) == packing.PackedIds(packed.coder)(["and some more words"])


def exact_bins(lengths: list[int], size: int) -> int:
    """Fewest bins, by trying all ways."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def put(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in {f: j for j, f in enumerate(bins)}.values():
            if bins[b] + lengths[i] <= size:
                bins[b] += lengths[i]
                put(i + 1, bins)
                bins[b] -= lengths[i]
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best


def evolved(lengths: list[int], size: int, epochs: int = 3) -> int:
    x = np.sort(np.array(lengths))[::-1]
    island = packing.Island(x, size, 5)
    island.found()
    for _ in range(epochs):
        island.epoch()
    labels = island.all[0][2]
    assert np.bincount(labels, x).max() <= size and len(labels) == len(x)
    return island.all[0][0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_fewest_bins_of_few_pieces(lengths):
    assert evolved(lengths, 30) == exact_bins(lengths, 30)


def test_evolution_beats_best_fit():
    """Triples of one sum: longest first puts them together wrongly, crossover finds better groups."""
    rng = np.random.default_rng(8)
    plain, found = 0, 0
    for _ in range(6):
        a = rng.integers(380, 490, 40)
        b = rng.integers(270, 300, 40)
        lengths = np.concatenate([a, b, 1000 - a - b])
        labels, fills = np.zeros(120, np.int64), []
        packing.best_fit(np.argsort(-lengths, kind="stable").tolist(), lengths.tolist(), fills, labels, 1000)
        n = evolved(lengths.tolist(), 1000)
        plain, found = plain + len(fills), found + n
        assert 40 <= n < len(fills)
    assert plain - found >= 4 * 6 and found <= 41 * 6


def test_shards_and_rounds(spark, monkeypatch):
    """Many small shards: what each leaves open is packed again with the rest of others."""
    monkeypatch.setattr(packing, "SHARD", 64)
    rng = np.random.default_rng(3)
    rows = [(i, int(n)) for i, n in enumerate(np.concatenate([rng.integers(1, 600, 900), rng.integers(600, 2047, 300)]))]
    df = spark.createDataFrame(rows, "rid long, length long")
    got = packing.pack_pieces(df).collect()
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    assert sorted((r.rid, r.length) for r in got) == sorted(rows)
    for s, places in seq.items():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048 and s in {r.rid for r in got if r.sequence_id == s}
    assert len(seq) <= 1.03 * sum(n for _, n in rows) / 2048 + 1


# Phrases


def mined(rows: list[tuple], at_least: int = 10, inside: int = 50, best: int = 2000) -> list[tuple]:
    """rows of (text, lang), counted one by one."""
    total, f = Counter(), Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = defaultdict(list)
    for g, a in f.items():
        lang, *w = g
        if len(w) < 2 or a < at_least:
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if len(w) == 2 and any(len(h) == 4 and h[0] == lang and n >= at_least and 100 * n >= inside * a and (h[1:3] == g[1:] or h[2:4] == g[1:]) for h, n in f.items()):
            continue
        found[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:best]))


TEXTS = [
    *[(f"New York City! new york CITY, of {i % 3}\tthe new york times", "en") for i in range(12)], ("a a a a a a a a a a a a a", "en"), (None, "en"), ("", None), (" .,; ", "en"),
    *[("été à  la mer; l'été à la mer: " + "x" * (i % 2), None) for i in range(11)], *[("um und aus", "und") for _ in range(10)], *[("auf wieder sehen.\x0bauf wieder", "") for _ in range(10)], ("only once here", "de"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(*r, i, "n") for i, r in enumerate(TEXTS)], "text string, lang string, h long, phrase string").repartition(3)


def rows_of(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_by_hand(texts, docs, rows, empty):
    assert rows_of(phrases.mine(texts)) == mined(TEXTS)
    assert rows_of(phrases.mine(texts, at_least=2, best=3)) == mined(TEXTS, 2, best=3)
    assert rows_of(phrases.mine(docs, at_least=4)) == mined([(r[1], r[2]) for r in rows], 4)
    assert phrases.mine(empty).count() == 0


def test_small_slices_and_flushes_change_nothing(texts, monkeypatch):
    for name, value in (("FLUSH", 5), ("FLUSH_WORDS", 7), ("SLICE_BYTES", 200), ("MOST_BITS", 16), ("SALTS", 2)):
        monkeypatch.setattr(phrases, name, value)
    assert rows_of(phrases.mine(texts)) == mined(TEXTS)


def test_words_that_share_a_hash_are_seen(texts, monkeypatch):
    """Under the first seed all words of one length share a hash; another is drawn."""
    values = phrases._values
    monkeypatch.setattr(phrases, "_values", lambda seed: np.full(256, 3, np.uint64) if seed == 0 else values(seed))
    _, seed = phrases.word_counts(texts)
    assert seed == 1
    assert rows_of(phrases.mine(texts)) == mined(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 3), st.integers(1, 9)), min_size=1, max_size=60), min_size=1, max_size=9))
def test_slots_count_exactly(parts):
    arrays = [(np.array([[a, b] for a, b, _ in p], np.uint64).T, np.array([n for *_, n in p], np.uint32)) for p in parts]
    want = Counter()
    for p in parts:
        for a, b, n in p:
            want[a, b] += n
    keys, n = phrases.count_slots(arrays, 10)
    assert dict(zip(map(tuple, keys.T.tolist()), n.tolist(), strict=True)) == {k: v for k, v in want.items() if v >= 10}


def test_perfect_hash_knows_its_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, (3, 5000), dtype=np.uint64), axis=1)
    table = phrases.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(keys.shape[1]))
    other = keys.copy()
    other[2] ^= np.uint64(1)
    assert (table.slots(other) == -1).all()


def test_scores_beyond_64_bits(spark):
    a, left, right = 10**13 + 7, 3 * 10**13 + 1, 9 * 10**12 + 5
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(phrases.score("a", "l", "r").alias("s")).first().s == 1000000 * a * a // (left * right)


def test_hot_language_and_phrase(spark):
    rows = [("one hot phrase " * 40, "en") for _ in range(300)] + [(f"w{i} x{i} " * 10, "en") for i in range(50)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(9)
    got = phrases.mine(df, best=30)
    assert rows_of(got) == mined(rows, best=30) and got.agg(F.max("rank")).first()[0] == 30
