"""Language, mixing, archives, tokens, quality rules and the pipeline."""

import io
import json
import re
import zipfile
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe, language_id, mixing, quality, warc_zip
from lectern.llm.common import running

_library = lru_cache(Tokenizer.from_file)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language(docs, empty, rows):
    model = language_id.train(docs)
    assert model.langs == ["de", "en", "fr"]
    got = language_id.identify(docs, model, {"doc_id": F.col("doc_id"), "own": F.col("lang"), "t": F.col("text")}).collect()
    assert len(got) == len(rows)
    for x in got:
        lettered = bool(re.search(r"[^\W\d_]", x.t or ""))
        assert (x.lang_pred == "und") == (not lettered) and 0 <= x.score <= 1 and (lettered or x.rejected)
    none = language_id.train(empty)
    assert {x.lang_pred for x in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_bounds_joined_either_way_give_one_model(docs, monkeypatch):
    one = language_id.train(docs)
    monkeypatch.setattr(language_id, "BROADCAST_LANGUAGES", 0)
    other = language_id.train(docs)
    assert one.langs == other.langs and one.reject_below == other.reject_below and (one.centroids == other.centroids).all()


def test_nearest_centroid_by_hand(docs, rows):
    """Vectors and cosines by plain counting."""
    model = language_id.train(docs)
    assert len(model.of) > len(model.langs)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    for x in language_id.identify(docs, model, {"t": F.col("text"), "i": F.col("doc_id")}).collect():
        raw = (x.t or "").encode()
        low = bytearray(b | 32 if 65 <= b <= 90 else b if letter(b) else 32 for b in raw)
        for j in range(1, len(raw)):
            if raw[j - 1] == 0xC3 and 0x80 <= raw[j] <= 0x9E and raw[j] != 0x97:
                low[j] |= 32
        grams = Counter(bytes(low[j : j + 3]) for j in range(len(low) - 2))
        cell = Counter()
        for g, n in grams.items():
            if g[:2] != b"  ":
                cell[(int.from_bytes(g, "little") * 2654435761) % 2**32 >> 20] += n
        v = np.zeros(language_id.DIMENSIONS)
        for c, n in cell.items():
            v[c] = (1 + np.log(n)) * model.idf[c]
        cosines = model.centroids @ v / max(np.linalg.norm(v), 1e-12)
        if x.lang_pred != "und":
            best = max(cosines)
            assert x.score == pytest.approx(best, abs=1e-5)
            assert best - max(cosines[np.array([model.langs[k] == x.lang_pred for k in model.of])]) < 1e-5
            assert x.rejected == (sum(cell.values()) >= language_id.MIN_GRAMS and x.score < model.reject_below)


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    letters = {"en": "theandofirs", "fr": "éleauxquoi", "de": "erungschäö"}
    vocab = {k: ["".join(rng.choice(list(a), rng.integers(2, 8))) for _ in range(60)] for k, a in letters.items()}
    rows = [(i, " ".join(rng.choice(vocab[k], 60)), k) for i, k in enumerate(rng.choice(list(vocab), 150).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id < 100"))
    got = language_id.identify(docs.where("doc_id >= 100"), model, {"doc_id": F.col("doc_id"), "lang": F.col("lang")}).collect()
    assert np.mean([x.lang_pred == x.lang and not x.rejected for x in got]) > 0.95


def test_rejection_is_by_distance(spark, docs):
    odd = spark.createDataFrame([(1, "zqxjkvw " * 60)], "doc_id long, text string")
    assert language_id.identify(odd, language_id.train(docs)).first().rejected


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Sharing an excess again and again, as the definition has it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, rest = {}, sum(sizes.values())
    open_ = list(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if rest * w[s] / total > cap * sizes[s]]
        if not over:
            return done | {s: rest * w[s] / total for s in open_}
        for s in over:
            done[s] = cap * sizes[s]
            open_.remove(s)
        rest = sum(sizes.values()) - sum(done.values())
    return done


def test_mixing(docs, empty, rows):
    out = mixing.mix_table(docs).collect()
    assert len(out) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets(dict(size))
    source = defaultdict(set)
    for r in rows:
        source[r[0], len(WORD.findall(r[1] or ""))].add(r[3])
    taken, most = Counter(), Counter()
    for x in out:
        (s,) = source[x.doc_id, x.size]
        assert x.source_size == size[s] and x.target == pytest.approx(want[s]) and x.taken <= 3 * x.size
        taken[s] += x.taken
        most[s] = max(most[s], x.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1
    again = mixing.mix_table(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(x.doc_id for x in mixed.collect()) == Counter({k: v for k, v in sum((Counter({x.doc_id: x.copies}) for x in out), Counter()).items() if v})
    assert mixing.mix_table(empty).count() == mixing.mix(empty).count() == 0


def test_order_of_the_sample_is_by_odds(spark):
    """Inclusion probabilities differ by size, so the order is not that of the random numbers alone."""
    rows = [(i, "w " * (3 + i % 7 * 40), "s" if i % 4 else "t") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {x.doc_id: x for x in mixing.mix_table(docs, weight_of_size=mixing.bits).collect()}
    u = {r.id: r.u for r in docs.select(F.col("doc_id").alias("id"), mixing.uniform("doc_id", 7).alias("u")).collect()}
    mine = [i for i in range(400) if i % 4]
    extra = {n: [i for i in mine if out[i].copies == n] for n in {out[i].copies for i in mine}}
    assert len(extra) > 1
    low = max(extra)
    # some that are taken more often have larger random numbers than some that are not
    assert any(u[i] > u[j] for i in extra[low] for j in mine if out[j].copies < low)
    mean = lambda part: np.mean([out[i].copies for i in part])
    assert mean([i for i in mine if i % 7 == 6]) > 1.2 * mean([i for i in mine if i % 7 == 0])
    assert abs(sum(out[i].taken for i in mine) - out[mine[0]].target) <= 150


def test_running_sums(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i % 3, i / 8) for i in range(1000)], "k long, n long, x double")
    got = sorted((r.k, r.n, r.x, r.a, r.b) for r in running(df, [F.col("k")], a="n", b="x").collect())
    upto = (0, 0.0)
    for k, n, x, a, b in got:
        assert (a, b) == upto, k
        upto = (a + n, b + x)
    assert running(df.where("k < 0"), [F.col("k")], a="n").count() == 0


def test_mixing_by_document_weights(spark):
    rows = [(i, "a b c d", "s" if i % 3 else "t", 9.0 if i % 2 else 1.0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    out = {x.doc_id: x for x in mixing.mix_table(docs, weight_col="quality").collect()}
    for s in (0, 1):
        mine = [out[i] for i in range(600) if bool(i % 3) == bool(s)]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 4
    heavy, light = (np.mean([out[i].copies for i in range(600) if i % 2 == k and i % 3]) for k in (1, 0))
    assert heavy > 3 * light and max(x.copies for x in out.values()) <= 3


def pages(spark):
    rows = [(5, "http://a/é x", "same"), (3, "http://b", "same"), (9, None, "same"), (4, "http://c", None), (2, "http://d", ""), (7, "u\r\nX: y", "long " * 50_000), (None, "http://e", "solo"), (3, "http://b", "same"), (8, "http://f", "é🙂\r\n\r\nWARC/1.1")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_archives(spark):
    archives = warc_zip.write_archives(pages(spark), warc_zip.new_folder(spark))
    got = warc_zip.read_archives(archives)
    want = Counter()
    for p, u, h, _ in pages(spark).collect():
        ids = [q.page_id for q in pages(spark).collect() if (q.html or "") == (h or "") and q.page_id is not None]
        first = min(ids, default=None)
        response = first is None or p == first
        want[p, "response" if response else "revisit", None if response else first, warc_zip.base32_sha1((h or "").encode()), len((h or "").encode()), (h or "").encode() if response else None] += 1
    seen = Counter((x.page_id, x.record_type, x.refers_to, x.payload_digest, x.payload_bytes, None if x.payload is None else bytes(x.payload)) for x in got.collect())
    assert seen == want
    few = warc_zip.read_archives(warc_zip.write_archives(pages(spark), warc_zip.new_folder(spark), min_bytes=5))
    assert {x.record_type for x in few.collect()} == {"response"}
    none = warc_zip.write_archives(pages(spark).where("page_id = -1"), warc_zip.new_folder(spark))
    assert none.count() == warc_zip.read_archives(none).count() == 0


def test_uris():
    store, path = warc_zip.opened("file:///tmp/x")
    assert path == "/tmp/x"
    assert warc_zip.SCHEMES["s3a"] == "s3"
    with pytest.raises(ValueError, match="viewfs"):
        warc_zip.opened("viewfs://store/x")


def test_central_directory_with_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        for i in range(6):
            z.writestr(f"m/{i}é.txt", f"content {i} " * 20)
        z.writestr("packed", b"z" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    members = warc_zip.central_directory(data)
    for i in range(6):
        at, n = warc_zip.stored_at(data, members, f"m/{i}é.txt")
        assert data.getvalue()[at : at + n].decode() == f"content {i} " * 20
    with pytest.raises(ValueError, match="not stored"):
        warc_zip.stored_at(data, members, "packed")


ODD = ["", "  ", "Hello <|endoftext|> wörld's ΣΑΣ \x1c\x1d x<|startoftext|>a", "don't I'LL ﬁ中文字符 ñandú…!!??", "\x85\xa0 a b ||### <|endof", "a" * 3000 + " " + "ab" * 700, "'S 'T's ẞß ŉ K Å", "x\x00y \x7f", "\U0001f1e6é́", "日本語" * 40]


def test_bpe(docs, empty, rows, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.load(path)
    texts = ODD + [r[1] or "" for r in rows]
    for text, (ids, n, back) in zip(texts, own.encode(texts), strict=True):
        e = library.encode(text, add_special_tokens=False)
        assert [int(i) for i in ids.split()] == e.ids and n == len(e.ids)
        assert back == own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    got = bpe.encode(docs, path)
    assert sorted((x.doc_id, x.n_tokens) for x in got.collect()) == sorted((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert bpe.encode(empty, path).count() == 0


def test_bpe_of_every_character():
    """Each assigned code point alone, between letters, after a capital and before a combining mark."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.load(path)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not (0x3400 <= c < 0x9FF0 or 0xAC00 <= c < 0xD7A0 or 0x20000 <= c < 0x32400 or 0xE000 <= c < 0xF8F0) and c < 0xE0200]
    for lo in range(0, len(chars), 20_000):
        texts = [t for c in chars[lo : lo + 20_000] for t in (c, f"a{c}b", f"1{c}A{c}", f"{c}\u0301")]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        bad = [ascii(t) for t, ids, w in zip(texts, own.ids(texts), want, strict=True) if [int(i) for i in ids.split()] != w]
        assert not bad, bad[:20]


@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
@settings(max_examples=300, deadline=None)
def test_bpe_of_random_texts(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = bpe.load(path)
    assert [[int(i) for i in x.split()] for x in own.ids(texts)] == [e.ids for e in _library(path).encode_batch(texts, add_special_tokens=False)]


def test_bpe_cache_is_bounded_by_bytes(monkeypatch):
    own = bpe.Bpe(json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read()))
    monkeypatch.setattr(bpe, "CACHE_BYTES", 10_000)
    sizes = []
    for i in range(30):
        own.ids([f"{'é' * 200}{i} w{i}"])
        sizes.append(own.cached_bytes)
    assert max(sizes) < 14_000 and len(own.cache) < 40


def test_bpe_decodes_the_ids_it_returns(docs, rows, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.ids == want[x.doc_id] and x.decoded == library.decode(x.ids, skip_special_tokens=False)
    both = bpe.round_trip(docs, path)
    assert Counter((x.doc_id, x.n_tokens, *x.ids, x.decoded) for x in both.collect()) == Counter((x.doc_id, x.n_tokens, *x.ids, x.decoded) for x in got)
    # other ids than those of the texts: decoding reads the column
    own = spark.createDataFrame([(1, [320, 5, 49407]), (2, []), (3, None), (4, [10**6, 7, -1])], "doc_id long, ids array<int>")
    assert {x.doc_id: x.decoded for x in bpe.decode(own, path).collect()} == {1: library.decode([320, 5, 49407], skip_special_tokens=False), 2: "", 3: "", 4: library.decode([7], skip_special_tokens=False)}


def test_segment_trees_merge_like_a_plain_loop():
    own = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    ranks = {int(k): int(r) for k, r in zip(own.pair, own.rank, strict=True)}
    made = {k: int(own.made[r]) for k, r in ranks.items()}
    for piece in [b"the", b"aaaaaaa", b"thethethe", b"x", b"antidisestablishment", bytes([0xC3, 0xA9]) * 9]:
        ids = [*own.byte_id[list(piece[:-1])].tolist(), int(own.last_id[piece[-1]])]
        while True:
            found = [(ranks[k], i) for i in range(len(ids) - 1) if (k := ids[i] << 20 | ids[i + 1]) in ranks]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [made[ids[i] << 20 | ids[i + 1]]]
        assert own.merge([piece]) == [ids]


def test_bpe_merges_a_word_once_whatever_stands_beside_it(monkeypatch):
    own, merged = bpe.Bpe(json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read())), Counter()
    trees = own._trees
    monkeypatch.setattr(own, "_trees", lambda pieces, width: merged.update(pieces) or trees(pieces, width))
    library = _library(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("a harbour", "(Harbour, HARBOUR. harbour's", "\"harbour\"; harbour-harbour", "é/harbour", "harbour\u00a0"):
        assert own.ids([text]) == [" ".join(map(str, library.encode(text, add_special_tokens=False).ids))]
    assert merged[b"harbour"] == 1 and max(merged.values()) == 1


@given(st.lists(st.text(alphabet="aB's1.\u0130\u023a\u00dfé\u0301’“\u03a3я中 \t\n\x1c\x85\xa0\u1680\u2003\u2028\u3000<|endoftx>", max_size=60), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_bpe_of_near_and_far_characters(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = bpe.load(path)
    want = [e.ids for e in _library(path).encode_batch(texts, add_special_tokens=False)]
    for _ in range(3):  # new, from the older generation, and remembered
        flat, n = own.flat(texts)
        assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
        own.bytes = bpe.CACHE_BYTES


def test_bpe_forgets_words_by_generations(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.Bpe(json.loads(open(path).read())), _library(path)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(bpe, "GATHER", 7)
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i * 7919 % 100000:05d}")
    kept = []
    for i in range(300):
        text = f"{word(i)} {word(i + 1)} ’{word(i)} always"
        assert own.ids([text, "", text]) == [" ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in (text, "", text)]
        kept.append((own.cached_bytes, len(own.young.places) + len(own.old.places)))
    assert max(b for b, _ in kept) < 11_500 and max(n for _, n in kept) < 110


def test_bpe_with_another_pattern():
    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}']+|[\p{N}]+|[^\s\p{L}\p{N}']+"
    own, library = bpe.Bpe(spec), Tokenizer.from_str(json.dumps(spec))
    texts = [*ODD, "Don't 1234 it's", "a’b 12,345"]
    assert [[int(i) for i in x.split()] for x in own.ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_no_language_is_left_out(spark):
    word = lambda i: "".join(chr(97 + int(d)) * 2 for d in f"{i * 7919 % 100000:05d}")
    many = spark.createDataFrame([(i, f"{word(i)} {word(i + 1000)} {word(i)}", f"l{i:03d}") for i in range(270)], "doc_id long, text string, lang string")
    langs = [f"l{i:03d}" for i in range(270)]
    model = language_id.train(many)
    assert model.langs == langs and quality.learn(many).langs == langs
    got = {r.doc_id: r.lang_pred for r in language_id.identify(many.where("doc_id >= 250"), model).collect()}
    assert got == {i: f"l{i:03d}" for i in range(250, 270)}


def test_quality(docs, empty, rows):
    refs = quality.learn(docs)
    assert refs.langs == ["de", "en", "fr"] and refs.words.sum() == sum(len(WORD.findall(r[1] or "")) for r in rows if r[2])
    got = quality.score(docs, refs).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        g = list(zip(w, w[1:], w[2:], strict=False))
        c, cover = Counter(g), set()
        for j, x in enumerate(g):
            if c[x] > 1:
                cover |= {j, j + 1, j + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[r[0]].append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) in want[x.doc_id]
        assert not (x.base_failed and x.kept)
    assert all(x.kept == (not x.base_failed) for x in quality.score(docs, quality.learn(empty)).collect())
    assert quality.score(empty, refs).count() == 0


def test_verdict_by_hand(docs, rows):
    """Histograms of words themselves, not of buckets; distances by the definition."""
    refs = quality.learn(docs)
    limits = quality.Limits(class_distance=0.2, word_distance=0.55)
    plain = lambda w: bytes(b for b in w.lower().encode() if chr(b).isalnum() or b >= 128) if w.isascii() else w.encode()

    def classes(t):
        c = Counter()
        for b in t.encode():
            if not 128 <= b < 192:
                c[int(quality.BYTE_CLASS[b])] += 1
        return c

    def distance(p, q):
        p, q = ({k: v / sum(c.values()) for k, v in c.items()} for c in (p, q))
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p.keys() | q.keys()}
        return np.sqrt(sum(v * np.log2(v / m[k]) for d in (p, q) for k, v in d.items() if v) / 2)

    words, chars = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        if r[2]:
            words[r[2]].update(plain(w) for w in WORD.findall(r[1] or ""))
            chars[r[2]] += classes(r[1] or "")
    common = {k: {w for w, _ in c.most_common(200)} for k, c in words.items()}
    cut = lambda c, k: Counter({w: n for w, n in c.items() if w in common[k]}) + Counter({None: sum(n for w, n in c.items() if w not in common[k])})
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    seen = 0
    for x in quality.score(docs, refs, limits).collect():
        t = next(iter(texts[x.doc_id])) or ""
        if len(texts[x.doc_id]) > 1 or x.n_words < 20 or not t.isascii():
            continue
        own = Counter(plain(w) for w in WORD.findall(t))
        found = [(distance(classes(t), chars[k]), distance(cut(own, k), cut(words[k], k))) for k in refs.langs]
        best = min(found, key=sum)
        assert (x.class_distance, x.word_distance) == pytest.approx(best, abs=0.05)
        assert x.class_distance == pytest.approx(best[0], abs=1e-6)
        assert x.kept == (not x.base_failed and (x.n_words < 50 or x.class_distance <= 0.2 and x.word_distance <= 0.55))
        seen += 1
    assert seen > 5


def test_limits_come_from_good_documents(docs):
    measured = quality.measure(docs, quality.learn(docs))
    good = measured.where("doc_id % 2 = 0")
    limits = quality.learn_limits(good, 1.5)
    top = good.where("NOT base_failed AND n_words >= 50").agg(F.max("class_distance"), F.max("word_distance")).first()
    assert (limits.class_distance, limits.word_distance) == (1.5 * top[0], 1.5 * top[1])
    assert quality.learn_limits(good.where("false")) == quality.Limits()
    kept = quality.verdicts(measured, quality.learn_limits(good, 1.0)).where("doc_id % 2 = 0 AND NOT base_failed")
    assert kept.where("NOT kept").count() == 0


def test_symbols_fail_the_divergence(spark, docs, rows):
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 90][:3]
    odd = spark.createDataFrame([(i, " ".join(f"{w}{'#$%*' [j % 4] * 3}{j}" for j, w in enumerate(t.split()))) for i, t in enumerate(long)], "doc_id long, text string")
    assert not any(x.kept for x in quality.score(odd, quality.learn(docs)).collect())


def test_js_distance():
    p, q = np.array([[1, 0], [5, 5], [0, 0]]), np.array([1, 1])
    d = quality.js_distance(p, q)
    assert d[1] == 0 and d[2] == 1 and d[0] == pytest.approx(np.sqrt(0.5 * (np.log2(4 / 3) + 0.5 * np.log2(2 / 3) + 0.5 * np.log2(2))))


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now.collect()
        if name != "tokens":
            assert now.columns == before.columns
    lettered = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    # one text of the fixture is a single repeated syllable, which no language is near
    assert {r[0] for r in lettered} - {x.doc_id for x in kept["language"]} <= {501}
    assert len(kept["exact"]) == len({x.text for x in kept["language"]})
    assert {x.doc_id for x in kept["near"]} <= {x.doc_id for x in kept["exact"]}
    assert {x.doc_id for x in kept["mix"]} <= {x.doc_id for x in kept["near"]}
    assert Counter(x.doc_id for x in kept["tokens"]) == Counter(x.doc_id for x in kept["mix"])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {x.doc_id: x.text for x in kept["mix"]}
    for x in kept["tokens"]:
        assert list(x.ids) in [library.encode(t, add_special_tokens=False).ids for t in {r[1] or "" for r in rows if r[0] == x.doc_id}], texts[x.doc_id][:40]
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/sf/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf").count() == len(kept["tokens"])
    # what a folder holds whole is not made again
    now.limit(0).select("doc_id", "lang", "source").write.parquet(f"{tmp_path}/resume/exact")
    few = spark.read.parquet(f"{tmp_path}/mix").where("doc_id < 20")
    few.write.parquet(f"{tmp_path}/resume/mix")
    spark.read.parquet(f"{tmp_path}/near").write.parquet(f"{tmp_path}/resume/near")
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf", f"{tmp_path}/resume").count() == few.count()
