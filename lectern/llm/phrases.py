"""Phrase collocations: phrases of two or three words that stand together more often than their parts would.

Texts are lower-cased (A to Z), cut into pieces at punctuation and line ends, and pieces into words. A word is known by a
64-bit hash of its language and bytes, a phrase by its words' hashes, so what follows moves numbers and not texts.

1. Words are counted exactly, by language and text. If two words share a hash another seed is drawn, so a hash names one
   word. Words found `at_least` times go into a bitmap of a bounded size.
2. Phrases of two words whose words the bitmap has, and then phrases of three whose two phrases of two its successor
   has, are the ones that can be frequent at all (a bit too many is no harm). A task counts what it reads, some
   FLUSH phrases at a time, and sends the different ones with their counts to slices of the key space, packed: no more rows
   than phrases, and one pair a flush of even the commonest.
3. A slice adds counts by hashed cells; phrases in cells below `at_least` can't be frequent. Over the other phrases it
   makes a minimal perfect hash that stores the keys. Each packed part is a numpy array that is looked up slot by slot,
   verified by the stored key and counted by bincount; the parts' arrays are summed as a tree. The number of slices
   grows with the corpus, so a slice stays at some SLICE_BYTES.
4. Cuts are scored from the counts of the slots: phrases meet the counts of their parts by joins of frequent ones only.

Exact: counts are whole numbers, scores are decimals of 38 digits (counts below 10^14). A language's best are
found in SALTS parts first, so a hot language is not sorted in one task.

Defined results: a null text is empty; a null language is `und`, and one with that language; ids are not read; rows
that repeat a text count again; ties fall by smallest cut, then by the phrase's bytes; an empty table gives no row; other
columns are not read. A text is read as a whole, so the longest one bounds memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import settle, small_batches
from lectern.llm.textblocks import LOWER, blocks, forget, mix, runs, span_hash

#: White space inside of pieces, and what ends a piece. Fixed values.
BLANKS = b" \t"
ENDS = b".,;:!?\n\x0b\x0c\r"
# End of fixed values.
UNKNOWN = "und"
#: Phrases and different words that a task holds before it sends their counts.
FLUSH = 1_500_000
FLUSH_WORDS = 400_000
#: Bytes of packed keys and counts in a slice.
SLICE_BYTES = 32 << 20
#: Bits of a bitmap, as a power of two: 16 a key between these.
LEAST_BITS, MOST_BITS = 16, 27
#: Bits of a bitmap that one row holds, as a power of two.
CHUNK_BITS = 16
SALTS = 64
SEEDS = 8

_is_word = np.ones(256, bool)
_is_word[list(BLANKS + ENDS)] = False
_is_end = np.zeros(256, bool)
_is_end[list(ENDS)] = True
_odd = np.random.default_rng(11).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tuple_hash(words: np.ndarray, level: int = 0) -> np.ndarray:
    """A 64-bit hash of each column of words (k x n numbers); another one for each level."""
    h = np.full(words.shape[1], _odd[level % 64], np.uint64)
    for w in words:
        h = mix(h * _odd[(level + 17) % 64] + w)
    return h


class PerfectHash:
    """A minimal perfect hash over different keys, the columns of a k x n array, that stores them.

    A level is an array of twice as many places as keys are left; a key alone on its place stays there, the others go to the
    next level. A key's slot is the number of places taken before its own.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, taken = keys, 0
        while left.shape[1]:
            at = self._place(left, len(self.levels), 2 * left.shape[1])
            alone = np.bincount(at, minlength=2 * left.shape[1]) == 1
            self.levels.append((alone, (taken - 1 + np.cumsum(alone)).astype(np.int64)))
            taken += int(alone.sum())
            left = left[:, ~alone[at]]
        self.stored = np.zeros_like(keys)
        self.size = keys.shape[1]
        self.stored[:, self._slots(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tuple_hash(keys, level + 1) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape[1], -1, np.int64)
        open_ = np.arange(keys.shape[1])
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(keys[:, open_], level, len(alone))
            hit = alone[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the key that is stored there is another one."""
        at = self._slots(keys)
        some = at >= 0
        some[some] = (self.stored[:, at[some]] == keys[:, some]).all(0)
        return np.where(some, at, -1)


def tree_sum(arrays: Iterable[np.ndarray]) -> np.ndarray:
    """The sum of arrays, added as a tree of which only a branch is held."""
    held: list[tuple[int, np.ndarray]] = []
    for total in arrays:
        depth = 0
        while held and held[-1][0] == depth:
            total = total + held.pop()[1]
            depth += 1
        held.append((depth, total))
    total = held.pop()[1]
    while held:
        total = total + held.pop()[1]
    return total


def count_slots(parts: list[tuple[np.ndarray, np.ndarray]], at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys found `at_least` times in parts, each of (k x n keys, counts), and their counts."""
    cells = 1 << max(10, int(sum(len(n) for _, n in parts)).bit_length())
    cell = [(tuple_hash(keys) % np.uint64(cells)).astype(np.int64) for keys, _ in parts]
    # a part's cell counts at_least at most, which tells as much
    full = tree_sum(np.minimum(np.bincount(c, n, cells), at_least).astype(np.uint32) for c, (_, n) in zip(cell, parts, strict=True)) >= at_least
    # what an emptier cell holds is rare for sure
    parts = [(keys[:, full[c]], n[full[c]]) for c, (keys, n) in zip(cell, parts, strict=True)]
    keys = np.concatenate([k for k, _ in parts], axis=1)
    keys = keys[:, np.lexsort(keys)]
    new = np.ones(keys.shape[1], bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
    table = PerfectHash(keys[:, new])

    def counted(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = table.slots(keys)
        return np.bincount(at[at >= 0], n[at >= 0], table.size).astype(np.int64)

    total = tree_sum(counted(*part) for part in parts)
    often = total >= at_least
    return table.stored[:, often], total[often]


def _lang(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))


def _read(batches: Iterator[pa.RecordBatch], values: np.ndarray):
    """For each block of texts (column 0 their languages): bytes, starts and ends of words, their hashes, pieces and rows."""
    forget()
    salt: dict[str, np.uint64] = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for x in langs.dictionary.to_pylist():
            salt.setdefault(x, np.uint64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")))
        own = np.array([salt[x] for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.uint64)
        for lo, _, data, at in blocks(batch.column(1)):
            low = LOWER[data]
            starts, ends = runs(_is_word[low], at)
            row = np.searchsorted(at, starts, "right") - 1
            h = mix(span_hash(low, starts, ends, values) ^ own[lo + row])
            piece = np.cumsum(_is_end[low], dtype=np.int64)[starts] + row
            yield batch, low, starts, ends, h, piece, lo + row


def _values(seed: int) -> np.ndarray:
    return np.random.default_rng(1000 + seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at these places."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.arange(to[-1]) + np.repeat(starts - to[:-1], size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(flat.tobytes()))


def _differ(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, twin: np.ndarray) -> np.ndarray:
    """Which words are not, byte for byte, those that `twin` names."""
    size = ends - starts
    other = size != size[twin]
    same = np.flatnonzero(~other & (twin != np.arange(len(twin))))
    if len(same):
        n = size[same]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        apart = data[at + np.repeat(starts[same], n)] != data[at + np.repeat(starts[twin[same]], n)]
        other[same] = np.add.reduceat(apart, np.cumsum(n) - n, dtype=np.int64) > 0
    return other


def _count_words(seed: int):
    values = _values(seed)

    def batch_of(h: np.ndarray, lang: pa.Array, word: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(h.view(np.int64)), lang, word, pa.array(n)], names=["h", "lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            h, lang, word = np.concatenate([x[0] for x in held]), *(pa.concat_arrays([x[i] for x in held]) for i in (2, 3))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([x[1] for x in held])).astype(np.int64)
            held.clear()
            twin = pa.array(first[inverse])
            other = np.flatnonzero(pc.or_(pc.not_equal(word, word.take(twin)), pc.not_equal(lang, lang.take(twin))).to_numpy(zero_copy_only=False))
            if len(other):
                yield batch_of(h[other], lang.take(pa.array(other)), word.take(pa.array(other)), np.zeros(len(other), np.int64))
            for lo in range(0, len(u), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                at = pa.array(first[part])
                yield batch_of(u[part], lang.take(at), word.take(at), n[part])

        for batch, low, starts, ends, h, _, row in _read(batches, values):
            if not len(h):
                continue
            u, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            lang = batch.column(0)
            # another word under one hash is told on without a count, so that it is seen below
            own = lang.dictionary_encode().indices.to_numpy()[row]
            other = np.flatnonzero(_differ(low, starts, ends, first[inverse]) | (own != own[first[inverse]]))
            if len(other):
                yield batch_of(h[other], lang.take(pa.array(row[other])), _taken(low, starts[other], ends[other]), np.zeros(len(other), np.int64))
            held.append((u, n, lang.take(pa.array(row[first])), _taken(low, starts[first], ends[first])))
            if sum(len(x[0]) for x in held) >= FLUSH_WORDS:
                yield from flush()
        if held:
            yield from flush()

    return run


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, int]:
    """(h, lang, word, n) of every word, and the seed of the hash, under which no two words of the corpus share an h."""
    rows = small_batches(docs).select(_lang(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for seed in range(SEEDS):
        sent = rows.mapInArrow(_count_words(seed), "h long, lang string, word string, n long")
        words = settle(sent.groupBy("h", "lang", "word").agg(F.sum("n").alias("n")))
        if words.groupBy("h").agg(F.count(F.lit(1)).alias("words")).where("words > 1").isEmpty():
            return words, seed
    raise ValueError("words of the corpus share hashes under every seed")


def bitmap(keys: DataFrame, columns: list[str]) -> np.ndarray:
    """Bits, 16 a key but at most 2^MOST_BITS, of which those at the keys' hashes are set; the driver gets at most 16 MB."""
    size = min(MOST_BITS, max(LEAST_BITS, (16 * max(1, keys.count()) - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(np.stack([c.to_numpy().view(np.uint64) for c in batch.columns]), size)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(at >> CHUNK_BITS), pa.array(at & ((1 << CHUNK_BITS) - 1))], names=["chunk", "at"])

    def packed(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << CHUNK_BITS, bool)
        bits[table.column("at").to_numpy()] = True
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    found = keys.select(*columns).mapInArrow(places, "chunk long, at long").distinct().groupBy("chunk").applyInArrow(packed, "chunk long, bits binary")
    out = np.zeros((1 << size - CHUNK_BITS, 1 << CHUNK_BITS - 3), np.uint8)
    for r in found.toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _bit(words: np.ndarray, size: int) -> np.ndarray:
    return (tuple_hash(words, 40) >> np.uint64(64 - size)).astype(np.int64)


def has_bit(bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = _bit(words, (len(bits) * 8).bit_length() - 1)
    return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0


def _grams(size: int, seed: int, bits, slices: int):
    values = _values(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        held: list[np.ndarray] = []

        def flush():
            keys = np.concatenate(held, axis=1)
            held.clear()
            h = tuple_hash(keys)
            order = np.argsort(h)
            keys, h = keys[:, order], h[order]
            first = np.ones(len(h), bool)
            first[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
            at = np.flatnonzero(first)
            n = np.diff(np.append(at, len(h))).astype(np.uint32)
            keys = keys[:, at]
            # hashes are in order, and so are slices: a slice is a range of hashes
            of = ((h[at] >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            ends = np.append(cut[1:], len(of))
            parts = [(int(of[a]), np.ascontiguousarray(keys[:, a:b]).tobytes(), n[a:b].tobytes()) for a, b in zip(cut, ends, strict=True)]
            return pa.record_batch([pa.array([p[0] for p in parts], pa.int64()), *(pa.array([p[i] for p in parts], pa.binary()) for i in (1, 2))], names=["slice", "keys", "n"])

        for _, _, _, _, h, piece, _ in _read(batches, values):
            if len(h) < size:
                continue
            together = piece[:-1] == piece[1:]
            if size == 2:
                often = has_bit(known, h[None])
                go = together & often[:-1] & often[1:]
                keys = np.stack([h[:-1][go], h[1:][go]])
            else:
                pair = np.zeros(len(together), bool)
                at = np.flatnonzero(together)
                pair[at] = has_bit(known, np.stack([h[at], h[at + 1]]))
                go = pair[:-1] & pair[1:]
                keys = np.stack([h[:-2][go], h[1:-1][go], h[2:][go]])
            held.append(keys)
            if sum(k.shape[1] for k in held) >= FLUSH:
                yield flush()
        if sum(k.shape[1] for k in held):
            yield flush()

    return run


def _slice(size: int, at_least: int):
    names = [f"w{i + 1}" for i in range(size)]

    def run(table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(k.as_py(), np.uint64).reshape(size, -1), np.frombuffer(n.as_py(), np.uint32)) for k, n in zip(table.column("keys"), table.column("n"), strict=True)]
        keys, n = count_slots(parts, at_least)
        return pa.table({**{c: pa.array(keys[i].view(np.int64)) for i, c in enumerate(names)}, "a": pa.array(n)})

    return run


def frequent_phrases(docs: DataFrame, size: int, seed: int, bits: np.ndarray, most: int, at_least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(w1, w2, .., a) of the phrases of `size` words found `at_least` times; some `most` occurrences at most pass the bitmap."""
    slices = max(1, -(-most * (8 * size + 4) // SLICE_BYTES))
    rows = small_batches(docs).select(_lang(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent = rows.mapInArrow(_grams(size, seed, docs.sparkSession.sparkContext.broadcast(bits), slices), "slice long, keys binary, n binary")
    return settle(sent.groupBy("slice").applyInArrow(_slice(size, at_least), ", ".join(f"w{i + 1} long" for i in range(size)) + ", a long"))


def _total(rows: DataFrame, column: str) -> int:
    return rows.agg(F.sum(column)).first()[0] or 0


def score(a: Column | str, l: Column | str, r: Column | str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exact: all are below 10^14."""
    wide = lambda c: F.col(c).cast("decimal(14,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * wide(a) * wide(a), wide(l) * wide(r))


def candidates(docs: DataFrame, at_least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score, longer) of all frequent phrases, longer the largest count of a frequent phrase of three that holds the phrase (null: none)."""
    words, seed = word_counts(docs, text_col, lang_col)
    often = words.where(F.col("n") >= at_least)
    two = frequent_phrases(docs, 2, seed, bitmap(often, ["h"]), _total(often, "n"), at_least, text_col, lang_col)
    three = frequent_phrases(docs, 3, seed, bitmap(two, ["w1", "w2"]), _total(two, "a"), at_least, text_col, lang_col)
    named = lambda i: often.select(F.col("h").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("n").alias(f"n{i}"))
    lang = often.select(F.col("h").alias("w1"), "lang")

    held = three.select("w1", "w2", "a").unionAll(three.select("w2", "w3", "a").toDF("w1", "w2", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    pairs = two.join(held, ["w1", "w2"], "left").join(named(1), "w1").join(lang, "w1").join(named(2), "w2")
    pairs = pairs.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.lit(2).alias("size"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), "longer")
    pairs = pairs.withColumn("score", score("a", "l", "r"))

    first, last = two.toDF("w1", "w2", "n12"), two.toDF("w2", "w3", "n23")
    triples = three.join(first, ["w1", "w2"]).join(last, ["w2", "w3"]).join(named(1), "w1").join(lang, "w1").join(named(2), "w2").join(named(3), "w3")
    triples = triples.withColumn("s1", score("a", "n1", "n23")).withColumn("s2", score("a", "n12", "n3"))
    later = F.col("s2") < F.col("s1")
    triples = triples.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.lit(3).alias("size"), "a", F.when(later, F.col("n12")).otherwise(F.col("n1")).alias("l"),
        F.when(later, F.col("n3")).otherwise(F.col("n23")).alias("r"), F.lit(None).cast("long").alias("longer"), F.least("s1", "s2").alias("score"),
    )
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return pairs.unionByName(triples).join(totals, "lang")


def mine(docs: DataFrame, at_least: int = 10, inside: int = 50, best: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `best` phrases by score; those of which `inside` per cent stand in one longer frequent phrase are dropped."""
    found = candidates(docs, at_least, text_col, lang_col).where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for part in (["lang", "salt"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(W.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= best)
    return salted.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
