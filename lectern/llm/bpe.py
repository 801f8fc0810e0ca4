"""BPE encoding and decoding with a public tokenizer file, merges chosen by a segment tree over pair ranks.

A pre-token's symbols are the leaves of a segment tree whose leaf i holds (rank of the pair of symbol i and the next
one left, i). The root names the lowest rank, leftmost among equals; that pair is merged, and the two pairs beside it
are updated along their paths to the root, until the root holds no rank. Many pre-tokens are encoded at once: the
trees of a batch are the rows of one array, and each step merges one pair in every row that has one.

Texts are split into pre-tokens, and each distinct one is encoded once, numbered, and kept for two generations of a bounded
number of bytes; the ids of a block of texts are gathered by those numbers. Chunks between white space that have characters
from U+0300 on are kept whole instead, and normalised and split by the tokenizers library's own normaliser and
pre-tokenizer, since Python's tables are of another Unicode version; below that both agree. So are all chunks for a file
with another pattern than SPLIT. Merges are made here for every pre-token.

Supported files: type BPE with end_of_word_suffix, normalisers NFC, Replace of white-space runs and Lowercase,
pre-tokenizers Split (inverted, removed) and ByteLevel; others are refused. Tests compare with the tokenizers library.

Defined results: a null text counts as empty and has no token; equal texts get equal ids; of equal ranks the leftmost
pair is merged; a text of any length is encoded as a whole (a word's tree takes 40 bytes a byte of it); an empty table
gives an empty result; other columns are not read but for those that `keep` names, and may have any names.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from lectern.llm.common import small_batches
from lectern.llm.textblocks import blocks

NONE = np.int64(2**62)
#: White space of Unicode, where neither the normaliser nor the pre-tokenizer joins anything. Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of units and ids that a worker remembers in two generations, with ENTRY bytes for each one's place.
CACHE_BYTES, ENTRY = 64 << 20, 200
BATCH = 4096
#: Units whose ids are gathered at once.
GATHER = 1 << 18
#: From here on characters are left to the library's tables.
LATIN_END = "\u0300"
#: Bits of a place in a table of pairs.
SLOT_BITS = 19
#: The pattern that PLAIN stands for; files with another are split by the library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _pattern() -> re.Pattern:
    """SPLIT for characters below U+0300, in the terms of `re`, which is faster."""
    of = lambda kind: "".join(re.escape(c) for c in map(chr, range(ord(LATIN_END))) if regex.match(kind, c))
    letters, digits, white = of(r"\p{L}"), of(r"\p{N}"), of(r"\s") + SPACE
    # letters first, as most are; no other alternative begins with one
    return re.compile(rf"[{letters}]+|[{digits}]|'(?:s|t|re|ve|m|ll|d)|[^{white}{letters}{digits}]+")


PLAIN = _pattern()
#: Characters whose class the libraries' tables may see otherwise, and those whose lower case is of them.
_far = f"\x1c-\x1f\u0130\u023a\u023e{LATIN_END}-\U0010ffff"
FAR = re.compile(f"[{_far}]")
#: Those of them that are ASCII.
ODD = "\x1c\x1d\x1e\x1f"
#: Chunks between white space; and runs of chunks without such characters, or a chunk with them.
CHUNK = re.compile(f"[^{SPACE}]++")
PARTS = re.compile(f"((?:[^{SPACE}{_far}]++(?:[{SPACE}]++|\\Z))++)|([^{SPACE}]++)")


def _slots(pair: np.ndarray) -> np.ndarray:
    return (pair * 0x9E3779B97F4A7C1 >> 20) & ((1 << SLOT_BITS) - 1)


class _Places(dict):
    """Numbers of units; one that is not known yet gets the next number and is noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class _Generation:
    """Units by number, and the ids of all of them one after another."""

    def __init__(self):
        self.places, self.flat = _Places(), np.zeros(0, "<u4")
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, made: list[bytes]) -> None:
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), "<u4")])

    def ids(self, word: str) -> bytes:
        n = self.places[word]
        return self.flat[self.start[n] : self.start[n] + self.size[n]].tobytes()

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of the units of these numbers, one after another."""
        size = self.size[at]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - end + size, size) + np.arange(size.sum())]


class Remembering:
    """Ids of texts as little-endian 32-bit numbers; each unit is encoded once and kept until two generations of them have passed.

    Units are pre-tokens, special tokens, and chunks kept whole. Subclasses have fixed, the packed ids of special tokens; split, a
    text's units; whole, the pre-tokens of each chunk among some units; merged, the packed ids of pre-tokens; and most, the bytes of
    a generation.
    """

    def __init__(self):
        self.bytes, self.young, self.old = 0, _Generation(), _Generation()

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's."""
        units = [self.split(t) for t in texts]
        if self.bytes > self.most():
            self.old, self.young, self.bytes = self.young, _Generation(), 0
        known, n = self.young, np.fromiter(map(len, units), np.int64, len(units))
        try:
            # one look a unit, which numbers the new ones
            at = np.fromiter(map(known.places.__getitem__, chain.from_iterable(units)), np.int64, n.sum())
            self._learn()
        except BaseException:
            # no number without ids
            self.young, self.bytes = _Generation(), 0
            raise
        upto = np.concatenate([[0], np.cumsum(known.size[at])])
        parts = [known.gather(at[lo : lo + GATHER]) for lo in range(0, len(at), GATHER)]
        return np.concatenate([np.zeros(0, "<u4"), *parts]), np.diff(upto[np.concatenate([[0], np.cumsum(n)])])

    def __call__(self, texts: list[str]) -> list[bytes]:
        flat, n = self.flat(texts)
        data, bounds = flat.tobytes(), 4 * np.concatenate([[0], np.cumsum(n)])
        return [data[lo:hi] for lo, hi in pairwise(bounds.tolist())]

    def _learn(self) -> None:
        """Ids of the units numbered since the last call, in that order."""
        new, self.young.places.new = self.young.places.new, []
        held = self.old.places.keys()
        made = {w: self.fixed[w] if w in self.fixed else self.old.ids(w) for w in new if w in self.fixed or w in held}
        rest = [w for w in new if w not in made]
        for lo in range(0, len(rest), 4 * BATCH):
            part = rest[lo : lo + 4 * BATCH]
            whole = self.whole(part)
            words = list(dict.fromkeys([w for w in part if w not in whole] + [w for ws in whole.values() for w in ws]))
            ids = dict(zip(words, self.merged([w.encode() for w in words]), strict=True))
            made.update(ids)
            made.update((c, b"".join([ids[w] for w in ws])) for c, ws in whole.items())
        ids = [made[w] for w in new]
        self.young.add(ids)
        self.bytes += sum(len(w) if w.isascii() else 4 * len(w) for w in new) + sum(map(len, ids)) + ENTRY * len(new)


def byte_letters() -> list[str]:
    """The printable character that byte-level files write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def token_names(spec: dict) -> dict[int, str]:
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


class Bpe(Remembering):
    def __init__(self, spec: dict):
        super().__init__()
        model, steps = spec["model"], [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] or (split["type"], split["behavior"], split["invert"], level["type"]) != ("Split", "Removed", True, "ByteLevel") or spec["decoder"]:
            raise ValueError("not a kind of tokenizer file that is supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"]
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.names = token_names(spec)
        letters = byte_letters()
        self.byte_id = np.array([self.vocab[x] for x in letters], np.int64)
        self.last_id = np.array([self.vocab[x + self.suffix] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank, self.made = key[order], order.astype(np.int64), np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.plain = split["pattern"]["Regex"] == SPLIT
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.pieces = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), behavior="removed", invert=True)
        self.fixed = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        # pairs by the low bits of a product; of those that fall together the first is looked at, the others are searched for
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slot[_slots(self.pair[::-1])] = np.arange(len(self.pair), dtype=np.int32)[::-1]
        self.many = np.bincount(_slots(self.pair), minlength=1 << SLOT_BITS) > 1

    @property
    def cache(self) -> dict[str, int]:
        return self.young.places

    @property
    def cached_bytes(self) -> int:
        return self.bytes

    def most(self) -> int:
        return CACHE_BYTES // 2

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE where it is no merge or an id is -1."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`ranks` by one look for most pairs."""
        key = left << 20 | right
        slot = _slots(key)
        at = self.slot[slot]
        hit = (self.pair[at] == key) & (at >= 0) & (left >= 0) & (right >= 0)
        out = np.where(hit, self.rank[at], NONE)
        if (unsure := ~hit & self.many[slot]).any():
            out[unsure] = self.ranks(left[unsure], right[unsure])
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each of these pre-tokens (not empty)."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.merged(pieces)]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each of these pre-tokens (not empty), by segment trees over the ranks of adjacent pairs."""
        out = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, which in by_width.items():
            step = max(1, (1 << 18) // width)
            for lo in range(0, len(which), step):
                part = which[lo : lo + step]
                ids, ends = self._trees([pieces[i] for i in part], width)
                start = 0
                for i, end in zip(part, ends, strict=True):
                    out[i] = ids[start:end]
                    start = end
        return out

    def _trees(self, pieces: list[bytes], width: int) -> tuple[bytes, list[int]]:
        """Packed ids of pre-tokens of at most `width` bytes, one after another, and where each ends."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width][np.arange(width) < size[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ids[np.arange(n), size - 1] = self.last_id[[p[-1] for p in pieces]]
        # neighbours that are left: place `width` stands for none
        after = np.where(np.arange(width) + 1 < size[:, None], np.arange(width) + 1, width)
        before = np.tile(np.arange(width) - 1, (n, 1))
        before[:, 0] = width
        # node k of a row has the children 2k and 2k + 1; leaves start at `width` and hold rank * width + place
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.look(ids[:, :width], ids[:, 1:])
        tree[:, width:] = np.where(rank < NONE, rank * width + np.arange(width), NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = tree[row, 1]
            at = root % width
            right = after[row, at]
            ids[row, at] = self.made[root // width]
            ids[row, right] = -1
            far = after[row, right]
            after[row, at] = far
            some = far < width
            before[row[some], far[some]] = at[some]
            left = before[row, at]
            has_left = left < width
            self._update(tree, row, right, np.full(len(row), NONE), width)
            fresh = self.look(ids[row, at], np.where(some, ids[row, far], -1))
            self._update(tree, row, at, np.where(fresh < NONE, fresh * width + at, NONE), width)
            lrow, lat = row[has_left], left[has_left]
            fresh = self.look(ids[lrow, lat], ids[lrow, at[has_left]])
            self._update(tree, lrow, lat, np.where(fresh < NONE, fresh * width + lat, NONE), width)
            row = row[tree[row, 1] < NONE]
        flat = ids[:, :width]
        kept = flat >= 0
        return flat[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()

    @staticmethod
    def _update(tree: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray, width: int) -> None:
        node = width + place
        tree[row, node] = value
        node >>= 1
        while len(node) and node[0]:
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node >>= 1

    def split(self, text: str) -> list[str]:
        """Pre-tokens, special tokens as they are, and the chunks that are kept whole."""
        if any(s in text for s in self.special):
            return [x for p in self.cuts.split(text) for x in ([p] if p in self.special else self.split(p))]
        if not self.plain:
            return CHUNK.findall(text)
        if not (any(c in text for c in ODD) if text.isascii() else FAR.search(text)):
            # the characters that are left are as NFC has them
            return PLAIN.findall(text.lower())
        return [x for near, far in PARTS.findall(text) for x in (PLAIN.findall(near.lower()) if near else [far])]

    def whole(self, units: list[str]) -> dict[str, list[str]]:
        """The pre-tokens of each chunk among these units, as the library splits it."""
        return {u: [w for w, _ in self.pieces.pre_tokenize_str(self.normal.normalize_str(u))] for u in units if not self.plain or FAR.search(u)}

    def ids(self, texts: list[str]) -> list[str]:
        """Ids of each text, joined by blanks."""
        return [" ".join(map(str, np.frombuffer(x, "<u4").tolist())) for x in self(texts)]

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by blanks, number of ids, decoded text) of each text."""
        lists = [[int(i) for i in ids.split()] for ids in self.ids(texts)]
        return [(" ".join(map(str, ids)), len(ids), self.decode(ids)) for ids in lists]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by blanks: a file without a decoder has no other rule. Ids that no token has are left out."""
        return " ".join([t for i in ids if (t := self.names.get(i)) is not None])


@lru_cache(2)
def _loaded(spec: str) -> Bpe:
    return Bpe(json.loads(spec))


@lru_cache(2)
def _decoder(path: str) -> pa.Array:
    """Token strings by id, null where no token has it."""
    with open(path, encoding="utf-8") as f:
        names = token_names(json.load(f))
    return pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())


def forget() -> None:
    """Frees the tokenizers and units that this worker remembers."""
    _loaded.cache_clear()
    _decoder.cache_clear()


def load(path: str) -> Bpe:
    with open(path, encoding="utf-8") as f:
        return _loaded(f.read())


def _coder(name: str, decoding: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        bpe = load(SparkFiles.get(name))
        names = _decoder(SparkFiles.get(name)) if decoding else None
        for batch in batches:
            width = batch.num_columns - 1
            for lo, hi, _, _ in blocks(batch.column(width), rows=1024):
                part = batch.slice(lo, hi - lo)
                flat, n = bpe.flat([t or "" for t in part.column(width).to_pylist()])
                lists = pa.ListArray.from_arrays(_offsets(n), pa.array(flat.astype(np.int32)))
                # decoding reads nothing but the ids
                more = [decode_lists(lists, names)] if decoding else []
                yield pa.record_batch([*part.columns[:width], pa.array(n), lists, *more], names=[*batch.schema.names[:width], "n_tokens", "ids", *(["decoded"] if decoding else [])])

    return run


def forget_others() -> None:
    if (minhash := sys.modules.get("lectern.llm.minhash")) is not None:
        minhash.level_keys.cache_clear()


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def decode_lists(lists: pa.ListArray, names: pa.Array) -> pa.Array:
    """The text of each list of ids, by `Bpe.decode`'s rule: token strings joined by blanks, ids that no token has left out; no list counts as empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    known = (ids >= 0) & (ids < len(names))
    known[known] = names.is_valid().to_numpy(zero_copy_only=False)[ids[known]]
    if not known.all():
        sizes, ids = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes)), ids[known]
    return pc.binary_join(pa.ListArray.from_arrays(_offsets(sizes), names.take(pa.array(ids, pa.int64()))), " ")


def _decoding(name: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _decoder(SparkFiles.get(name))
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                yield pa.record_batch([*part.columns, decode_lists(part.column(at), names)], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, path: str, keep: dict[str, Column] | None = None, text_col: str = "text") -> DataFrame:
    """One row per row of docs: the columns `keep`, n_tokens and ids. The file goes to the executors through SparkContext.addFile."""
    return _encoded(docs, path, keep, text_col, False)


def round_trip(docs: DataFrame, path: str, keep: dict[str, Column] | None = None, text_col: str = "text") -> DataFrame:
    """`decode` of what `encode` gives, both in one worker."""
    return _encoded(docs, path, keep, text_col, True)


def _encoded(docs: DataFrame, path: str, keep: dict[str, Column] | None, text_col: str, decoding: bool) -> DataFrame:
    keep = keep or {"doc_id": F.col("doc_id")}
    docs.sparkSession.sparkContext.addFile(path)
    rows = small_batches(docs).select(*[c.alias(k) for k, c in keep.items()], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = rows.select(*keep).schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    if decoding:
        schema = schema.add("decoded", "string")
    return rows.mapInArrow(_coder(path.rsplit("/", 1)[-1], decoding), schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """rows with decoded, the text that the ids stand for; nothing but the ids is read for it."""
    rows.sparkSession.sparkContext.addFile(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return small_batches(rows).mapInArrow(_decoding(path.rsplit("/", 1)[-1], rows.columns.index(ids_col)), schema)
