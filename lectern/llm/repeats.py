"""Finding repeated windows of a corpus: what suffix_dedup (bytes) and substring_dedup (words) share.

A window is L consecutive positions (bytes or words) of one document. Equal windows are made to meet without sending
all windows: each window has an anchor, the place of its smallest hash of k positions (the leftmost such place), which
depends on the window's content alone. Consecutive windows with one anchor form a segment, about (L - k) / 2 windows.

1. Documents are dealt to blocks by id (the one time texts move), of some BLOCK_BYTES or less by the plan's own
   estimate of the table's size. Each block lists the distinct hashes at its anchors, with the number of different
   segments (by a hash of their content) and the KINDS least of those hashes.
2. Lists meet by hash; each block learns which of its hashes occur anywhere else, and which are hot: those with more
   than about HOT different segments in all blocks together, estimated from the KINDS least hashes of their union (exact up to
   KINDS, then within some 20 %). A passage that every document has counts once a block, so it costs a number a block.
3. Each block sends the segments of those anchors, equal ones once, to a target; a copy of an earlier segment of its
   own block is marked there and then. Segments of a hot anchor are sent window by window, each to the target of its
   own content, so that a passage which stands between ever other neighbours is split over all targets.
4. A target finds, for each window, whether an equal one starts earlier; that is done by the caller's method.
5. Marks go back to the blocks, where spans are removed.

Positions are ordered by (id, text, place); rows equal in both are one document, and share its result. A null id
comes before all others; a null text is empty. A block holds its texts twice while it sorts them, and some 60 bytes for
each of 2 ** CHUNK_BITS positions at a time; one longer text is a block's floor. Columns other than id and text are
not read and may have any names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches
from lectern.llm.textblocks import IS_WORD, VALUE, blocks, forget, gram_hash, mix, runs, sliding_min, span_hash, text_bytes

CHUNK_BITS = 20
NULL_ID = -(2**63)
BLOCK_BYTES = 128 << 20
#: Different segments of one anchor hash beyond which its windows are sent one by one.
HOT = 4000
#: Hashes of segments that a block tells of an anchor, to count the different ones of all blocks.
KINDS = 32
#: Bytes of text in one of the files' bytes, as compressed files shrink.
EXPANDS = 4
BASE = np.uint64(6364136223846793005)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


@dataclass(frozen=True)
class Spec:
    words: bool
    window: int
    gram: int
    targets: int
    targets_of_hashes: int
    splitters: tuple[bytes, ...] = ()

    def target(self, body: bytes, at: int, h: int, hot: bool) -> int:
        """Where equal windows meet: by the range that the suffix from the anchor on lies in, or by a hash."""
        if not self.splitters:
            return (zlib.crc32(body) if hot else h >> 20) % self.targets
        # of a cold anchor only the gram itself is common to all its segments
        return bisect_right(self.splitters, body if hot else body[at : at + self.gram])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Block:
    """The documents of a block in order of (id, text), equal rows once, as positions one after another."""

    def __init__(self, ids: pa.Array, texts: pa.Array, spec: Spec):
        self.spec = spec
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        ids = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        data, at = text_bytes(texts)
        text = lambda i: data[at[i] : at[i + 1]].tobytes()
        order = np.argsort(ids, kind="stable")
        new = np.ones(len(ids), bool)
        twin = np.flatnonzero(ids[order][1:] == ids[order][:-1])
        for lo, hi in union(twin, twin + 2) if len(twin) else []:
            for a, b in union_of_equal(ids[order[lo:hi]]):
                part = sorted(order[lo + a : lo + b].tolist(), key=text)
                order[lo + a : lo + b] = part
                new[lo + a + 1 : lo + b] = [text(x) != text(y) for x, y in zip(part, part[1:], strict=False)]
        #: document of each row
        self.of = np.empty(len(ids), np.int64)
        self.of[order] = np.cumsum(new) - 1
        order = order[new]
        self.ids = ids[order]
        size = at[order + 1] - at[order]
        self.byte_at = np.concatenate([[0], np.cumsum(size)])
        self.data = np.empty(int(self.byte_at[-1]), np.uint8)
        for i, (lo, hi) in enumerate(zip(self.byte_at[:-1].tolist(), self.byte_at[1:].tolist(), strict=True)):
            self.data[lo:hi] = data[at[order[i]] : at[order[i] + 1]]
        self.at = self.byte_at
        if spec.words:
            parts, counts = [], np.zeros(len(order), np.int64)
            wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(self.byte_at), pa.py_buffer(self.data)])
            for lo, hi, piece, sub in blocks(wide):
                starts, ends = runs(IS_WORD[piece], sub)
                parts.append(span_hash(piece, starts, ends))
                counts[lo:hi] = np.bincount(np.searchsorted(sub, starts, "right") - 1, minlength=hi - lo)
            self.hashes = np.concatenate([*parts, np.zeros(0, np.uint64)])
            self.at = np.concatenate([[0], np.cumsum(counts)])

    def text(self, row: int) -> bytes:
        return self.data[self.byte_at[row] : self.byte_at[row + 1]].tobytes()

    def row_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, "right") - 1

    def values(self, lo: int, hi: int) -> np.ndarray:
        return self.hashes[lo:hi] if self.spec.words else VALUE[self.data[lo:hi]]

    def _starts(self, lo: int, n: int) -> np.ndarray:
        """Those of the n windows from position lo on that lie inside a document."""
        edge = self.at[np.searchsorted(self.at, lo, "right") : np.searchsorted(self.at, lo + n + self.spec.window)]
        crossing = np.zeros(n + 1, np.int32)
        np.add.at(crossing, np.clip(edge - self.spec.window + 1 - lo, 0, n), 1)
        np.add.at(crossing, np.clip(edge - lo, 0, n), -1)
        return np.flatnonzero(np.cumsum(crossing[:n]) == 0)

    def segments(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(hash, anchor, first window, last window, hash of the content) of the segments, by chunks of positions."""
        L, k, n = self.spec.window, self.spec.gram, int(self.at[-1])
        low = np.uint64((1 << (CHUNK_BITS + 1)) - 1)
        for lo in range(0, n - L + 1, 1 << CHUNK_BITS):
            hi = min(n, lo + (1 << CHUNK_BITS) + L - 1)
            value = self.values(lo, hi)
            h = gram_hash(value, k)
            least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), L - k + 1)
            at = self._starts(lo, hi - L + 1 - lo)
            anchor = (least[at] & low).astype(np.int64)
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
                last = np.concatenate([first[1:] - 1, [len(at) - 1]])
                upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(BASE, len(value)), dtype=np.uint64)])
                content = (upto[at[last] + L] - upto[at[first]]) * _powers(INVERSE, len(value))[at[first]]
                yield h[anchor[first]], anchor[first] + lo, at[first] + lo, at[last] + lo, content


def union_of_equal(ids: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True))


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes, compressed: for rows that carry many values."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in arrays.items()})
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return dict(zip(batch.schema.names, batch.columns, strict=True))


def _hash_lists(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        by_block: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            for block in b.column(0).unique().to_pylist():
                by_block.setdefault(block, []).append(b.filter(pa.compute.equal(b.column(0), block)))
        for block, parts in by_block.items():
            t = pa.Table.from_batches(parts).combine_chunks()
            found = [(x[0], x[4]) for x in Block(t.column(1), t.column(2), spec).segments()]
            h, content = (np.concatenate([*(f[i] for f in found), np.zeros(0, np.uint64)]) for i in (0, 1))
            order = np.lexsort((content, h))
            h, content = h[order], content[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            total = np.diff(np.append(first, len(h)))
            fresh = np.concatenate([[0], np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (content[1:] != content[:-1])]))]) if len(h) else np.zeros(1, np.int64)
            # the least hashes of different segments, up to KINDS an anchor
            anew = np.flatnonzero(np.diff(fresh))
            of = np.searchsorted(first, anew, "right") - 1
            nth = np.arange(len(anew)) - np.searchsorted(of, of)
            anew, of = anew[nth < KINDS], of[nth < KINDS]
            least, told = (content[anew] >> np.uint64(32)).astype(np.uint32), np.bincount(of, minlength=len(first))
            kinds = np.minimum(fresh[np.append(first[1:], len(h))] - fresh[first], 2**31 - 1) if len(h) else total
            h, upto = h[first], np.concatenate([[0], np.cumsum(told)])
            to = h % np.uint64(spec.targets_of_hashes)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(spec.targets_of_hashes + 1, dtype=np.uint64))
            cols = {"h": h, "many": total > 1, "kinds": kinds.astype(np.int32)}
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(least))
            out = [(i, pack(**{k: v[order[a:b]] for k, v in cols.items()}, least=lists.take(pa.array(order[a:b])))) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            if out:
                yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["target", "block", "data"])

    return run


def _shared_hashes(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """For each block, those of its hashes that occur again, here or in another block, and whether they are hot."""
        lists = [(b, unpack(d)) for b, d in zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True)]
        h, many, kinds = (np.concatenate([x[k].to_numpy(zero_copy_only=False) for _, x in lists]) for k in ("h", "many", "kinds"))
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        n = np.diff(np.append(first, len(h)))
        different = np.maximum(_kinds_in_all([x["least"] for _, x in lists], h, h[order][first]), np.maximum.reduceat(kinds[order], first))
        group = np.empty(len(h), np.int64)
        group[order] = np.repeat(np.arange(len(first)), n)
        again, burning = (n[group] > 1) | many, different[group] > hot
        out, at = [], 0
        for b, x in lists:
            mine = slice(at, at := at + len(x["h"]))
            if again[mine].any():
                out.append((b, pack(h=h[mine][again[mine]], hot=burning[mine][again[mine]])))
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "data": pa.array([o[1] for o in out], pa.binary())})

    return run


def _kinds_in_all(told: list[pa.Array], h: np.ndarray, names: np.ndarray) -> np.ndarray:
    """How many different segments each hash of names (in order) has in all blocks, from the least content hashes that each tells."""
    size = np.concatenate([x.value_lengths().to_numpy() for x in told])
    of = np.searchsorted(names, np.repeat(h, size))
    pair = np.unique(of.astype(np.uint64) << np.uint64(32) | np.concatenate([x.flatten().to_numpy() for x in told]).astype(np.uint64))
    of = (pair >> np.uint64(32)).astype(np.int64)
    found = np.bincount(of, minlength=len(names))
    # of more than KINDS the KINDS-th least tells how dense all are
    last = np.minimum(np.searchsorted(of, np.arange(len(names))) + KINDS - 1, len(pair) - 1)
    density = ((pair[last] & np.uint64(2**32 - 1)).astype(np.float64) + 1) / 2**32
    return np.where(found < KINDS, found, np.maximum(found, (KINDS - 1) / density)).astype(np.int64)


def _segments_out(spec: Spec):
    width = spec.window

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        empty = pa.table({"target": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "data": pa.array([], pa.binary()), "marks": pa.array([], pa.binary())})
        if not docs.num_rows or not shared.num_rows:
            return empty
        number = docs.column("block")[0].as_py()
        block = Block(docs.column("id"), docs.column("text"), spec)
        del docs
        lists = [unpack(d) for d in shared.column("data").to_pylist()]
        known, burning = (np.concatenate([x[k].to_numpy(zero_copy_only=False) for x in lists]) for k in ("h", "hot"))
        order = np.argsort(known)
        known, burning = known[order], burning[order]
        seen: set[bytes] = set()
        found: dict[int, list[tuple]] = {}
        mark_row, mark_lo, mark_hi = [], [], []
        words_of, words = -1, []

        def send(body: bytes, h: int, a: int, r: int, lo: int, hi: int, hot: bool) -> None:
            if body in seen:
                mark_row.append(r), mark_lo.append(lo), mark_hi.append(hi + width)
            else:
                seen.add(body)
                # windows of a hot anchor are grouped by their content from here on
                found.setdefault(spec.target(body, a - lo, h, hot), []).append((body, a - lo, r, lo, hi - lo, zlib.crc32(body) if hot else h))

        for h, anchor, first, last, _ in block.segments():
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[place] == h)
            row = block.row_of(first[hit])
            start = block.at[row]
            for r, x, hot, a, lo, hi in zip(row.tolist(), h[hit].tolist(), burning[place[hit]].tolist(), (anchor[hit] - start).tolist(), (first[hit] - start).tolist(), (last[hit] - start).tolist(), strict=True):
                if spec.words:
                    if words_of != r:
                        words_of, words = r, block.text(r).split()
                    part = lambda i, j: b" ".join(words[i:j])
                else:
                    begin = int(block.at[r])
                    part = lambda i, j: block.data[begin + i : begin + j].tobytes()
                if hot:
                    for w in range(lo, hi + 1):
                        send(part(w, w + width), x, w, r, w, w, True)
                else:
                    send(part(lo, hi + width), x, a, r, lo, hi, False)
        out = [(t, _run(part, block.ids), b"") for t, part in found.items()]
        if mark_row:
            out.append((number % spec.targets, b"", pack(row=np.array(mark_row, np.int32), lo=np.array(mark_lo, np.int64), hi=np.array(mark_hi, np.int64))))
        return pa.table({"target": pa.array([o[0] for o in out], pa.int64()), "block": pa.array([number] * len(out), pa.int64()), "data": pa.array([o[1] for o in out], pa.binary()), "marks": pa.array([o[2] for o in out], pa.binary())}) if out else empty

    def _run(part: list[tuple], ids: np.ndarray) -> bytes:
        """A sorted run of the segments' suffixes from their anchors on, front-coded: the length shared with the one before, and the rest."""
        if spec.words:
            bodies, offs = [p[0] for p in part], [p[1] for p in part]
            fields = {"body": pa.array(bodies, pa.large_binary()), "h": np.array([p[5] for p in part], np.uint64)}
        else:
            part.sort(key=lambda p: p[0][p[1] :])
            rights, lefts, offs = [p[0][p[1] :] for p in part], [p[0][: p[1]] for p in part], [p[1] for p in part]
            shared = [0, *map(common, rights, rights[1:])]
            fields = {"shared": np.array(shared, np.int16), "rest": pa.array([r[n:] for r, n in zip(rights, shared, strict=True)], pa.large_binary()), "left": pa.array(lefts, pa.large_binary())}
        return pack(**fields, off=np.array(offs, np.int16), row=np.array([p[2] for p in part], np.int32), id=ids[[p[2] for p in part]], lo=np.array([p[3] for p in part], np.int64), more=np.array([p[4] for p in part], np.int16))

    return run


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, of which the first `at` bytes are known to be equal and not read."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 32
    while step:
        while a[at : at + step] == b[at : at + step] and at + step <= n:
            at += step
        step >>= 1
    return at


def _marked(spec: Spec, judge: Callable):
    def run(table: pa.Table) -> pa.Table:
        out = [(b, m) for b, m in zip(table.column("block").to_pylist(), table.column("marks").to_pylist(), strict=True) if m]
        sent = [(b, unpack(d)) for b, d in zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True) if d]
        if sent:
            out += [(b, pack(row=row.astype(np.int32), lo=lo, hi=hi)) for b, (row, lo, hi) in judge(sent, spec.window)]
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "data": pa.array([o[1] for o in out], pa.binary())})

    return run


def by_source(block: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, tuple]]:
    """Marks split by their block."""
    order = np.argsort(block, kind="stable")
    names, first = np.unique(block[order], return_index=True)
    return [(int(b), (row[i], lo[i], hi[i])) for b, i in zip(names, np.split(order, first[1:]), strict=True)] if len(names) else []


def union(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans [lo, hi)."""
    spans: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def _finished(spec: Spec, finish: Callable[[bytes, list[tuple[int, int]]], dict]):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_units": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_text": pa.array([], pa.binary())})
        block = Block(docs.column("id"), docs.column("text"), spec)
        ids = docs.column("id")
        del docs
        found = [unpack(d) for d in marks.column("data").to_pylist()]
        row, lo, hi = (np.concatenate([*(x[k].to_numpy() for x in found), np.zeros(0, np.int64)]).astype(np.int64) for k in ("row", "lo", "hi"))
        order = np.argsort(row, kind="stable")
        cut = np.searchsorted(row[order], np.arange(len(block.ids) + 1))
        n_units, n_removed, n_spans, kept = [], [], [], []
        for r in range(len(block.ids)):
            mine = order[cut[r] : cut[r + 1]]
            spans = union(lo[mine], hi[mine])
            units, left = finish(block.text(r), spans)
            n_units.append(units), n_removed.append(sum(b - a for a, b in spans)), n_spans.append(len(spans)), kept.append(left)
        numbers = [pa.array(np.array(x, np.int64)[block.of]) for x in (n_units, n_removed, n_spans)]
        return pa.table([ids, *numbers, pa.array(kept, pa.binary()).take(pa.array(block.of))], names=["doc_id", "n_units", "n_removed", "n_spans", "kept_text"])

    return run


def murmur(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of longs."""
    with np.errstate(over="ignore"):
        h = np.full(len(x), 42, np.uint32)
        turn = lambda v, r: v << np.uint32(r) | v >> np.uint32(32 - r)
        for half in (x.astype(np.uint64) & np.uint64(0xFFFFFFFF), x.astype(np.uint64) >> np.uint64(32)):
            h ^= turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
        return (h ^ h >> np.uint32(16)).view(np.int32)


def _block_names(n: int) -> list[int]:
    """Numbers that hash partitioning deals to the partitions 0 .. n - 1, one each."""
    place, name = np.unique(murmur(np.arange(40 * n + 400)) % n, return_index=True)
    names = dict(zip(place.tolist(), name.tolist(), strict=True))
    return [names.get(i, i) for i in range(n)]


def n_blocks(docs: DataFrame) -> int:
    """As many blocks as shuffles have partitions, or more, so that a block has some BLOCK_BYTES of text by the plan's estimate of the table's size on disk."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # without any estimate plans count as 2 ** 63 bytes
    known = size if size < 2**60 else 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), EXPANDS * known // BLOCK_BYTES)


def _suffixes(spec: Spec, each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = Block(batch.column(0), batch.column(1), spec)
            at = np.concatenate([*(x[1] for x in block.segments()), np.zeros(0, np.int64)])
            row = block.row_of(at)
            order = np.lexsort((mix(at.astype(np.uint64) + np.uint64(1)), row))
            nth = np.arange(len(at)) - np.searchsorted(row[order], row[order])
            some = at[order[nth < each]]
            yield pa.record_batch({"suffix": pa.array([block.data[a : a + spec.window].tobytes() for a in some.tolist()], pa.binary())})

    return run


def sampled_splitters(rows: DataFrame, spec: Spec, documents: int = 4000, each: int = 8) -> tuple[bytes, ...]:
    """Bounds of ranges of suffixes, from at most `each` suffixes at anchors of about so many documents. They decide where suffixes go, not what is found."""
    share = min(1.0, documents / max(1, rows.count()))
    some = rows.where(F.xxhash64(F.lit("split"), "id", F.xxhash64("text")) <= int(2**63 * (2 * share - 1)) - (share == 1)).mapInArrow(_suffixes(spec, each), "suffix binary")
    found = sorted({bytes(r["suffix"]) for r in some.collect()})
    cut = np.unique(np.linspace(0, len(found), spec.targets + 1).astype(int)[1:-1])
    return tuple(found[i] for i in cut if i < len(found))


def remove_repeats(docs: DataFrame, judge: Callable, finish: Callable, words: bool, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, n_units, n_removed, n_spans, kept_text (binary)."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = n_blocks(docs)
    spec = Spec(words, window, gram, targets=4 * n, targets_of_hashes=n)
    if not words:
        spec = replace(spec, splitters=sampled_splitters(rows, spec))
    names = F.array(*[F.lit(i).cast("long") for i in _block_names(n)])
    dealt = rows.select(F.get(names, F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(n)).cast("int")).alias("block"), "id", "text").repartition(n, "block")
    lists = dealt.mapInArrow(_hash_lists(spec), "target long, block long, data binary")
    shared = lists.groupBy("target").applyInArrow(_shared_hashes(HOT), "block long, data binary")
    sent = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_segments_out(spec), "target long, block long, data binary, marks binary")
    marks = sent.groupBy("target").applyInArrow(_marked(spec, judge), "block long, data binary")
    return dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_finished(spec, finish), "doc_id long, n_units long, n_removed long, n_spans long, kept_text binary")
