"""Packing documents into sequences of a fixed number of tokens, as few as a grouping genetic algorithm finds.

1. Documents become token ids (by the coder of `bpe`, pre-tokens remembered as packed ids) with an end mark.
   Only longer ones are cut, into pieces of a whole sequence; the last piece may be shorter. Rows carry lengths, not ids.
2. Whole pieces are sequences. The others are dealt at random to shards of some SHARD pieces, so a shard is bounded whatever
   the corpus, and all shards have its mix of lengths.
3. On each shard ISLANDS populations evolve apart, a group of Spark each, for EPOCHS epochs. An individual is a grouping of
   the pieces into bins. Crossover injects well-filled bins of one parent whole into another, bins that hold a piece twice
   then are dissolved, and what is displaced goes where it fits best: in exchange for less of a bin that it fills better, the
   rest longest first to the bin with least room. Mutation dissolves the emptiest bins. Fewer bins win, then squares of fills. Between epochs each island's elite goes to the next
   island, by a shuffle. An island that has as few bins as lengths allow stops.
4. The best individual of a shard's islands gives the sequences. Bins that are not well filled, up to one piece in
   FREED of the shard (or two bins), are dissolved, and their pieces meet those of other shards in a smaller round, until one shard is
   left; so what a shard loses at its edges is found again, in a number of rounds that grows with the logarithm of the corpus.

All randomness comes from seeds made of shard, island and round: reruns over the same table agree.

Defined results: a null or empty text is its end mark alone; pieces of equal length are ties, ordered by their rows;
rows that repeat an id are packed as rows of their own; a text is encoded as a whole, so the longest one bounds memory;
an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import bpe
from lectern.llm.common import settle, small_batches
from lectern.llm.textblocks import blocks

SHARD = 2048
ISLANDS, EPOCHS = 3, 3
#: Individuals of an island, children that it makes in an epoch, individuals that it sends on.
POPULATION, CHILDREN, ELITE = 6, 8, 2
#: Bins from this fill on are kept by a shard; of the others it gives back one piece in FREED at most.
WELL, FREED = 0.99, 16
#: Most pieces of a bin of which pairs are exchanged.
MEMBERS = 8
#: Bytes of pre-tokens that are merged together.
WIDTHS = (6, 12, 24)
#: Bytes of a generation of pre-tokens and ids that a worker remembers.
CACHE_BYTES = 64 << 20


class PackedIds(bpe.Remembering):
    """Ids by the pre-tokens and pairs of a coder of `bpe`, with short pre-tokens merged as rows of a matrix."""

    def __init__(self, coder: bpe.Bpe):
        super().__init__()
        self.coder, self.fixed, self.split, self.whole, self.ranks = coder, coder.fixed, coder.split, coder.whole, coder.look

    def most(self) -> int:
        return CACHE_BYTES

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens: of many short ones at once, each row of a matrix merges its lowest-ranked pair until it has none; long ones go by `bpe`'s trees."""
        out = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        group = np.searchsorted(WIDTHS, size)
        by_width = {width: np.flatnonzero(group == i).tolist() for i, width in enumerate([*WIDTHS, 0])}
        for i, ids in zip(by_width[0], self.coder.merged([words[i] for i in by_width[0]]), strict=True):
            out[i] = ids
        for width in WIDTHS:
            which = by_width.get(width, [])
            for lo in range(0, len(which), 4096):
                part = which[lo : lo + 4096]
                flat, ends = self._rows([words[i] for i in part], width)
                start = 0
                for i, end in zip(part, ends, strict=True):
                    out[i] = flat[start:end]
                    start = end
        return out

    def _rows(self, words: list[bytes], width: int) -> tuple[bytes, list[int]]:
        """Packed ids of words of at most `width` bytes, one after another, and where each ends."""
        coder, n, col = self.coder, len(words), np.arange(width + 1)
        size = np.array([len(w) for w in words])
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width][col[:width] < size[:, None]] = coder.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ids[np.arange(n), size - 1] = coder.last_id[[w[-1] for w in words]]
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        done, rows = np.empty_like(ids), np.arange(n)
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            go = best < bpe.NONE
            done[rows[~go]] = ids[~go]
            rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
            if not len(rows):
                break
            k = np.arange(len(rows))
            ids[k, at] = coder.made[best]
            # what stands behind the merged pair moves up one place
            ids = np.take_along_axis(ids, np.minimum(col + (col > at[:, None]), width), 1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(col[:-1] + (col[:-1] > at[:, None]), width - 1), 1)
            rank[:, -1] = bpe.NONE
            rank[k, at] = self.ranks(ids[k, at], ids[k, at + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
        kept = done >= 0
        return done[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()


@lru_cache(1)
def _packed(path: str) -> PackedIds:
    return PackedIds(bpe.load(path))


def _cut(name: str, size: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _packed(SparkFiles.get(name))
        for batch in batches:
            for lo, hi, _, _ in blocks(batch.column(1), rows=1024):
                rows, piece, length, crc = [], [], [], []
                for i, ids in enumerate(packed([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        rows.append(lo + i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                k = np.array(piece, np.int64)
                own = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.record_batch([own, pa.array(k.astype(np.int32)), pa.array(k * size), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    docs.sparkSession.sparkContext.addFile(path)
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return rows.mapInArrow(_cut(path.rsplit("/", 1)[-1], size, end_id), schema)


def best_fit(order: list[int], lengths: list[int], fills: list[int], labels: np.ndarray, size: int) -> None:
    """Puts the pieces `order`, one after another, into the fullest bin that has room, or a new one; labels and fills are changed."""
    room: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit r: a bin has r places left
    for b, f in enumerate(fills):
        if f < size:
            room[size - f].append(b)
            some |= 1 << (size - f)
    for i in order:
        n = lengths[i]
        fits = some >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            left, b = size, len(fills)
            fills.append(0)
        labels[i] = b
        fills[b] += n
        left -= n
        if left:
            room[left].append(b)
            some |= 1 << left


class Island:
    """A population of groupings of pieces (longest first) into bins; a grouping is an array of bin numbers."""

    def __init__(self, lengths: np.ndarray, size: int, seed: int):
        self.lengths, self.size, self.rng = lengths.astype(np.int64), size, np.random.default_rng(seed)
        self.list = self.lengths.tolist()
        self.least = max(-(-int(self.lengths.sum()) // size), int((2 * self.lengths > size).sum()))
        self.all: list[tuple[int, int, np.ndarray]] = []

    def add(self, labels: np.ndarray) -> None:
        """labels joins the population, numbered anew; the worst one leaves where it is too many."""
        _, labels = np.unique(labels, return_inverse=True)
        fills = np.bincount(labels, self.lengths).astype(np.int64)
        self.all.append((len(fills), -int((fills**2).sum()), labels))
        self.all.sort(key=lambda x: x[:2])
        del self.all[POPULATION:]

    def settled(self) -> bool:
        return bool(self.all) and self.all[0][0] <= self.least

    def found(self) -> None:
        """First individuals: longest first, and about longest first."""
        noise = [np.zeros(len(self.list)), *self.rng.uniform(-0.1, 0.1, (POPULATION - 1, len(self.list)))]
        for x in noise:
            labels, fills = np.zeros(len(self.list), np.int64), []
            best_fit(np.argsort(-self.lengths * (1 + x), kind="stable").tolist(), self.list, fills, labels, self.size)
            self.add(labels)
            if self.settled():
                return

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a with some well-filled bins of b injected."""
        fills = np.bincount(b, self.lengths)
        by_fill = np.argsort(-fills, kind="stable")[: max(1, len(fills) // 2)]
        inject = np.zeros(len(fills), bool)
        inject[self.rng.choice(by_fill, max(1, int(len(by_fill) * self.rng.uniform(0, 0.3))), replace=False)] = True
        moved = inject[b]
        # bins of a that hold a piece which comes with a bin of b are dissolved
        hit = np.zeros(a.max() + 1, bool)
        hit[a[moved]] = True
        return self._refit(np.where(moved, a.max() + 1 + b, a), hit[a] & ~moved)

    def dissolve(self, a: np.ndarray) -> np.ndarray:
        """a without its emptiest bins and some others, whose pieces are put in again."""
        fills = np.bincount(a, self.lengths)
        gone = np.zeros(len(fills), bool)
        gone[np.argsort(fills, kind="stable")[: 2 + len(fills) // 50]] = True
        gone[self.rng.choice(len(fills), 2 + len(fills) // 50)] = True
        return self._refit(a, gone[a])

    def _refit(self, labels: np.ndarray, out: np.ndarray) -> np.ndarray:
        """labels with the pieces `out` put in again: first in exchange for shorter ones of bins that they fill better, then by best fit."""
        _, kept = np.unique(labels[~out], return_inverse=True)
        new = np.full(len(labels), -1, np.int64)
        new[~out] = kept
        fills = np.bincount(kept, self.lengths[~out]).astype(np.int64).tolist()
        loose = np.flatnonzero(out)[::-1].tolist()  # shortest first
        sizes = [self.list[i] for i in loose]
        at = np.argsort(new, kind="stable")
        ends = np.searchsorted(new[at], np.arange(len(fills) + 1)).tolist()
        at = at.tolist()
        for bin_ in self.rng.permutation(len(fills)).tolist() if loose else []:
            left = self.size - fills[bin_]
            if left <= 0:
                continue
            best = None
            members = at[ends[bin_] : ends[bin_ + 1]]
            pairs = [(x, y) for k, x in enumerate(members) for y in members[k + 1 :]] if len(members) <= MEMBERS else []
            for gone in [*((x,) for x in members), *pairs]:
                was = sum(self.list[x] for x in gone)
                place = bisect_right(sizes, was + left) - 1
                if place >= 0 and sizes[place] > was and (best is None or sizes[place] - was > best[0]):
                    best = sizes[place] - was, place, gone
                    if best[0] == left:
                        break
            if best is None or best[0] < left:
                # two loose pieces for one
                for x in members:
                    if two := self._two(sizes, self.list[x], self.list[x] + left, left if best is None else left - best[0] - 1):
                        gain = sizes[two[0]] + sizes[two[1]] - self.list[x]
                        if best is None or gain > best[0]:
                            best = gain, two, (x,)
            if best is None:
                continue
            gain, place, gone = best
            come = sorted(place if isinstance(place, tuple) else (place,), reverse=True)
            for k in come:
                new[loose.pop(k)] = bin_
                sizes.pop(k)
            for x in gone:
                k = bisect_right(sizes, self.list[x])
                sizes.insert(k, self.list[x])
                loose.insert(k, x)
                new[x] = -1
            fills[bin_] += gain
        best_fit(loose[::-1], self.list, fills, new, self.size)
        return new

    @staticmethod
    def _two(sizes: list[int], above: int, most: int, slack: int) -> tuple[int, int] | None:
        """Places of two sizes whose sum is over `above` and from most - slack to most, of the sums tried the largest."""
        lo, hi, best, found = 0, bisect_right(sizes, most) - 1, max(above, most - slack - 1), None
        while lo < hi:
            both = sizes[lo] + sizes[hi]
            if both > most:
                hi -= 1
            else:
                if both > best:
                    best, found = both, (lo, hi)
                    if both == most:
                        break
                lo += 1
        return found

    def epoch(self) -> None:
        for _ in range(CHILDREN):
            if self.settled():
                return
            a, b = (self.all[min(self.rng.integers(len(self.all), size=2))][2] for _ in range(2))
            self.add(self.dissolve(self.cross(a, b)) if self.rng.random() < 0.3 else self.cross(a, b))


STATE = "shard long, island int, own boolean, lengths binary, groupings binary"


def _row(shard: int, island: int, own: bool, lengths: bytes, groupings: list[np.ndarray]) -> list:
    return [shard, island, own, lengths, b"".join(g.astype("<u2" if len(g) < 1 << 16 else "<u4").tobytes() for g in groupings)]


def _table(rows: list[list]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "island", "own", "lengths", "groupings"])


def _groupings(packed: bytes, n: int) -> list[np.ndarray]:
    return list(np.frombuffer(packed, "<u2" if n < 1 << 16 else "<u4").astype(np.int64).reshape(-1, n)) if packed else []


def _order(table: pa.Table) -> np.ndarray:
    """Places of a shard's rows, longest first."""
    return np.lexsort((table.column("rid").to_numpy(), -table.column("length").to_numpy()))


def _islands(table: pa.Table) -> pa.Table:
    lengths = table.column("length").to_numpy()[_order(table)].astype("<i4").tobytes()
    shard = table.column("shard")[0].as_py()
    return _table([_row(shard, i, True, lengths, []) for i in range(ISLANDS)])


def _evolve(size: int, epoch: int, level: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (not r["own"], r["groupings"]))
        lengths, shard, at = rows[0]["lengths"], rows[0]["shard"], rows[0]["island"]
        n = len(lengths) // 4
        island = Island(np.frombuffer(lengths, "<i4"), size, ((level * 8 + epoch) << 40) + shard * ISLANDS + at)
        for r in rows:
            for g in _groupings(r["groupings"], n):
                island.add(g)
        if not island.all:
            island.found()
        island.epoch()
        own = [g for *_, g in island.all]
        return _table([_row(shard, at, True, lengths, own), _row(shard, (at + 1) % ISLANDS, False, b"", own[:ELITE])])

    return run


def _assign(size: int, last: bool, names: list[str]):
    def run(rows: pa.Table, states: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(_order(rows)))
        lengths, rid = rows.column("length").to_numpy(), rows.column("rid").to_numpy()
        best = Island(lengths, size, 0)
        for r in sorted(states.to_pylist(), key=lambda r: r["island"]):
            for g in _groupings(r["groupings"], len(lengths)):
                best.add(g)
        labels = best.all[0][2]
        order = np.argsort(labels, kind="stable")
        first = np.flatnonzero(np.diff(labels[order], prepend=-1))
        upto = np.cumsum(lengths[order]) - lengths[order]
        offset, fills = np.empty(len(labels), np.int64), np.bincount(labels, lengths)
        offset[order] = upto - upto[first][labels[order]]
        free = np.zeros(len(fills), bool)
        if not last:
            by_fill = np.argsort(fills, kind="stable")
            upto = np.cumsum(np.bincount(labels)[by_fill])
            # two bins anyhow, if they are no more than half of all
            few = (upto <= len(labels) // FREED) | (np.arange(len(fills)) < 2) & (upto <= len(labels) // 2)
            free[by_fill[(fills[by_fill] < WELL * size) & few]] = True
        own = [rows.column(c) for c in names]
        return pa.table([*own, pa.array(rid[order][first][labels]), pa.array(offset), pa.array(free[labels])], names=[*names, "sequence_id", "offset", "free"])

    return run


def pack_pieces(rows: DataFrame, size: int = 2048) -> DataFrame:
    """rows (with rid, a number of its own for each, and length < size) with sequence_id, the rid of one piece of the sequence, and offset."""
    columns, done, level = rows.columns, [], 0
    while True:
        n = rows.count()
        shards = max(1, -(-n // SHARD))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(shards)))
        states = dealt.select("shard", "rid", "length").groupBy("shard").applyInArrow(_islands, STATE)
        # few bytes and much work: a number of partitions that is given is not made smaller
        parts = max(1, min(shards * ISLANDS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        for epoch in range(EPOCHS):
            states = states.repartition(parts, "shard", "island").groupBy("shard", "island").applyInArrow(_evolve(size, epoch, level), STATE)
        best = states.where("own").groupBy("shard")
        schema = rows.schema.add("sequence_id", "long").add("offset", "long").add("free", "boolean")
        out = settle(dealt.groupBy("shard").cogroup(best).applyInArrow(_assign(size, shards == 1, columns), schema))
        done.append(out.where("NOT free").drop("free"))
        if shards == 1:
            break
        rows, level = out.where("free").select(*columns), level + 1
        if rows.isEmpty():
            break
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionAll(more)
    return packed


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = settle(pieces(docs, path, size, end_id, id_col, text_col)).withColumn("rid", F.monotonically_increasing_id())
    whole = rows.where(F.col("length") == size).withColumns({"sequence_id": F.col("rid"), "offset": F.lit(0).cast("long")})
    return whole.unionByName(pack_pieces(rows.where(F.col("length") < size), size)).drop("rid")
