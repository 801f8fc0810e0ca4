"""Words, lines and rolling hashes of many texts at once, over the UTF-8 bytes of an Arrow column.

A block is the bytes of consecutive texts, about BLOCK_BYTES of them (one longer text is a block of its own), so
memory is bounded by a block or by the longest text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: White space that separates words. Fixed values.
WHITE = b" \t\n\x0b\x0c\r"
IS_WORD = np.ones(256, bool)
IS_WORD[list(WHITE)] = False
#: ASCII lower case. Fixed values.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
#: A random number for each byte value, and an odd base for positions.
VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_pow = np.ones(1, np.uint64)


def forget() -> None:
    """Frees what other operators remember in this worker, which may have served them before."""
    if (bpe := sys.modules.get("lectern.llm.bpe")) is not None:
        bpe.forget()


def powers(n: int) -> np.ndarray:
    """BASE ** (0 .. n-1) modulo 2 ** 64."""
    global _pow
    while len(_pow) < n:
        step = np.uint64(pow(BASE, len(_pow), 2**64))
        _pow = np.concatenate([_pow, _pow * step])
    return _pow[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits; works in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts or binaries (null: empty), and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES, rows: int = 2048) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of the blocks of a column, each of at most so many rows."""
    data, at = text_bytes(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = min(max(row + 1, int(np.searchsorted(at, at[row] + block_bytes, "right")) - 1), row + rows)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set bytes inside each row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    full = at[1:] > at[:-1]
    first[at[:-1][full]] = mask[at[:-1][full]]
    last[at[1:][full] - 1] = mask[at[1:][full] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUE, lengths: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are not empty, in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum()), dtype=np.int64)
    place = within - np.repeat(first, size)
    byte = data[within + np.repeat(starts - first, size)]
    h = np.add.reduceat(values[byte] * powers(int(size.max()))[place], first)
    return mix(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if lengths else mix(h)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive numbers of h (len(h) - k + 1 of them, at least none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = powers(k + 1)
    done, width, have = np.zeros(n, np.uint64), h, 1
    left, at = k, 0
    while left:  # binary expansion of k, with hashes of 1, 2, 4, ... numbers
        if left & 1:
            done += width[at : at + n] * base[at]
            at += have
        left >>= 1
        if left:
            width = width[:-have] + width[have:] * base[have]
            have *= 2
    return mix(done)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive numbers of x."""
    if len(x) < w:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x
