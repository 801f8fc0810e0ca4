"""Suffix-array de-duplication: bytes covered by a `window`-byte string that also starts earlier in the corpus go.

The suffixes sorted are those at anchors (see repeats.py), a sparse suffix array whose windows are complete; at hot
anchors every window is a suffix of its own. Targets are ranges of the suffix order, cut at sampled suffixes, so the
targets one after another are that order. Each block sends each target a sorted run, front-coded: the length a suffix
shares with the one before it, and the rest. A target merges
its runs with a loser tree that carries common-prefix lengths: two suffixes that share different lengths with the last
one put out are ordered by those lengths, and equal lengths are compared from there on, so no known prefix is read
again. The merged order with its prefix lengths tells which right contexts agree how far, a sort of the left contexts
the same to the left, and a window repeats an earlier one if both agree. Strings are compared, not hashes.

Defined results are those of repeats.py: null text empty, equal (id, text) rows one document, null ids first; other
columns are not read and empty tables give empty results. Matches never cross documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lectern.llm.repeats import by_source, common, remove_repeats


def decode_run(shared: list[int], rest: list[bytes]) -> list[bytes]:
    out, last = [], b""
    for n, r in zip(shared, rest, strict=True):
        last = last[:n] + r
        out.append(last)
    return out


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs, each with the common-prefix length of a string and the one before: (run, place in it, common-prefix length with the string put out before) of all strings in order.

    A loser tree whose nodes hold the loser of a match and how much of it equals the winner; a run that has ended has -1.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    head = [r[0] if r else b"" for r in runs] + [b""] * (k - len(runs))
    know = [0 if r else -1 for r in runs] + [-1] * (k - len(runs))
    loser = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known length becomes that with the winner."""
        x, y = know[a], know[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        n = common(head[a], head[b], x)
        if head[a][n:] <= head[b][n:]:
            know[b] = n
            return a, b
        know[a] = n
        return b, a

    winners = [*range(k)]
    level = k
    while level > 1:
        nxt = []
        for i in range(0, level, 2):
            w, lo = match(winners[i], winners[i + 1])
            loser[(level + i) // 2] = lo
            nxt.append(w)
        winners = nxt
        level //= 2
    top = winners[0]
    out_run, out_place, out_know = [], [], []
    while know[top] >= 0:
        out_run.append(top)
        at = place[top]
        out_place.append(at)
        out_know.append(know[top])
        at += 1
        place[top] = at
        run = runs[top]
        if at < len(run):
            head[top], know[top] = run[at], shared[top][at]
        else:
            know[top] = -1
        node = (k + top) // 2
        while node:
            other = loser[node]
            x, y = know[top], know[other]
            if x < y:
                loser[node] = top
                top = other
            elif x == y and x >= 0:
                top, loser[node] = match(top, other)
            node //= 2
    return out_run, out_place, out_know


def judge(sent: list[tuple[int, dict]], window: int) -> list[tuple[int, tuple]]:
    """Spans of bytes that an earlier equal window covers, by block."""
    runs = [decode_run(x["shared"].to_pylist(), x["rest"].to_pylist()) for _, x in sent]
    run, place, know = merge_runs(runs, [x["shared"].to_pylist() for _, x in sent])
    base = np.cumsum([0] + [len(r) for r in runs])
    at = base[run] + np.array(place)
    col = {k: np.concatenate([x[k].to_numpy() for _, x in sent]).astype(np.int64)[at] for k in ("off", "row", "id", "lo", "more")}
    block = np.repeat([b for b, _ in sent], np.diff(base))[at]
    left = [s for _, x in sent for s in x["left"].to_pylist()]
    left = [left[i] for i in at.tolist()]
    know = np.array(know)
    n = len(at)
    size = col["more"] + window - col["off"]
    order = np.lexsort((col["lo"], col["row"], col["id"]))  # earliest first
    # equal segments: the earliest stays, the others are repeats as a whole
    right_class = np.cumsum(np.concatenate([[True], (know[1:] < size[1:]) | (size[1:] != size[:-1])])) if n else np.zeros(0, np.int64)
    names: dict[bytes, int] = {}
    left_class = np.array([names.setdefault(s, len(names)) for s in left], np.int64)
    whole = np.zeros(n, bool)
    whole[order] = pd.Series((right_class * max(1, len(names)) + left_class)[order]).duplicated().to_numpy()
    out = [(block[whole], col["row"][whole], col["lo"][whole], col["lo"][whole] + col["more"][whole] + window)]
    order = order[~whole[order]]
    off, more, lo, row, source = (x[order] for x in (col["off"], col["more"], col["lo"], col["row"], block))
    # left contexts, read from the anchor backwards: their order, and how much neighbours share
    back = [left[i][::-1] for i in order.tolist()]
    by_left = sorted(range(len(back)), key=back.__getitem__)
    share = np.array([0, *(common(back[a], back[b]) for a, b in zip(by_left, by_left[1:], strict=False))])
    rank = np.empty(len(back), np.int64)
    rank[by_left] = np.arange(len(back))
    hits = np.zeros((len(back), window), bool)
    for o in range(int(off.max()) + 1 if len(off) else 0):  # windows that start o bytes before their anchor
        here = np.flatnonzero((o <= off) & (o >= off - more))
        right = np.cumsum(know < window - o)[order[here]]
        lefts = np.cumsum(share < o)[rank[here]]
        again = pd.Series(right * (len(back) + 1) + lefts).duplicated().to_numpy()
        hits[here[again], (off[here] - o)[again]] = True
    edge = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    which, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    out.append((source[which], row[which], lo[which] + first, lo[which] + last - 1 + window))
    return by_source(*(np.concatenate(x) for x in zip(*out, strict=True)))


def finish(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return len(text), b"".join([*parts, text[at:]])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, gram: int = 24) -> DataFrame:
    """One row per row of docs: doc_id, n_units (bytes), n_removed, n_spans, kept_text (binary: a span may end inside a character)."""
    return remove_repeats(docs, judge, finish, False, window, gram, id_col, text_col)
