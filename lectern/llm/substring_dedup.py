"""Substring de-duplication: words covered by a window of `window` words that also starts earlier in the corpus go.

Reference shards are passages that share anchors, gathered by repeats.py, equal passages once; a shard takes whole
anchors until it has SHARD_WORDS words, and an anchor has at most some repeats.HOT different passages (the windows of
others go one by one), so an automaton's size is bounded. A shard's suffix automaton is built over its passages in corpus order, so each state
knows where its words first occur. The shard's documents are then streamed through it: the matching statistic at a
word is the length of the longest suffix that the automaton holds; where it reaches `window`, the state of the last
`window` words is found by suffix links, and if they occur first at an earlier place, the window is a repeat. Maximal
spans of repeats are removed.

An automaton goes only to the documents that share an anchor with its shard, not to all of them: every automaton
against every document would be work of the square of the corpus, and lose nothing by this.

Defined results are those of repeats.py: null text empty, equal (id, text) rows one document, null ids first; other
columns are not read and empty tables give empty results. Windows never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from lectern.llm.repeats import by_source, remove_repeats


#: Words after which a shard takes no further anchor.
SHARD_WORDS = 50_000


class SuffixAutomaton:
    """Of several word sequences, added in order; `first` is where a state's words first end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, words: list, end: int) -> None:
        """Add a sequence; the first word ends at place `end`."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[last] + 1)
                    link.append(link[q])
                    first.append(first[q])
                    link[q] = clone
                    p = last
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
                    last = clone
                end += 1
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            first.append(end)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    first.append(first[q])
                    link[q] = link[new] = clone
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
            last = new
            end += 1

    def repeats(self, words: list, start: int, window: int) -> list[int]:
        """Starts in `words`, whose first word stands at place `start`, of windows that occur first at an earlier place."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, match, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                match = length[state]
            q = nxt[state].get(w)
            if q is None:
                state, match = 0, 0
                continue
            state, match = q, match + 1
            if match >= window:
                while length[link[state]] >= window:
                    state = link[state]
                    match = length[state]
                if first[state] < start + i:
                    out.append(i - window + 1)
        return out


def judge(sent: list[tuple[int, dict]], window: int) -> list[tuple[int, tuple]]:
    """Spans of words that an earlier equal window covers, by block."""
    block = np.repeat([b for b, _ in sent], [len(x["row"]) for _, x in sent])
    row, key, lo, more, h = (np.concatenate([x[k].to_numpy() for _, x in sent]) for k in ("row", "id", "lo", "more", "h"))
    body = [s for _, x in sent for s in x["body"].to_pylist()]
    which, first, last = [], [], []
    # passages of one anchor, in corpus order, one after another
    order = np.lexsort((lo, row, key, h))
    ends = np.append(np.flatnonzero(h[order][1:] != h[order][:-1]) + 1, len(order)).tolist()
    start, size = 0, 0
    for a, b in zip([0, *ends], ends, strict=False):
        size += sum(body[i].count(b" ") + 1 for i in order[a:b].tolist())
        if size >= SHARD_WORDS or b == len(order):
            for i, x, y in _shard(order[start:b].tolist(), body, more, window):
                which.append(i), first.append(x), last.append(y)
            start, size = b, 0
    at = np.array(which, np.int64)
    return by_source(block[at], row[at], lo[at] + np.array(first, np.int64), lo[at] + np.array(last, np.int64))


def _shard(members: list[int], body: list[bytes], more: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """(passage, first word, end) of the repeats in a shard's passages, which come in corpus order anchor by anchor."""
    automaton, at = SuffixAutomaton(), 0
    places: set[bytes] = set()
    fresh: list[tuple[int, list, int]] = []
    for i in members:
        if body[i] in places:  # the whole passage is in the shard already
            yield i, 0, int(more[i]) + window
            continue
        places.add(body[i])
        words = body[i].split(b" ")
        automaton.add(words, at)
        fresh.append((i, words, at))
        at += len(words) + 1
    for i, words, start in fresh:
        first = last = -2
        for s in automaton.repeats(words, start, window):
            if s != last + 1:
                if last >= 0:
                    yield i, first, last + window
                first = s
            last = s
        if last >= 0:
            yield i, first, last + window


def finish(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    words = text.split()
    at, parts = 0, []
    for a, b in spans:
        parts += words[at:a]
        at = b
    return len(words), b" ".join([*parts, *words[at:]])


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_units (words), n_removed, n_spans, kept_text (words joined by one space)."""
    return remove_repeats(docs, judge, finish, True, window, gram, id_col, text_col)
