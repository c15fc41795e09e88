"""Operator 8, substring deduplication over words with suffix automata of reference shards.

windows.py brings together the stretches of text around shared anchors. Those that differ are the reference of their
bucket; it is cut into shards of SHARD words at most, a suffix automaton is built of each, every state knowing the
smallest document that its strings come from, and the stretches stream through it for matching statistics: wherever
WINDOW words match, the state of just these words names the first document. Maximal runs of covered words go.

Defined cases: null text has no words; documents of fewer than WINDOW words lose nothing; a null doc_id is larger than
any other; rows of one doc_id never remove each other's words; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import table
from .windows import HOT, LAST, covered, without_repeats

WINDOW = 50
GRAM = 16
#: Words of a reference shard, about: it closes at the end of an anchor, or within one at four times as many.
SHARD = 20_000


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of hashable units; first[state] is the smallest id of its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [LAST]
        self.ready = True

    def _state(self, size: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        self.first.append(LAST)
        return len(self.size) - 1

    def _clone(self, p: int, q: int, unit) -> int:
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(unit) == q:
            self.next[p][unit] = copy
            p = self.link[p]
        return copy

    def add(self, units, doc: int) -> None:
        nxt, link, size, first = self.next, self.link, self.size, self.first
        last = 0
        for unit in units:
            q = nxt[last].get(unit)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._clone(last, q, unit)
            else:
                new = self._state(size[last] + 1, {}, 0)
                p = last
                while p >= 0 and unit not in nxt[p]:
                    nxt[p][unit] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][unit]
                    link[new] = q if size[q] == size[p] + 1 else self._clone(p, q, unit)
                last = new
            if doc < first[last]:
                first[last] = doc
        self.ready = False

    def close(self) -> None:
        """Hands the smallest ids down the suffix links."""
        for v in np.argsort(np.array(self.size), kind="stable")[:0:-1].tolist():
            p = self.link[v]
            if self.first[v] < self.first[p]:
                self.first[p] = self.first[v]
        self.ready = True

    def matches(self, units, window: int) -> list[int]:
        """For each window of units the smallest id of a sequence that it occurs in, LAST if in none."""
        if not self.ready:
            self.close()
        nxt, link, size, first = self.next, self.link, self.size, self.first
        out, v, n = [], 0, 0
        for i, unit in enumerate(units):
            while v and unit not in nxt[v]:
                v = link[v]
                n = size[v]
            if unit in nxt[v]:
                v = nxt[v][unit]
                n += 1
            while v and size[link[v]] >= window:
                v = link[v]
                n = size[v]
            if i >= window - 1:
                out.append(first[v] if n >= window else LAST)
        return out


def first_by_automata(data: np.ndarray, sizes: np.ndarray, windows: np.ndarray, ids: np.ndarray, anchors: np.ndarray, window: int = WINDOW, shard: int = SHARD) -> np.ndarray:
    """The index of windows.py. A shard is of whole anchors; an anchor of more words has several, and all its stretches stream through each."""
    out = np.full(int(windows.sum()), LAST, np.int64)
    ends, edges = np.cumsum(sizes), np.append(0, np.cumsum(windows))
    words = windows + window - 1
    new = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    totals = np.add.reduceat(words, new)
    number = (np.cumsum(totals) - 1) // shard
    runs = np.append(new[np.flatnonzero(np.append(True, number[1:] != number[:-1]))], len(sizes)).tolist()
    for lo, hi in zip(runs[:-1], runs[1:], strict=True):
        raw, base = data[ends[lo] - sizes[lo]:ends[hi - 1]].tobytes(), ends[lo] - sizes[lo]
        texts = [raw[e - n:e].split(b" ") for e, n in zip((ends[lo:hi] - base).tolist(), sizes[lo:hi].tolist(), strict=True)]
        parts = (np.cumsum(words[lo:hi]) - 1) // (4 * shard)
        cuts = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), hi - lo).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            automaton = SuffixAutomaton()
            for i in range(a, b):
                automaton.add(texts[i], int(ids[lo + i]))
            for i, units in enumerate(texts):
                own = slice(edges[lo + i], edges[lo + i + 1])
                out[own] = np.minimum(out[own], automaton.matches(units, window))
    return out


FIELDS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _finish(text: bytes, spans: list) -> tuple:
    words = text.split()
    starts, ends = covered(len(words), spans) if spans else ((), ())
    kept, at = [], 0
    for lo, hi in zip(starts, ends, strict=True):
        kept += words[at:lo]
        at = hi
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _finish_text(text: bytes, spans: list) -> tuple:
    words = text.split()
    starts, ends = covered(len(words), spans) if spans else ((), ())
    kept, at, gone = [], 0, []
    for lo, hi in zip(starts, ends, strict=True):
        kept += words[at:lo]
        gone.append(f"{lo}-{hi}")
        at = hi
    kept += words[at:]
    return b" ".join(kept).decode("utf-8", "replace"), ",".join(gone)


def substring_dedup(docs: DataFrame, text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id with counts and digest of what is kept, or, with text, the kept words and the removed spans of words."""
    if text:
        return without_repeats(docs, True, WINDOW, GRAM, first_by_automata, _finish_text, "doc_id long, text string, removed string", hot)
    return without_repeats(docs, True, WINDOW, GRAM, first_by_automata, _finish, FIELDS, hot)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
