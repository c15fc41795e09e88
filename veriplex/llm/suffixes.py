"""Operator 9, exact substring deduplication over bytes with a logarithmic family of suffix arrays.

windows.py brings together the stretches of bytes around shared anchors. The differing ones of a bucket, by ascending
document, come in batches; a batch gets a suffix array (rank doubling, to the depth of a window), is merge-scanned against
the levels there are, so that each of its windows learns its first document, and becomes a level; levels of equal size
merge, so there are about log(batches) of them.

Defined cases: null text is empty; documents of fewer than WINDOW bytes lose nothing; a window may begin or end inside
a character; a null doc_id is larger than any other; rows of one doc_id never remove each other's bytes; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import table
from .windows import HOT, covered, gathered, without_repeats

WINDOW = 50
GRAM = 20
#: Bytes of a batch, about.
BATCH = 1 << 20
#: Batches whose levels are held at a time, about: a level has a string of a window's length for each of its windows.
MOST = 4


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[0], (keys[order][1:] != keys[order][:-1]).astype(np.uint64)]).astype(np.uint64)
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(new, dtype=np.uint64)
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts by the order of their first ``window`` bytes, True where a new string begins): a suffix array to that depth."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = np.zeros(n, np.uint64)
    for i in range(8):
        keys = (keys << np.uint64(8)) | padded[i:i + n]
    depth = min(8, window)
    rank = _ranks(keys >> np.uint64(8 * (8 - depth)))
    while depth < window:
        step = min(depth, window - depth)
        tail = np.concatenate([rank[step:], np.zeros(step, np.uint64)])
        rank = _ranks(rank * np.uint64(n + 1) + tail)
        depth += step
    order = starts[np.argsort(rank[starts], kind="stable")]
    own = rank[order]
    return order, np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)


class Levels:
    """Sorted strings of ``window`` bytes with the first document of each; a level is (strings, documents, batches in it)."""

    def __init__(self, window: int) -> None:
        self.window, self.levels = window, []

    def add(self, data: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Takes in a batch, whose documents are not smaller than those before, and returns the first document of each start."""
        order = np.empty(0, np.int64)
        if len(starts):
            number = np.full(len(data), -1, np.int64)
            number[starts] = np.arange(len(starts))
            order, new = suffix_order(data, starts, self.window)
        if not len(order):
            return np.empty(0, np.int64)
        heads = np.flatnonzero(new)
        place = number[order]
        first = np.minimum.reduceat(docs[place], heads)
        strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, self.window)[order[heads]]).view(f"S{self.window}")[:, 0]
        for keys, ids, _ in self.levels:
            at = np.minimum(np.searchsorted(keys, strings), len(keys) - 1)
            hit = keys[at] == strings
            first[hit] = np.minimum(first[hit], ids[at[hit]])
        out = np.empty(len(starts), np.int64)
        out[place] = first[np.cumsum(new) - 1]
        self.levels.append((strings, first, 1))
        while len(self.levels) > 1 and self.levels[-1][2] >= self.levels[-2][2]:
            (a, x, m), (b, y, n) = self.levels.pop(), self.levels.pop()
            keys, ids = np.concatenate([b, a]), np.concatenate([y, x])
            sort = np.argsort(keys, kind="stable")
            keys, ids = keys[sort], ids[sort]
            once = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.levels.append((keys[once], np.minimum.reduceat(ids, once), m + n))
        return out


def first_by_levels(data: np.ndarray, sizes: np.ndarray, windows: np.ndarray, ids: np.ndarray, anchors: np.ndarray | None = None, window: int = WINDOW, batch: int = BATCH) -> np.ndarray:
    """The index of windows.py. Stretches of different anchors share no window, so levels are built for some whole anchors at a time."""
    if anchors is not None:
        ends = np.cumsum(sizes)
        new = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        part = (ends[new] - sizes[new]) // (MOST * batch)
        cuts = np.append(new[np.concatenate([[True], part[1:] != part[:-1]])], len(sizes))
        return np.concatenate([first_by_levels(data[int(ends[lo] - sizes[lo]):int(ends[hi - 1])], sizes[lo:hi], windows[lo:hi], ids[lo:hi], None, window, batch) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])
    out = np.empty(int(windows.sum()), np.int64)
    at, begin = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
    order = np.argsort(ids, kind="stable")
    levels = Levels(window)
    number = (np.cumsum(sizes[order]) - 1) // batch
    for own in np.split(order, np.flatnonzero(number[1:] != number[:-1]) + 1):
        n, w = sizes[own], windows[own]
        part = gathered(data, at[own], n)
        inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        starts = np.repeat(np.cumsum(n) - n, w) + inner
        out[np.repeat(begin[own], w) + inner] = levels.add(part, starts, np.repeat(ids[own], w))
    return out


FIELDS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(text: bytes, spans: list) -> tuple:
    starts, ends = covered(len(text), spans) if spans else ((), ())
    kept, at = hashlib.sha256(), 0
    for lo, hi in zip(starts, ends, strict=True):
        kept.update(text[at:lo])
        at = hi
    kept.update(text[at:])
    return len(text), int(sum(ends) - sum(starts)), len(starts), kept.hexdigest()


def _finish_bytes(text: bytes, spans: list) -> tuple:
    starts, ends = covered(len(text), spans) if spans else ((), ())
    kept, at, gone = [], 0, []
    for lo, hi in zip(starts, ends, strict=True):
        kept.append(text[at:lo])
        gone.append(f"{lo}-{hi}")
        at = hi
    return b"".join([*kept, text[at:]]), ",".join(gone)


def suffix_dedup(docs: DataFrame, content: bool = False, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id with counts and digest of what is kept, or, with content, the kept bytes and the removed spans of bytes."""
    if content:
        return without_repeats(docs, False, WINDOW, GRAM, first_by_levels, _finish_bytes, "doc_id long, content binary, removed string", hot)
    return without_repeats(docs, False, WINDOW, GRAM, first_by_levels, _finish, FIELDS, hot)


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
