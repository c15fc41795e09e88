"""Operator 5, conflict-constrained best-fit packing.

Documents longer than a bin give pieces that fill bins of their own and a rest. Pieces are packed by falling size; the
bin is the tightest one that the piece fits and whose bitmaps hold neither the piece's source nor its cluster of
duplicates, else a new one. Bins stand in order of their residual; over them lies a tree of bitmap intersections, so
that the successor search passes over any run of bins that all hold the piece's source or cluster in one step, and ends
at the tightest compatible bin. Sources and clusters of over OWN_BIT pieces in a shard have bits; rarer ones are held
in sets, and can turn down OWN_BIT bins at most.

Documents are dealt to packing shards of about SHARD rows by a hash; bins do not cross shards, so memory is bounded and a lost task
is repeated alone. Which bin a document gets depends on nothing but its shard's rows.

Defined cases: null text has no words, and documents without words are given bin null; a null source is a source of its
own; rows repeated with one doc_id are copies of each other, in any order among equal ones; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table, text_of, word_count
from .exact import normalised

CAPACITY = 2048
SHARD = 20_000
OWN_BIT = 32


class Bins:
    """Open bins by residual, with the successor search over bitmaps."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        # A node's bitmap is what all bins below it hold; -1, all bits, where there is no bin.
        self.tree = [-1] * (2 * self.leaves)
        self.at: list[dict[int, list[int]]] = [{} for _ in range(self.leaves)]  # residual -> bitmap -> bins
        self.rare: list[set] = []
        self.bits: list[int] = []
        self.left: list[int] = []

    def _lift(self, residual: int) -> None:
        i = residual + self.leaves
        value = -1
        for bits in self.at[residual]:
            value &= bits
        self.tree[i] = value
        i >>= 1
        while i:
            new = self.tree[2 * i] & self.tree[2 * i + 1]
            if new == self.tree[i]:
                break
            self.tree[i] = new
            i >>= 1

    def _next(self, residual: int, masks: tuple[int, ...]) -> int:
        """The smallest residual, from the given one on, with a bin below which some bitmap may be free of all masks; -1 if none."""
        i = residual + self.leaves
        if self._open(i, masks):
            return residual
        while i > 1:
            if not i & 1 and self._open(i + 1, masks):
                i += 1
                while i < self.leaves:
                    i = 2 * i if self._open(2 * i, masks) else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def _open(self, i: int, masks: tuple[int, ...]) -> bool:
        value = self.tree[i]
        return value != -1 and not any(value & m for m in masks)

    def place(self, size: int, masks: tuple[int, ...], rare: tuple) -> int:
        """Puts a piece into the tightest compatible bin, the oldest of equals, and returns the bin."""
        residual, own = size, 0
        for m in masks:
            own |= m
        while residual <= self.capacity and (residual := self._next(residual, masks)) >= 0:
            best = min((b for bits, bins in self.at[residual].items() if not bits & own for b in bins if not any(r in self.rare[b] for r in rare)), default=None)
            if best is not None:
                self._remove(best)
                self.left[best] -= size
                self.bits[best] |= own
                self.rare[best].update(rare)
                self._insert(best)
                return best
            residual += 1
        self.left.append(self.capacity - size)
        self.bits.append(own)
        self.rare.append(set(rare))
        self._insert(len(self.left) - 1)
        return len(self.left) - 1

    def _remove(self, b: int) -> None:
        bins = self.at[self.left[b]][self.bits[b]]
        bins.remove(b)
        if not bins:
            del self.at[self.left[b]][self.bits[b]]
        self._lift(self.left[b])

    def _insert(self, b: int) -> None:
        if self.left[b]:
            self.at[self.left[b]].setdefault(self.bits[b], []).append(b)
            self._lift(self.left[b])


def pack(pieces: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each piece (size, source, cluster), given by falling size; sizes from 1 to capacity."""
    counts = Counter(("s", s) for _, s, _ in pieces) + Counter(("c", c) for _, _, c in pieces)
    bit = {k: 1 << i for i, k in enumerate(k for k, n in counts.items() if n > OWN_BIT)}
    bins = Bins(capacity)
    out = []
    for size, source, cluster in pieces:
        keys = (("s", source), ("c", cluster))
        out.append(bins.place(size, tuple(bit[k] for k in keys if k in bit), tuple(k for k in keys if k not in bit)))
    return out


PACKED = "shard long, doc_id long, piece int, first long, n_words long, bin int, bin_order int"


def _pack_shard(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "cluster", "size"], na_position="first", kind="stable")
        ids, sizes = frame["doc_id"].tolist(), frame["size"].to_numpy()
        source, cluster = [None if x is None else str(x) for x in frame["source"].tolist()], frame["cluster"].tolist()
        full, rest = sizes // capacity, sizes % capacity
        rows, n_bins = [], 0
        for i in np.flatnonzero(full).tolist():
            for piece in range(int(full[i])):
                rows.append((ids[i], piece, piece * capacity, capacity, n_bins, 0))
                n_bins += 1
        order = [i for i in np.argsort(-rest, kind="stable").tolist() if rest[i]]
        used: Counter = Counter()
        for i, b in zip(order, pack([(int(rest[i]), source[i], cluster[i]) for i in order], capacity), strict=True):
            rows.append((ids[i], int(full[i]), int(full[i]) * capacity, int(rest[i]), n_bins + b, used[b]))
            used[b] += 1
        rows += [(ids[i], 0, 0, 0, None, None) for i in np.flatnonzero(sizes == 0).tolist()]
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "first", "n_words", "bin", "bin_order"], dtype=object)
        for c in ("doc_id", "piece", "first", "n_words", "bin", "bin_order"):
            out[c] = out[c].astype("Int64")
        out.insert(0, "shard", frame["shard"].iloc[0])
        return out
    return run


def best_fit(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Per piece of docs (doc_id, source, text): shard, doc_id, piece, first, n_words, bin, bin_order. (shard, bin) is a bin."""
    text = text_of()
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(normalised(text), F.crc32(normalised(text).cast("binary"))).alias("cluster")), "pieces")
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))
    return rows.groupBy("shard").applyInPandas(_pack_shard(capacity), PACKED)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
