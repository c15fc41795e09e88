"""Operator 6, SimHash near-duplicates through pivot distance tables.

Fingerprints differing in at most ``RADIUS`` = 3 bits agree on one of any four groups of bits, so rows meet in the
buckets of such groups (two levels deep: 16 buckets of 28 fixed bits a fingerprint). In a bucket every fingerprint gets
a table of Hamming distances to PIVOTS reference fingerprints; by the triangle inequality a pair whose tables differ by
over RADIUS in any coordinate is discarded, and the survivors are verified bit by bit. A bucket of over BUCKET
fingerprints is split again by four groups of its free bits, which ends at 2**11 fingerprints at the latest: nothing is
capped. Only distinct fingerprints meet, and a task reports a spanning forest of its links, not all pairs.

Defined cases: null text is the empty text; texts without a word have fingerprint zero and are linked like any other;
documents with fewer words than a shingle have one shingle; repeated rows share their result; a null doc_id gets a
fingerprint and counts as the largest id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, partitions, slices, stage, text_of
from .exact import flagged, settled
from .windows import gathered, mixed

RADIUS = 3
PIVOTS = 32
BUCKET = 4096
_FULL = (1 << 64) - 1


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash over the word shingles of text, repeats included: a bit is set if it is in over half of the hashes."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    n = max(1, len(found) - words + 1)
    hashes = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in (own for whole in batches for own in slices(whole)):
            prints = [fingerprint(t or "", words, seed) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "key", "fp"])
    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, key, fp): key is a hash of the text that tells rows of one doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    return rows.mapInArrow(_fingerprints(words, seed), "doc_id long, key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_bits(mask: int) -> list[int]:
    """Four masks, each with one of four groups of the bits that mask leaves free."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return [mask | sum(free[i * len(free) // 4:(i + 1) * len(free) // 4]) for i in range(4)]


def _pivots() -> np.ndarray:
    return np.random.default_rng(64).integers(0, _FULL, PIVOTS, np.uint64, endpoint=True)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches over the links (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def links(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of prints (sorted by bucket) in one bucket and within radius, found through the pivot table."""
    table = np.bitwise_count(prints[:, None] ^ _pivots()[None, :]).astype(np.int8)
    end = np.repeat(starts + sizes, sizes)
    left, right = [], []
    for shift in range(1, int(sizes.max(initial=1))):
        i = np.flatnonzero(np.arange(len(prints)) + shift < end)
        if not len(i):
            break
        for chunk in np.array_split(i, len(i) // 100_000 + 1):
            for at in range(0, PIVOTS, 8):
                chunk = chunk[np.abs(table[chunk, at:at + 8] - table[chunk + shift, at:at + 8]).max(axis=1, initial=0) <= radius]
            chunk = chunk[np.bitwise_count(prints[chunk] ^ prints[chunk + shift]) <= radius]
            left.append(chunk)
            right.append(chunk + shift)
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def _bucket_links(batches):
    """Rows (mask, value, fp) sorted by bucket -> links (mask null, a, b), or the rows of large buckets, split (mask, value, fp)."""
    kept = np.zeros((0, 3), np.uint64)
    large = None  # the bucket that has overflowed

    def overflow(rows):
        out = []
        for mask in np.unique(rows[:, 0]).tolist():
            own = rows[rows[:, 0] == mask, 2]
            out += [np.stack([np.full(len(own), m, np.uint64), own & np.uint64(m), own], axis=1) for m in split_bits(mask)]
        out = np.concatenate(out).view(np.int64)
        return pa.record_batch([pa.array(out[:, i].copy()) for i in range(3)], ["mask", "a", "b"])

    def solve(rows):
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(rows)))
        a, b = links(rows[:, 2], starts, sizes)
        if len(a):
            root = _forest(a, b, len(rows))
            own = np.flatnonzero(root != np.arange(len(rows)))
            pairs = np.unique(np.stack([rows[own, 2], rows[root[own], 2]], axis=1), axis=0).view(np.int64)
            yield pa.record_batch([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["mask", "a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", "fp")], axis=1).view(np.uint64)
        if large is not None:
            same = (rows[:, :2] == large).all(axis=1)
            if same.any():
                yield overflow(rows[same])
            rows = rows[~same]
            if not len(rows):
                continue
            large = None
        rows = np.concatenate([kept, rows])
        if not len(rows):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(rows)))
        for s, n in zip(starts[sizes > BUCKET].tolist(), sizes[sizes > BUCKET].tolist(), strict=True):
            yield overflow(rows[s:s + n])
        if sizes[-1] > BUCKET:
            large, kept = rows[-1, :2].copy(), rows[:0]
        else:
            kept = rows[starts[-1]:]
        done = np.repeat(sizes <= BUCKET, sizes)
        done[starts[-1]:] = False
        if done.any():
            yield from solve(rows[done])
    if len(kept):
        yield from solve(kept)


def near_links(prints: DataFrame, n: int | None = None) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints of ``prints`` (fp; ``n`` at most) within RADIUS into one component."""
    spark = prints.sparkSession
    masks = [_signed(m) for first in split_bits(0) for m in split_bits(first)]
    rows = prints.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
    found = None
    while True:
        out = stage(rows.repartition(partitions(spark), "mask", "value").sortWithinPartitions("mask", "value", "fp")
                    .mapInArrow(_bucket_links, "mask long, a long, b long"), "links", n and 16 * n)
        part = out.where("mask is null").select("a", "b")
        found = part if found is None else found.union(part)
        rows = out.where("mask is not null").select("mask", F.col("a").alias("value"), F.col("b").alias("fp"))
        if rows.isEmpty():
            return found.distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """Per input row: doc_id, key, fp, component_id."""
    rows = stage(fingerprints(docs, words, seed), "prints")
    n = rows.count()
    return classified(rows, near_links(rows.select("fp").distinct(), n), n=n)


def classified(rows: DataFrame, found: DataFrame, on: str = "fp", n: int | None = None) -> DataFrame:
    """rows (doc_id, key, ``on``; ``n`` of them) with component_id, the smallest doc_id that the links (a, b) between fingerprints (or what else ``on`` is) reach."""
    prints = stage(rows.groupBy(on).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct", n)
    node = components(found).withColumnRenamed("node", on)
    joined = prints.join(node, on, "left").withColumn("component", F.coalesce("component", on))
    joined = stage(joined, "classes", n)
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    classes = stage(attach(joined.select(on, "component", F.col("n").alias("rows")), least, "component", "n", F.col(on)), "classes", n)
    return attach(rows, classes.select(on, "rows", "component_id"), on, "rows", F.struct("doc_id", "key"))


@functools.cache
def _factors() -> np.ndarray:
    return np.random.default_rng(5).integers(0, _FULL, SKETCH, np.uint64, endpoint=True) | np.uint64(1)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The distinct hashes of the word shingles of text, in order; none for a text without a word."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    shingles = {b" ".join(found)} if len(found) <= words else set(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    return np.unique(np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64, len(shingles)))


def sketch(hashes: np.ndarray, bands: int, rows: int) -> tuple[int, list[int], bytes]:
    """(SimHash over the distinct shingles' hashes, a key for each band of ``rows`` MinHash values, a byte of each of SKETCH values)."""
    if not len(hashes):
        return 0, [0] * bands, bytes(SKETCH)
    odd = _factors()
    counts, least = np.zeros(64, np.int64), np.full(SKETCH, _FULL, np.uint64)
    for at in range(0, len(hashes), 1 << 13):
        part = hashes[at:at + (1 << 13)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        turned = (part ^ (part >> np.uint64(29)))[:, None] * odd[None, :]
        least = np.minimum(least, (turned ^ (turned >> np.uint64(32))).min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[i * rows:(i + 1) * rows].tobytes(), seed=i) for i in range(bands)]
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big"), keys, (least & np.uint64(255)).astype(np.uint8).tobytes()


def _sketches(words: int, bands: int, rows: int):
    def run(batches):
        for batch in (own for whole in batches for own in slices(whole)):
            sets = [shingle_hashes(t or "", words) for t in batch.column("text").to_pylist()]
            got = [sketch(h, bands, rows) for h in sets]
            nodes = pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), nodes, pa.array(np.array([g[0] for g in got], np.uint64).view(np.int64)),
                                   pa.array([np.array(g[1], np.uint64).view(np.int64) for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.binary())], ["doc_id", "key", "node", "fp", "bands", "sketch"])
    return run


def _shingle_sets(words: int):
    """Texts (node, text) -> (node, fp, sketch, hashes): all that verification takes."""
    def run(batches):
        for batch in (own for whole in batches for own in slices(whole)):
            sets = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            got = [sketch(h, BANDS, BAND_ROWS) for h in sets]
            yield pa.record_batch([batch.column("node"), pa.array(np.array([g[0] for g in got], np.uint64).view(np.int64)),
                                   pa.array([g[2] for g in got], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "fp", "sketch", "hashes"])
    return run


#: (number of a print, numbers of others) -> which of the others are linked with it
Alike = Callable[[int, np.ndarray], np.ndarray]


def reached(prints: np.ndarray, radius: int, sketches: np.ndarray | None = None, alike: Alike | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the classes of prints within radius, found by spreading from print to print among those not yet
    reached; the pivot table discards first, ``alike`` decides last. The work falls with every print that is reached, so a dense class costs little."""
    table = np.bitwise_count(prints[:, None] ^ _pivots()[None, :8]).astype(np.int8)
    rest, left, right = np.arange(len(prints)), [], []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.abs(table[rest] - table[at]).max(axis=1) <= radius
            near[near] = np.bitwise_count(prints[rest[near]] ^ prints[at]) <= radius
            if sketches is not None:
                near[near] = (sketches[rest[near]] == sketches[at]).sum(axis=1) >= AGREE
            if alike is not None:
                near[near] = alike(at, rest[near])
            hit = rest[near]
            rest = rest[~near]
            left.append(np.full(len(hit), at))
            right.append(hit)
            todo += hit.tolist()
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def similar_sets(data: np.ndarray, sizes: np.ndarray) -> Alike:
    """Whether sets, sorted hashes that data holds one after another, have SIMILAR of their union in common: counted, in whole numbers."""
    begin = np.cumsum(sizes) - sizes
    part, whole = SIMILAR

    def alike(at: int, others: np.ndarray) -> np.ndarray:
        own, n = data[begin[at]:begin[at] + sizes[at]], int(sizes[at])
        out = whole * np.minimum(sizes[others], n) >= part * np.maximum(sizes[others], n)
        todo = np.flatnonzero(out)
        for some in np.array_split(todo, int(sizes[others[todo]].sum() >> 20) + 1):
            theirs = sizes[others[some]]
            values = gathered(data, begin[others[some]], theirs)
            sums = np.concatenate([[0], np.cumsum(own[np.minimum(np.searchsorted(own, values), n - 1)] == values)]) if n else np.zeros(1, int)
            ends = np.cumsum(theirs)
            common = sums[ends] - sums[ends - theirs]
            out[some] = whole * common >= part * (theirs + n - common)
        return out
    return alike


def _runs(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal names start, and how long they are."""
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    return starts, np.diff(np.append(starts, len(names)))


def _by_run(batches, solve: Callable, name: str, *numbers: str):
    """Rows sorted by ``name`` -> solve(names, numbers, batch) of batches that hold the rows of each name whole."""
    held: list[pa.RecordBatch] = []

    def solved():
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return solve(*(rows.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (name, *numbers)), rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(name).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(names == names[-1])[0])
        if cut or held and held[-1].column(name)[-1].as_py() != names[-1]:
            if cut:
                held.append(batch.slice(0, cut))
            yield from solved()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from solved()


def _sketch_table(rows: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)


def _band_classes(radius: int):
    """Rows (band, node, fp, sketch) sorted by band -> (class, node) of each band's classes of two and more by prints and sketches;
    equal classes of different bands have equal names. The rows of one band are held together, 88 bytes each."""
    def solve(bands, nodes, prints, rows):
        sketches = _sketch_table(rows)
        starts, sizes = _runs(bands)
        small = sizes <= 32
        own = np.flatnonzero(np.repeat(small & (sizes > 1), sizes))
        left, right = [], []
        if len(own):
            n = sizes[small & (sizes > 1)]
            a, b = links(prints[own], np.cumsum(n) - n, n, radius)
            near = (sketches[own][a] == sketches[own][b]).sum(axis=1) >= AGREE
            left.append(own[a[near]])
            right.append(own[b[near]])
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            a, b = reached(prints[s:s + n], radius, sketches[s:s + n])
            left.append(s + a)
            right.append(s + b)
        if sum(map(len, left)):
            root = _forest(np.concatenate(left), np.concatenate(right), len(bands))
            order = np.argsort(root, kind="stable")
            starts, sizes = _runs(root[order])
            names = np.repeat(np.add.reduceat(mixed(nodes[order]), starts), sizes)
            more = np.repeat(sizes > 1, sizes)
            yield pa.record_batch([pa.array(names[more].view(np.int64)), pa.array(nodes[order][more].view(np.int64))], ["class", "node"])

    return lambda batches: _by_run(batches, solve, "band", "node", "fp")


def _verified(radius: int):
    """Rows (class, node, fp, sketch, hashes) sorted by class -> links (a, b) that span what is similar in each class by the
    shingles themselves. The rows of one class are held together, 8 bytes a shingle."""
    def solve(names, nodes, prints, rows):
        sketches, raw = _sketch_table(rows), rows.column("hashes").to_pylist()
        for s, n in zip(*(x.tolist() for x in _runs(names)), strict=True):
            own = raw[s:s + n]
            sets = similar_sets(np.frombuffer(b"".join(own), np.uint64), np.array([len(x) // 8 for x in own], np.int64))
            a, b = reached(prints[s:s + n], radius, sketches[s:s + n], sets)
            if len(a):
                yield pa.record_batch([pa.array(nodes[s + a].view(np.int64)), pa.array(nodes[s + b].view(np.int64))], ["a", "b"])

    return lambda batches: _by_run(batches, solve, "class", "node", "fp")


#: Texts are similar that share at least 4 in 5 of the shingles that either has.
SIMILAR = (4, 5)
#: Bits in which candidates may differ: at a similarity of 0.8 over five-word shingles the mean is 9.7, with a deviation of 2.9; 12 and 3.1 for the shortest texts.
SIMILAR_RADIUS = 26
#: Ten bands of four MinHash values bring together 99.5 in 100 pairs of similarity 0.8.
BANDS, BAND_ROWS = 10, 4
#: MinHash values kept as a byte each, and how many of candidates must agree: at a similarity of 0.8, 51 of 64 do, with a deviation of 3.2.
SKETCH, AGREE = 64, 36


def similar_documents(docs: DataFrame, words: int = 5, radius: int = SIMILAR_RADIUS) -> DataFrame:
    """Per input row: doc_id, key, fp, component_id, for texts whose shingle sets have a similarity of 0.8 or more.

    At so many bits equal groups of bits bring too much together; bands of MinHash values do it instead. The pivot table,
    the fingerprints and the sketches discard; the shingles of what remains are compared. Cases are defined as for near_duplicates().
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    kept = stage(rows.mapInArrow(_sketches(words, BANDS, BAND_ROWS), "doc_id long, key long, node long, fp long, bands array<long>, sketch binary"), "sketches")
    n = kept.count()
    # Texts of the same shingles are one node; others of its fingerprint are nodes of their own.
    nodes = stage(kept.groupBy("node").agg(F.min(F.struct("bands", "sketch", "fp", "key")).alias("s")).select("node", "s.*"), "nodes", 4 * n)
    pairs = nodes.select("node", F.explode(F.array_distinct("bands")).alias("band"), "fp", "sketch")
    classes = pairs.repartition(partitions(spark), "band").sortWithinPartitions("band", "node").mapInArrow(_band_classes(radius), "class long, node long")
    classes = stage(classes.distinct(), "candidates", 2 * n)
    wanted = stage(nodes.select("node", "key").join(classes.select("node").distinct(), "node"), "wanted", n)
    texts = flagged(rows.select("key", "text"), wanted, "key").where("maybe").groupBy("key").agg(F.min("text").alias("text")).join(wanted, "key").select("node", "text")
    sets = stage(texts.mapInArrow(_shingle_sets(words), "node long, fp long, sketch binary, hashes binary"), "sets")
    found = classes.join(sets, "node").repartition(partitions(spark), "class").sortWithinPartitions("class", "node").select("class", "node", "fp", "sketch", "hashes").mapInArrow(_verified(radius), "a long, b long")
    return classified(kept.drop("bands", "sketch"), stage(found.distinct(), "links", n), "node", n).drop("node")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """docs with one document (the smallest doc_id) of each class of near-duplicates, five-word shingles and a similarity of 0.8 or more; same columns."""
    rows = similar_documents(docs.select("doc_id", "text"))
    gone = rows.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key")).distinct()
    return settled(docs, stage(gone, "gone", docs.select("doc_id").count()))
