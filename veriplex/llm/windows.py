"""Windows of documents that also start in a document with a smaller id, found without comparing documents in pairs.

A document is a sequence of units, words or bytes. The anchor of a window is the run of ``gram`` units in it with the
least hash, so equal windows have equal anchors and neighbours mostly share one. The windows of one anchor, side by
side, are a stretch.

1. Every task hashes its documents and deals the anchors to buckets; a bucket names the anchors of more than one document.
2. Documents meet their shared anchors again, and the stretches of these go to the anchor's bucket, text and all.
3. In a bucket, equal stretches are settled by their smallest document; where an anchor has different stretches, an index
   (the operators bring their own) tells for each window the smallest document that it starts in.
4. The spans to remove return to the documents.

Tasks hold one bucket of anchors, or a part of the documents' texts, packed in arrays; buckets are as many as the
session has shuffle partitions. Nothing is collected by the driver, and no list of candidates is cut. An anchor with
over HOT stretches would bring too much together: its stretches go as 128-bit digests through an aggregate that combines before
its shuffle. The windows of different stretches go packed, each once a chunk of stretches, to the slot of their digest, which
tells the chunk of smaller documents; a join that spreads hot digests tells each pack of stretches once what goes of them. An anchor in over HEAVY of the documents
that a task looks at together is hot at once: one row tells its bucket, the others go straight back to their documents,
so no bucket gathers what stands in a large share of all documents.

A null doc_id counts as larger than any other. Rows of one doc_id never remove each other's windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, partitions, release, stage, text_of

#: Units that are hashed at once, about.
CHUNK = 1 << 20
#: Anchors, and bytes of stretches, that a task gathers before it deals them out.
FLUSH, FLUSH_BYTES = 1 << 19, 1 << 23
#: Stretches from which an anchor's windows are no longer brought together with their texts.
HOT = 20_000
#: Documents among FLUSH anchors from which an anchor is hot without a count, and the stretches that its row then claims.
HEAVY, CLAIM = 512, 1 << 30
#: Windows of different hot stretches that are compared at a time, about.
SLOT = 1 << 22
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: The bits of a packed anchor that hold its place.
_PLACE = np.uint64((1 << 24) - 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, _INVERSE)):
            row = np.full(max(n, CHUNK + 4096), x, np.uint64)
            row[0] = 1
            _powers[i] = np.cumprod(row)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair; equal ranges have equal hashes wherever they stand."""
    up, down = powers(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])
    return mixed((sums[end] - sums[start]) * down[start])


class Texts:
    """Documents of a batch: units as numbers, the bytes that they stand in, and where each unit begins and ends there."""

    def __init__(self, texts: list[bytes], words: bool) -> None:
        self.words = words
        if words:
            split = [t.split() for t in texts]
            self.sizes = np.array([len(w) for w in split], np.int64)
            data = b" ".join([b" ".join(w) for w in split if w])
            self.data = np.frombuffer(data, np.uint8)
            gaps = np.flatnonzero(self.data == 32)
            n = int(self.sizes.sum())
            self.begin = np.concatenate([[0], gaps + 1])[:n] if n else np.zeros(0, np.int64)
            self.end = np.concatenate([gaps, [len(data)]])[:n] if n else np.zeros(0, np.int64)
            self.units = range_hashes(self.data.astype(np.uint64) + np.uint64(1), self.begin, self.end) if n else np.zeros(0, np.uint64)
        else:
            self.sizes = np.array([len(t) for t in texts], np.int64)
            self.data = np.frombuffer(b"".join(texts), np.uint8)
            self.units = self.data.astype(np.uint64) + np.uint64(1)
        self.ends = np.cumsum(self.sizes)

    def stretches(self, window: int, gram: int) -> dict[str, np.ndarray]:
        """Per stretch: hash of its anchor, document (number in the batch), first and last window start (in the batch's units)."""
        n = len(self.units)
        if n < window:
            return {k: np.zeros(0, np.uint64 if k == "hash" else np.int64) for k in ("hash", "doc", "first", "last")}
        at = np.arange(n - gram + 1)
        hashes = range_hashes(self.units, at, at + gram)
        span, most = window - gram + 1, int(_PLACE) + 1
        places = []
        # A place is packed with its hash, so it counts from the slice's start; slices overlap by window - 1 units.
        for lo in range(0, n - window + 1, most - window + 1):
            best = (hashes[lo:lo + most - gram + 1] & ~_PLACE) | at[:min(most, n - lo) - gram + 1].astype(np.uint64)
            step = 1
            while step * 2 <= span:
                best = np.minimum(best[:-step], best[step:])
                step *= 2
            if step < span:
                best = np.minimum(best[:step - span], best[span - step:])
            places.append((best & _PLACE).astype(np.int64) + lo)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[:n - window + 1]
        starts = np.flatnonzero(np.arange(n - window + 1) + window <= self.ends[doc])
        place = np.concatenate(places)[starts]
        if not len(starts):
            return {k: np.zeros(0, np.uint64 if k == "hash" else np.int64) for k in ("hash", "doc", "first", "last")}
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])]))
        return {"hash": hashes[place[new]], "doc": doc[starts[new]], "first": starts[new], "last": starts[np.append(new[1:] - 1, len(starts) - 1)]}

    def slices(self, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of stretches, one after another, and their lengths."""
        lo, hi = (self.begin[first], self.end[last + window - 1]) if self.words else (first, last + window)
        return gathered(self.data, lo, hi - lo), hi - lo


def gathered(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[at:at+size] of each pair, one after another; the places are worked out CHUNK at a time."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    for lo, hi in pieces(ends):
        n, begin = sizes[lo:hi], int(ends[lo] - sizes[lo])
        own = np.cumsum(n) - n
        out[begin:int(ends[hi - 1])] = data[np.repeat(at[lo:hi] - own, n) + np.arange(int(n.sum()))]
    return out


def pieces(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (lo, hi) of rows that hold about CHUNK units, given where each row ends."""
    if len(ends):
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(CHUNK, int(ends[-1]) + CHUNK, CHUNK), side="left") + 1, len(ends)).clip(1, len(ends)))
        yield from zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True)


def contents(data: np.ndarray, sizes: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each of the strings that data holds one after another; another one with a salt."""
    ends = np.cumsum(sizes)
    out = np.empty(len(sizes), np.uint64)
    for lo, hi in pieces(ends):
        begin = int(ends[lo] - sizes[lo])
        own = ends[lo:hi] - begin
        units = data[begin:int(ends[hi - 1])].astype(np.uint64) + np.uint64(1 + salt)
        out[lo:hi] = range_hashes(mixed(units) if salt else units, own - sizes[lo:hi], own)
    return out


def _parts(texts: list[bytes]) -> Iterator[slice]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one compressed string; _unpack knows the kinds by name."""
    sink = pa.BufferOutputStream()
    for name, x in arrays.items():
        if name == "ids":
            x = np.diff(x.astype(np.int64), prepend=np.int64(0))
        raw = np.ascontiguousarray(x).tobytes()
        sink.write(len(raw).to_bytes(8, "little"))
        sink.write(raw)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpack(data: bytes, kinds: dict[str, Any]) -> dict[str, np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, {}
    for name, kind in kinds.items():
        n = int.from_bytes(raw[at:at + 8], "little")
        out[name] = np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8)
        at += 8 + n
    if "ids" in out:
        out["ids"] = np.cumsum(out["ids"])
    return out


PACKED = "bucket int, packed binary"
MARKED = "bucket int, packed binary, hot boolean"
_OWN = {"ids": np.int64, "keys": np.int64, "counts": np.int32}
ANCHORS = _OWN | {"hash": np.uint64, "stretches": np.int32}
SHARED = _OWN | {"hash": np.uint64, "hot": np.uint8}
OFTEN = _OWN | {"first": np.int64, "windows": np.uint8, "sizes": np.int32, "bytes": np.uint8}
STRETCHES = _OWN | {"hash": np.uint64, "first": np.int64, "windows": np.uint8, "sizes": np.int32, "bytes": np.uint8}
#: Of different hot stretches: two hashes, smallest document, stretches and packs that hold them, lengths, bytes; of windows, the first three.
CHUNKS = {"one": np.uint64, "two": np.uint64, "least": np.int64, "n": np.int64, "packs": np.int64, "sizes": np.int32, "bytes": np.uint8}
ASKS = {"one": np.uint64, "two": np.uint64, "least": np.int64}
TEXTS = {"ids": np.int64, "keys": np.int64, "sizes": np.int64, "bytes": np.uint8}
SPANS = _OWN | {"lo": np.int64, "hi": np.int64}


def home(ids: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each document."""
    return (mixed(ids.astype(np.uint64) ^ keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _dealt(bucket: np.ndarray, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc: number of the document, columns) by bucket; a bucket names each document once, with its count of rows."""
    by_id = np.argsort(ids, kind="stable")  # ids by difference and keys that are mostly 0 take little room
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    ids, keys, doc = ids[by_id], keys[by_id], rank[doc]
    order = np.lexsort((doc, bucket))
    edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])), len(order)) if len(order) else [0]
    sizes, data = columns.pop("sizes", None), columns.pop("bytes", None)
    at = np.cumsum(sizes) - sizes if sizes is not None else None
    numbers, packed = [], []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        own = order[lo:hi]
        docs, counts = np.unique(doc[own], return_counts=True)
        arrays = {"ids": ids[docs], "keys": keys[docs], "counts": counts.astype(np.int32)} | {k: v[own] for k, v in columns.items()}
        if sizes is not None:
            arrays |= {"sizes": sizes[own].astype(np.int32), "bytes": gathered(data, at[own], sizes[own])}
        numbers.append(int(bucket[own[0]]))
        packed.append(_pack(arrays))
    if numbers:
        yield pa.record_batch([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])


def _anchors(words: bool, window: int, gram: int, buckets: int, heavy: int):
    def run(batches):
        ids, keys, docs, hashes, counts, n = [], [], [], [], [], 0

        def flush():
            h, doc, own, of, count = (np.concatenate(x) for x in (hashes, docs, ids, keys, counts))
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            sizes = np.diff(np.append(first, len(order)))
            count[order[first[sizes > heavy]]] = CLAIM
            direct = np.zeros(len(h), bool)
            direct[order] = np.repeat(sizes > heavy, sizes)
            met = ~direct | (count == CLAIM)
            yield from marked(_dealt((h[met] % np.uint64(buckets)).astype(np.int64), own, of, doc[met], hash=h[met], stretches=count[met]), False)
            if direct.any():
                yield from marked(_dealt(home(own, of, buckets)[doc[direct]], own, of, doc[direct], hash=h[direct], hot=np.ones(int(direct.sum()), np.uint8)), True)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _parts(texts):
                found = Texts(texts[part], words).stretches(window, gram)
                order = np.lexsort((found["hash"], found["doc"]))
                d, h = found["doc"][order], found["hash"][order]
                once = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])) if len(d) else np.zeros(0, np.int64)
                docs.append(d[once] + sum(map(len, ids)))
                hashes.append(h[once])
                counts.append(np.diff(np.append(once, len(d))).astype(np.int32))
                ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False)[part])
                keys.append(batch.column("key").to_numpy(zero_copy_only=False)[part])
                n += len(once)
                if n >= FLUSH:
                    yield from flush()
                    ids, keys, docs, hashes, counts, n = [], [], [], [], [], 0
        if n:
            yield from flush()
    return run


def _by_bucket(batches, kinds: dict[str, Any]) -> Iterator[tuple[pa.RecordBatch | None, list[dict[str, np.ndarray]]]]:
    """Rows sorted by bucket -> (hot rows as they come, none) and (None, the unpacked rows of each bucket that are not hot)."""
    held, number = [], None
    for batch in batches:
        hot = batch.column("hot")
        if hot.true_count:
            yield batch.filter(hot), []
            batch = batch.filter(pa.compute.invert(hot))
        for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if bucket != number and held:
                yield None, held
                held = []
            number = bucket
            held.append(_unpack(packed, kinds))
    if held:
        yield None, held


def _joined(rows: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One row of them all; doc numbers the documents."""
    out = {k: np.concatenate([r[k] for r in rows]) for k in rows[0]}
    out["doc"] = np.repeat(np.arange(len(out["ids"])), out.pop("counts"))
    return out


def _shared(buckets: int, hot: int):
    def run(batches):
        for passed, rows in _by_bucket(batches, ANCHORS):
            if passed is not None:
                yield passed.select(["bucket", "packed"])
                continue
            got = _joined(rows)
            order = np.argsort(got["hash"], kind="stable")
            own = got["ids"][got["doc"]][order]
            first = np.flatnonzero(np.concatenate([[True], got["hash"][order][1:] != got["hash"][order][:-1]]))
            sizes = np.diff(np.append(first, len(order)))
            stretches = np.add.reduceat(got["stretches"][order], first, dtype=np.int64)
            more = (np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)) | (stretches >= CLAIM)
            kept = order[np.repeat(more, sizes)]
            doc = got["doc"][kept]
            yield from _dealt(home(got["ids"], got["keys"], buckets)[doc], got["ids"], got["keys"], doc, hash=got["hash"][kept], hot=np.repeat(stretches[more] > hot, sizes[more]).astype(np.uint8))
    return run


def _with_texts(batches, kinds: dict[str, Any], handle: Callable[[dict, list], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, packed ones before texts: calls handle(packed arrays by (id, key), documents) for batches of documents."""
    number, known = None, {}

    def learn(packed):
        got = _unpack(packed, kinds)
        names = [k for k in kinds if k not in _OWN]
        ends = np.cumsum(got["counts"])
        for i, (doc_id, key) in enumerate(zip(got["ids"].tolist(), got["keys"].tolist(), strict=True)):
            lo, hi = ends[i] - got["counts"][i], ends[i]
            known.setdefault((doc_id, key), []).append(tuple(got[k][lo:hi] for k in names))

    for batch in batches:
        for bucket, texts, packed in zip(*[batch.column(c).to_pylist() for c in ("bucket", "texts", "packed")], strict=True):
            if bucket != number:
                number = bucket
                known.clear()
            if not texts:
                learn(packed)
                continue
            got = _unpack(packed, TEXTS)
            ends, raw = np.cumsum(got["sizes"]).tolist(), got["bytes"].tobytes()
            docs, size = [], 0
            for doc_id, key, n, end in zip(got["ids"].tolist(), got["keys"].tolist(), got["sizes"].tolist(), ends, strict=True):
                docs.append((doc_id, key, raw[end - n:end]))
                size += n
                if size >= CHUNK:
                    yield from handle(known, docs)
                    docs, size = [], 0
            if docs:
                yield from handle(known, docs)


def _stretches(words: bool, window: int, gram: int, buckets: int):
    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        n = 0

        def flush():
            shift = np.cumsum([0] + [len(x["ids"]) for x in held])
            doc = np.concatenate([x["doc"] + s for x, s in zip(held, shift, strict=False)])
            cat = {k: np.concatenate([x[k] for x in held]) for k in held[0] if k != "doc"}
            yield from marked(_dealt((cat["hash"] % np.uint64(buckets)).astype(np.int64), cat.pop("ids"), cat.pop("keys"), doc, **cat), False)

        def handle(known, docs):
            nonlocal n, held
            docs = [x for x in docs if (x[0], x[1]) in known]
            if not docs:
                return
            texts = Texts([t for _, _, t in docs], words)
            found = texts.stretches(window, gram)
            edges = np.searchsorted(found["doc"], np.arange(len(docs) + 1))
            keep, often = np.zeros(len(found["doc"]), bool), np.zeros(len(found["doc"]), bool)
            for i, (doc_id, key, _) in enumerate(docs):
                hashes, hot = (np.concatenate([x[j] for x in known[doc_id, key]]) for j in (0, 1))
                order = np.argsort(hashes)
                own = found["hash"][edges[i]:edges[i + 1]]
                at = order[np.minimum(np.searchsorted(hashes, own, sorter=order), len(hashes) - 1)]
                keep[edges[i]:edges[i + 1]] = hashes[at] == own
                often[edges[i]:edges[i + 1]] = hot[at] > 0
            base, ids, keys = texts.ends - texts.sizes, np.array([x[0] for x in docs], np.int64), np.array([x[1] for x in docs], np.int64)

            def columns(own):
                data, sizes = texts.slices(own["first"], own["last"], window)
                return {"first": own["first"] - base[own["doc"]], "windows": (own["last"] - own["first"] + 1).astype(np.uint8), "sizes": sizes, "bytes": data}

            if (keep & often).any():  # to any one bucket: they only pass
                own = {k: v[keep & often] for k, v in found.items()}
                yield from marked(_dealt(np.full(len(own["doc"]), home(ids[:1], keys[:1], buckets)[0]), ids, keys, own["doc"], **columns(own)), True)
            found = {k: v[keep & ~often] for k, v in found.items()}
            held.append({"ids": ids, "keys": keys, "doc": found["doc"], "hash": found["hash"]} | columns(found))
            n += len(held[-1]["bytes"]) + 64 * len(found["doc"])
            if n >= FLUSH_BYTES:
                yield from flush()
                held, n = [], 0

        yield from _with_texts(batches, SHARED, handle)
        if n:
            yield from flush()
    return run


def marked(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([*batch.columns, pa.array([hot] * batch.num_rows)], ["bucket", "packed", "hot"])


def _digest(one: np.ndarray, two: np.ndarray) -> pa.Array:
    both = np.ascontiguousarray(np.stack([one, two], axis=1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(one), [None, pa.py_buffer(both)]).cast(pa.binary())


def _pairs(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of each digest."""
    both = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _least(one: np.ndarray, two: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of hashes: (number of each, a place of each number, smallest value of each number)."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    number, heads = np.empty(len(order), np.int64), np.flatnonzero(new)
    number[order] = np.cumsum(new) - 1
    return number, order[heads], np.minimum.reduceat(values[order], heads)


def _hot_pack(packed: bytes) -> tuple[dict[str, np.ndarray], pa.Array]:
    """(arrays, content digests) of packed hot stretches."""
    got = _joined([_unpack(packed, OFTEN)])
    sizes = got["sizes"].astype(np.int64)
    return got, _digest(contents(got["bytes"], sizes), contents(got["bytes"], sizes, 77))


def _hot_digests(batches):
    """Each digest of a pack once."""
    for batch in batches:
        for pack, packed in zip(batch.column("pack").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            digests = _hot_pack(packed)[1].unique()
            yield pa.record_batch([digests, pa.array(np.full(len(digests), pack, np.int64))], ["digest", "pack"])


def _hot_contents(batches):
    for batch in batches:
        for packed in batch.column("packed").to_pylist():
            got, digest = _hot_pack(packed)
            sizes = got["sizes"].astype(np.int64)
            at = np.cumsum(sizes) - sizes
            seen = digest.dictionary_encode()
            number = seen.indices.to_numpy()
            order = np.argsort(number, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], number[order][1:] != number[order][:-1]]))
            own = order[head]
            raw = got["bytes"].tobytes()
            texts = [raw[lo:lo + n] for lo, n in zip(at[own].tolist(), sizes[own].tolist(), strict=True)]
            least = np.minimum.reduceat(got["ids"][got["doc"]][order], head)
            yield pa.record_batch([seen.dictionary.take(pa.array(number[own])), pa.array(least), pa.array(np.diff(np.append(head, len(order)))), pa.array(texts, pa.binary())], ["digest", "least", "n", "text"])


def _hot_chunks(words: bool, window: int):
    """Different hot stretches, some FLUSH_BYTES of them in a row, with the number of their windows."""
    def run(batches):
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            texts = [t for x in held for t in x.column("text").to_pylist()]
            one, two = (np.concatenate(x) for x in zip(*[_pairs(x.column("digest")) for x in held], strict=True))
            arrays = {"one": one, "two": two} | {c: np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("least", "n", "packs")}
            arrays |= {"sizes": np.array([len(t) for t in texts], np.int32), "bytes": np.frombuffer(b"".join(texts), np.uint8)}
            n = sum(len(t.split()) if words else len(t) for t in texts) - len(texts) * (window - 1)
            yield pa.record_batch([pa.array([task + (made << 20)]), pa.array([n]), pa.array([_pack(arrays)], pa.binary())], ["chunk", "windows", "packed"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("text").nbytes
                if size >= FLUSH_BYTES:
                    yield from flush()
                    made, held, size = made + 1, [], 0
        if held:
            yield from flush()
    return run


def _chunk_windows(got: dict[str, np.ndarray], words: bool, window: int) -> tuple[np.ndarray, ...]:
    """Of the windows of a chunk's stretches: two hashes, number of the stretch, place in it."""
    ends, raw, out, at = np.cumsum(got["sizes"]).tolist(), got["bytes"].tobytes(), [], 0
    bodies = [raw[end - n:end] for n, end in zip(got["sizes"].tolist(), ends, strict=True)]
    for part in _parts(bodies):
        texts = Texts(bodies[part], words)
        n = texts.sizes - window + 1
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(texts.ends - texts.sizes, n) + place
        out.append((range_hashes(texts.units, start, start + window), range_hashes(mixed(texts.units + np.uint64(77)), start, start + window), np.repeat(np.arange(at, at + len(n)), n), place.astype(np.int32)))
        at += len(n)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _hot_asks(words: bool, window: int, slots: int):
    """The windows of each chunk, each once with its smallest document there, by slot."""
    def run(batches):
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                got = _unpack(packed, CHUNKS)
                one, two, of, _ = _chunk_windows(got, words, window)
                _, own, least = _least(one, two, got["least"][of])
                one, two = one[own], two[own]
                slot = (one % np.uint64(slots)).astype(np.int64)
                by = np.argsort(slot, kind="stable")
                edges = np.append(np.flatnonzero(np.concatenate([[True], slot[by][1:] != slot[by][:-1]])), len(by))
                parts = [by[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.record_batch([pa.array([int(slot[x[0]]) for x in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()),
                                       pa.array([_pack({"one": one[x], "two": two[x], "least": least[x]}) for x in parts], pa.binary())], ["slot", "chunk", "packed"])
    return run


def _hot_replies(batches):
    """Rows sorted by slot -> to each chunk the windows that have a smaller document elsewhere."""
    def settled(chunks, asks):
        one, two, least = (np.concatenate([x[k] for x in asks]) for k in ASKS)
        number, _, first = _least(one, two, least)
        ends = np.cumsum([len(x["one"]) for x in asks])
        told = [np.flatnonzero(first[number[end - len(x["one"]):end]] < x["least"]) + end - len(x["one"]) for x, end in zip(asks, ends.tolist(), strict=True)]
        some = [i for i, x in enumerate(told) if len(x)]
        if some:
            yield pa.record_batch([pa.array([chunks[i] for i in some], pa.int64()), pa.array([_pack({"one": one[x], "two": two[x], "least": first[number[x]]}) for x in (told[i] for i in some)], pa.binary())], ["chunk", "packed"])

    number, chunks, asks = None, [], []
    for batch in batches:
        for slot, chunk, packed in zip(*[batch.column(c).to_pylist() for c in ("slot", "chunk", "packed")], strict=True):
            if slot != number and asks:
                yield from settled(chunks, asks)
                chunks, asks = [], []
            number = slot
            chunks.append(chunk)
            asks.append(_unpack(packed, ASKS))
    if asks:
        yield from settled(chunks, asks)


def _hot_known(words: bool, window: int):
    """Rows sorted by chunk, replies first -> the stretches that lose something: smallest document, places of windows that start in a smaller one."""
    def run(batches):
        told = []
        for batch in batches:
            for texts, packed in zip(batch.column("texts").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if not texts:
                    told.append(_unpack(packed, ASKS))
                    continue
                got = _unpack(packed, CHUNKS)
                one, two, of, place = _chunk_windows(got, words, window)
                least = got["least"][of]
                number, _, first = _least(*(np.concatenate([x, *[t[k] for t in told]]) for x, k in ((one, "one"), (two, "two"), (least, "least"))))
                told = []
                gone = first[number[:len(of)]] < least
                counts = np.bincount(of[gone], minlength=len(got["n"]))
                places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(place[gone]))
                own = pa.record_batch([_digest(got["one"], got["two"]), pa.array(got["least"]), pa.array(got["packs"]), places], ["digest", "least", "packs", "places"])
                yield own.filter(pa.array((got["n"] > 1) | (counts > 0)))
    return run


def _hot_places(window: int, buckets: int):
    """Rows sorted by pack, what is known of its stretches first -> its spans, by bucket of their documents."""
    def run(batches):
        known = {}
        for batch in batches:
            for texts, digest, least, at, packed in zip(*[batch.column(c).to_pylist() for c in ("texts", "digest", "least", "places", "packed")], strict=True):
                if not texts:
                    known[digest] = least, at
                    continue
                got, digests = _hot_pack(packed)
                seen = digests.dictionary_encode()
                answers = [known.get(d, (LAST, [])) for d in seen.dictionary.to_pylist()]
                known = {}
                of, doc, first = seen.indices.to_numpy(), got["doc"], got["first"]
                whole = got["ids"][doc] > np.array([x for x, _ in answers], np.int64)[of]
                counts = np.array([len(x) for _, x in answers], np.int64)
                flat, begin = np.array([p for _, x in answers for p in x], np.int64), np.cumsum(counts) - counts
                rest = np.flatnonzero(~whole & (counts[of] > 0))
                n = counts[of[rest]]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                single = np.repeat(first[rest], n) + flat[np.repeat(begin[of[rest]], n) + inner]
                lo = np.concatenate([first[whole], single])
                hi = np.concatenate([first[whole] + got["windows"][whole].astype(np.int64) + window - 1, single + window])
                doc = np.concatenate([doc[whole], np.repeat(doc[rest], n)])
                if len(lo):
                    yield from _dealt(home(got["ids"], got["keys"], buckets)[doc], got["ids"], got["keys"], doc, lo=lo, hi=hi)
    return run


def hot_spans(often: DataFrame, words: bool, window: int, buckets: int) -> DataFrame:
    """Spans of the stretches (pack, packed) of anchors that stand too often. Equal stretches are one, of their smallest document;
    only the windows of different ones are compared: a chunk of stretches asks the slot of each of its windows for a smaller document.
    A row past its stretch's smallest document goes whole. What is known of a stretch goes to each pack once."""
    found = often.mapInArrow(_hot_contents, "digest binary, least long, n long, text binary")
    distinct = found.groupBy("digest").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.count("*").alias("packs"), F.min("text").alias("text"))
    chunks = stage(distinct.mapInArrow(_hot_chunks(words, window), "chunk long, windows long, packed binary"), "hot-stretches")
    slots = buckets * max(1, -(-(chunks.agg(F.sum("windows")).first()[0] or 0) // (buckets * SLOT)))
    asks = chunks.select("chunk", "packed").mapInArrow(_hot_asks(words, window, slots), "slot int, chunk long, packed binary")
    asks = asks.repartitionById(buckets, F.pmod("slot", F.lit(buckets)).cast("int")).sortWithinPartitions("slot")
    met = asks.mapInArrow(_hot_replies, "chunk long, packed binary").select("chunk", F.lit(0).alias("texts"), "packed").union(chunks.select("chunk", F.lit(1).alias("texts"), "packed"))
    met = met.repartitionById(buckets, F.pmod("chunk", F.lit(buckets)).cast("int")).sortWithinPartitions("chunk", "texts")
    known = stage(met.mapInArrow(_hot_known(words, window), "digest binary, least long, packs long, places array<int>"), "hot-known")
    rows = often.mapInArrow(_hot_digests, "digest binary, pack long")
    told = attach(rows, known, "digest", "packs", F.col("pack")).where("least is not null").select("pack", F.lit(0).alias("texts"), "digest", "least", "places", F.lit(None).cast("binary").alias("packed"))
    null = lambda c: F.lit(None).cast(told.schema[c].dataType).alias(c)
    met = told.union(often.select("pack", F.lit(1).alias("texts"), null("digest"), null("least"), null("places"), "packed"))
    met = met.repartitionById(buckets, F.pmod("pack", F.lit(buckets)).cast("int")).sortWithinPartitions("pack", "texts")
    return stage(met.mapInArrow(_hot_places(window, buckets), PACKED), "hot-spans")


#: (bytes of stretches, their lengths, windows of each, smallest document of each, anchor of each) -> smallest document of
#: each window, in a row; stretches of one anchor are neighbours, and only they can share windows
Index = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def first_documents(got: dict[str, np.ndarray], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stretches of a bucket: (number of the distinct stretch of each, where a distinct stretch's windows begin, smallest document of those windows)."""
    ids, sizes = got["ids"][got["doc"]], got["sizes"].astype(np.int64)
    at = np.cumsum(sizes) - sizes
    content = contents(got["bytes"], sizes)
    order = np.lexsort((ids, sizes, content, got["hash"]))
    h, c, z = got["hash"][order], content[order], sizes[order]
    new_anchor = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_anchor | np.concatenate([[True], (c[1:] != c[:-1]) | (z[1:] != z[:-1])])
    rep = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    same = gathered(got["bytes"], at[order], z) == gathered(got["bytes"], at[rep], z)
    if not same.all():  # equal hashes of different bytes
        wrong = np.add.reduceat(~same, np.cumsum(z) - z) > 0
        new |= wrong
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    distinct = order[np.flatnonzero(new)]  # the first of each has the smallest id
    anchor = (np.cumsum(new_anchor) - 1)[np.flatnonzero(new)]
    several = np.bincount(anchor)[anchor] > 1
    windows = got["windows"][distinct].astype(np.int64)
    begin = np.cumsum(windows) - windows
    first = np.repeat(ids[distinct], windows)
    if several.any():
        own = distinct[several]
        first[np.repeat(several, windows)] = index(gathered(got["bytes"], at[own], sizes[own]), sizes[own], windows[several], ids[own], anchor[several])
    return number, begin, first


def span_rows(got: dict[str, np.ndarray], number: np.ndarray, begin: np.ndarray, first: np.ndarray, known: np.ndarray | None, window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Spans of a bucket's windows that start in a smaller document, or are marked in ``known``, by bucket of their documents."""
    windows = got["windows"].astype(np.int64)
    for part in np.array_split(np.arange(len(number)), max(1, int(windows.sum()) >> 20)):
        n = windows[part]
        if not n.sum():
            continue
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin[number[part]], n) + inner
        gone = first[at] < np.repeat(got["ids"][got["doc"][part]], n)
        if known is not None:
            gone |= known[at]
        place = np.repeat(got["first"][part], n) + inner
        before = np.concatenate([[False], gone[:-1]]) & (inner > 0)
        after = np.concatenate([gone[1:], [False]]) & np.concatenate([inner[1:] > 0, [False]])
        lo, hi = place[gone & ~before], place[gone & ~after] + window
        doc = np.repeat(got["doc"][part], n)[gone & ~before]
        if len(lo):
            yield from _dealt(home(got["ids"], got["keys"], buckets)[doc], got["ids"], got["keys"], doc, lo=lo, hi=hi)


def _spans(index: Index, window: int, buckets: int):
    def run(batches):
        packs = 0
        for passed, rows in _by_bucket(batches, STRETCHES):
            if passed is not None:  # numbered: no two have one number, and a bucket comes to one task
                numbers = passed.column("bucket").to_numpy() + buckets * np.arange(packs, packs + passed.num_rows)
                packs += passed.num_rows
                yield pa.record_batch([pa.array(numbers.astype(np.int32)), passed.column("packed"), passed.column("hot")], passed.schema.names)
                continue
            got = _joined(rows)
            rows.clear()
            number, begin, first = first_documents(got, index)
            for batch in span_rows(got, number, begin, first, None, window, buckets):
                yield from marked(iter([batch]), False)
    return run


def covered(size: int, spans: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs (starts, ends) of the spans (lo, hi)."""
    edge = np.zeros(size + 1, np.int64)
    for lo, hi in spans:
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
    inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])


def _packed_texts(buckets: int):
    """Documents by bucket, packed and compressed: text is over half of what is shuffled."""
    def run(batches):
        held, size = [], 0

        def flush():
            by: dict[int, list] = {}
            for x, bucket in zip(held, home(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), buckets).tolist(), strict=True):
                by.setdefault(bucket, []).append(x)
            packed = [_pack({"ids": np.array([x[0] for x in own], np.int64), "keys": np.array([x[1] for x in own], np.int64), "sizes": np.array([len(x[2]) for x in own], np.int64),
                             "bytes": np.frombuffer(b"".join([x[2] for x in own]), np.uint8)}) for own in by.values()]
            yield pa.record_batch([pa.array(list(by), pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for x in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "key", "text")], strict=True):
                held.append(x)
                size += len(x[2])
                if size >= FLUSH_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
    return run


def _met(docs: DataFrame, packed: DataFrame, buckets: int) -> DataFrame:
    """Documents and packed rows of their buckets, in one shuffle: packed rows first."""
    a = docs.mapInArrow(_packed_texts(buckets), PACKED).select("bucket", F.lit(1).alias("texts"), "packed")
    b = packed.select("bucket", F.lit(0).alias("texts"), "packed")
    return b.union(a).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "texts")


def _dealt_out(packed: DataFrame, buckets: int) -> DataFrame:
    return packed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")


def finished(finish: Callable, fields: str):
    """Rows of ``fields``, by finish, of documents that meet their spans."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        def handle(known, docs):
            out = [finish(text, [] if (got := known.get((doc_id, key))) is None else got) for doc_id, key, text in docs]
            cols = [pa.array([None if d == LAST else d for d, _, _ in docs], pa.int64()), *[pa.array(c) for c in zip(*out, strict=True)]]
            yield pa.record_batch(cols, names)

        yield from _with_texts(batches, SPANS, handle)
    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): key tells rows of one doc_id apart, and is 0 where no doc_id is there twice; text is bytes."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    once = docs.select(doc_id.alias("doc_id")).groupBy("doc_id").count().where("count > 1").isEmpty()
    key = F.lit(0).cast("long") if once else F.xxhash64(text_of(), doc_id)
    return docs.select(doc_id.alias("doc_id"), key.alias("key"), text_of().cast("binary").alias("text"))


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of bounded bytes inside, the session's own options after."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def without_repeats(docs: DataFrame, words: bool, window: int, gram: int, index: Index, finish: Callable, fields: str, hot: int = HOT) -> DataFrame:
    """finish(documents' bytes, spans) of every row of docs; finish gives a row of ``fields``, which start with doc_id."""
    with small_batches(docs.sparkSession):
        return _without_repeats(docs, words, window, gram, index, finish, fields, hot)


def _without_repeats(docs: DataFrame, words: bool, window: int, gram: int, index: Index, finish: Callable, fields: str, hot: int) -> DataFrame:
    spark = docs.sparkSession
    buckets = partitions(spark)
    rows = keyed(docs)
    anchors = rows.mapInArrow(_anchors(words, window, gram, buckets, min(HEAVY, hot)), MARKED)
    shared = stage(_dealt_out(anchors, buckets).mapInArrow(_shared(buckets, hot), PACKED), "anchors")
    del anchors
    release(spark)
    stretches = _met(rows, shared, buckets).mapInArrow(_stretches(words, window, gram, buckets), MARKED)
    spans = stage(_dealt_out(stretches, buckets).mapInArrow(_spans(index, window, buckets), MARKED), "spans")

    del stretches
    release(spark)
    often = spans.where("hot").select(F.col("bucket").cast("long").alias("pack"), "packed")
    spans = spans.where("not hot").select("bucket", "packed")
    if not often.isEmpty():
        spans = spans.union(hot_spans(often, words, window, buckets))

    return stage(_met(rows, spans, buckets).mapInArrow(finished(finish, fields), fields), "kept")  # now, while the options hold
