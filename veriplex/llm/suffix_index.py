"""A logarithmic family of suffix arrays that outlives the job: batches of documents come one after another, each loses the
byte strings that stand in what came before, and joins the family.

A level is a folder of the shared store. For each bucket of anchors (windows.py) it has a row: the bytes of the distinct
stretches, and the starts of their distinct windows in the order of the strings, a suffix array to the depth of a window. A new batch
gets such arrays, is scanned against the rows of every level, one at a time in memory, and becomes a level of size 1; the
last two levels merge, by the ranks of one in the other, while they are of equal size. After n batches there are at most
log2(n) + 1 levels. The list of levels is written last, so a job that dies leaves the family as it was.

Defined cases: a document of an earlier batch comes before all documents of later ones, whatever their ids, and a doc_id that
comes again in a later batch is another document; within a batch the smaller doc_id comes first. Null text is empty; a null
doc_id is the largest; an empty batch changes nothing but takes part in the sizes; other columns are ignored. A task holds a bucket of the
batch's stretches, about four times the batch's text over the number of buckets (more where one anchor is very frequent), and one row of
one level: give ``buckets`` for the size that the family will reach. One job adds at a time.
"""

from __future__ import annotations

import uuid
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, stage
from .suffixes import FIELDS, GRAM, WINDOW, _finish, _finish_bytes, first_by_levels, suffix_order
from .windows import FLUSH_BYTES, PACKED, STRETCHES, Texts, _dealt, _joined, _met, _pack, _parts, _unpack, finished, first_documents, gathered, keyed, small_batches, span_rows

LEVEL: dict[str, Any] = {"bytes": np.uint8, "order": np.int64}
HEADS = "number long, at int, name string, batches long, buckets int"


def _strings(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, f"S{window}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, window)[starts]).view(f"S{window}")[:, 0]


def _held(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which wanted strings are among sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


def merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray], window: int) -> dict[str, np.ndarray]:
    """One suffix array of two, by the ranks of b's strings in a; strings of both are kept once."""
    x, y = _strings(a["bytes"], a["order"], window), _strings(b["bytes"], b["order"], window)
    fresh = ~_held(x, y)
    rank = np.searchsorted(x, y[fresh])
    return {"bytes": np.concatenate([a["bytes"], b["bytes"]]), "order": np.insert(a["order"], rank, b["order"][fresh] + len(a["bytes"]))}


def _all_stretches(window: int, gram: int, buckets: int):
    def run(batches):
        for batch in batches:
            texts, ids, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
            for part in _parts(texts):
                one = Texts(texts[part], False)
                found = one.stretches(window, gram)
                base = one.ends - one.sizes
                # A stretch is several times its windows' own text, so a part's go out in slices.
                for own in np.array_split(np.arange(len(found["doc"])), max(1, len(found["doc"]) * 80 // FLUSH_BYTES)):
                    own = {k: v[own] for k, v in found.items()}
                    data, sizes = one.slices(own["first"], own["last"], window)
                    yield from _dealt((own["hash"] % np.uint64(buckets)).astype(np.int64), ids[part], keys[part], own["doc"], hash=own["hash"], first=own["first"] - base[own["doc"]],
                                      windows=(own["last"] - own["first"] + 1).astype(np.uint8), sizes=sizes, bytes=data)
    return run


def _scanned(window: int, buckets: int):
    """Rows by bucket, the batch's before the levels': the batch's spans, and its own row of a new level."""
    def run(batches):
        number, held, now = None, [], None

        def begin():
            got = _joined(held)
            held.clear()
            which, at, first = first_documents(got, first_by_levels)
            distinct = np.unique(which, return_index=True)[1]
            sizes, windows = got["sizes"].astype(np.int64), got["windows"][distinct].astype(np.int64)
            own = sizes[distinct]
            data = gathered(got["bytes"], (np.cumsum(sizes) - sizes)[distinct], own)
            starts = np.repeat((np.cumsum(own) - own) - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
            order, new = suffix_order(data, starts, window)
            place = np.full(len(data), -1, np.int64)
            place[starts] = np.arange(len(starts))
            heads = order[new]
            return {"got": got, "which": which, "at": at, "first": first, "data": data, "heads": heads, "strings": _strings(data, heads, window),
                    "known": np.zeros(len(heads), bool), "windows": place[order], "run": np.cumsum(new) - 1}

        def end():
            known = np.zeros(len(now["windows"]), bool)
            known[now["windows"]] = now["known"][now["run"]]
            for batch in span_rows(now["got"], now["which"], now["at"], now["first"], known, window, buckets):
                yield pa.record_batch([*batch.columns, pa.array([False] * batch.num_rows)], ["bucket", "packed", "level"])
            # What older levels hold need not stand in this one again.
            row = _pack({"bytes": now["data"], "order": now["heads"][~now["known"]]})
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([row], pa.binary()), pa.array([True])], ["bucket", "packed", "level"])

        for batch in batches:
            for bucket, level, packed in zip(*[batch.column(c).to_pylist() for c in ("bucket", "level", "packed")], strict=True):
                if bucket != number:
                    if held:
                        now = begin()
                    if now is not None:
                        yield from end()
                    number, now = bucket, None
                if not level:
                    held.append(_unpack(packed, STRETCHES))
                    continue
                if held:
                    now = begin()
                if now is not None:
                    got = _unpack(packed, LEVEL)
                    now["known"] |= _held(_strings(got["bytes"], got["order"], window), now["strings"])
        if held:
            now = begin()
        if now is not None:
            yield from end()
    return run


def _merge(window: int):
    def run(batches):
        number, level = None, None
        give = lambda: pa.record_batch([pa.array([number], pa.int32()), pa.array([_pack(level)], pa.binary())], ["bucket", "packed"])
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                got = _unpack(packed, LEVEL)
                if bucket != number:
                    if level is not None:
                        yield give()
                    number, level = bucket, got
                else:
                    level = merged(level, got, window)
        if level is not None:
            yield give()
    return run


class SuffixIndex:
    """The family in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, window: int = WINDOW, gram: int = GRAM) -> None:
        self.spark, self.path, self.window, self.gram = spark, path.rstrip("/"), window, gram
        self.number, self.levels, self.buckets = 0, [], buckets
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/heads")
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            rows = spark.read.schema(HEADS).parquet(f"{self.path}/heads")
            last = rows.where(F.col("number") == rows.agg(F.max("number")).first()[0]).orderBy("at").collect()  # a few levels
            self.number, self.buckets, self.levels = last[0].number, last[0].buckets, [(r.name, r.batches) for r in last]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(PACKED).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame) -> str:
        name = f"level-{uuid.uuid4().hex}"
        rows.select("bucket", "packed").write.parquet(f"{self.path}/{name}")
        return name

    def add(self, docs: DataFrame, content: bool = False) -> DataFrame:
        """Takes in a batch; per row of docs what suffix_dedup gives, against all that came before and the batch itself."""
        with small_batches(self.spark):
            rows, buckets = keyed(docs), self.buckets
            met = rows.mapInArrow(_all_stretches(self.window, self.gram, buckets), PACKED).select("bucket", "packed", F.lit(0).alias("level"))
            for name, _ in self.levels:
                met = met.unionByName(self._read(name).select("bucket", "packed", F.lit(1).alias("level")))
            met = met.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "level")
            got = stage(met.mapInArrow(_scanned(self.window, buckets), "bucket int, packed binary, level boolean"), "scanned")
            finish, fields = (_finish_bytes, "doc_id long, content binary, removed string") if content else (_finish, FIELDS)
            spans = got.where("not level").select("bucket", "packed")
            out = stage(_met(rows, spans, buckets).mapInArrow(finished(finish, fields), fields), "kept")
            levels, spent = [*self.levels, (self._write(got.where("level")), 1)], []
            while len(levels) > 1 and levels[-1][1] >= levels[-2][1]:
                (a, m), (b, n) = levels.pop(), levels.pop()
                both = self._read(a).union(self._read(b)).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
                levels.append((self._write(both.mapInArrow(_merge(self.window), PACKED)), m + n))
                spent += [a, b]
            heads = [(self.number + 1, i, name, size, buckets) for i, (name, size) in enumerate(levels)]
            self.spark.createDataFrame(heads, HEADS).coalesce(1).write.mode("append").parquet(f"{self.path}/heads")
            self.number, self.levels = self.number + 1, levels
            remove(self.spark, *[f"{self.path}/{name}" for name in spent])
            return out
