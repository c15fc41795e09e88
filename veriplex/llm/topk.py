"""Operator 4, exact top-k inner products over norm-sorted, rotated vectors.

Of equal vectors only those of the k + 1 smallest ids are candidates: as ties go to the smaller id, no others are among the
k best of any query. The Gram matrix of the candidates (dimension squared sums, added up by Spark) gives the SVD rotation.
Vectors are dealt by ranges of descending norm into blocks of whole numbers, which lie in files of the shared folder, and so do the queries.
A task is a part of the candidates, consecutive files, against a group of queries; it reads both from the shared folder,
so that nothing is copied for each pair of them. Parts go in three waves: the first file alone, then the longest parts,
then the others; from what the waves before have found each query has its k-th result as a floor. A block is skipped
when the product of norms is below the floors. A pair is dropped when the partial sum over the first HEAD rotated
coordinates plus the product of residual norms (Cauchy-Schwarz) is below its query's floor; survivors are scored as
whole numbers. Where a probe shows that few pairs of a block would be dropped, the block is scored whole. Each task keeps
k results a query, which raise its floor from block to block, and a window picks the k best of those.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; empty vectors do, with a
score of 0 to each other; vectors meet only vectors of their own dimension; rows with a null id take no part; every row
is a query or candidate of its own, so a query row that is repeated has its result repeated, and rows of one id with
other vectors have results of their own; a row never meets rows of its id; equal scores go to the smaller id; extra
columns are ignored; an empty table gives no rows. Products are exact: vectors too long for doubles are scored in whole
numbers of any size. A component or score beyond 64 bits raises an error. The driver holds the square of each dimension
and the names and sizes of the files, a few numbers for each block of queries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, new_folder, partitions, stage, table

SCALE = 256
CANDIDATES = 4096
QUERIES = 256
HEAD = 16
#: Blocks of queries that a task holds at a time.
GROUP = 256
#: Components of the queries that a task holds at a time, if they are in more than one block.
NUMBERS = 1 << 24
#: Parts that the candidates of one dimension are cut into at most; a query so has k times as many results before the last step at most.
PARTS = 64
#: Candidates whose scores against a block of queries are made at a time: they stay in the processor's cache.
TILE = 1024
#: Above what rounding to floats can add to a bound, as a share of the product of norms.
SLACK = 1e-5


def quantised(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v, dim, norm): v = floor(scale * component) as doubles that hold whole numbers."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    return out.select("id", "v", F.size("v").alias("dim"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))


#: The kinds that whole numbers are held in, by the bytes of each.
KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}
ROWS = "id long, dim int, norm double, v binary"


def _narrow(batches):
    """quantised() rows with their numbers as bytes, each row in the least kind that holds it: equal vectors are equal bytes."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            rows = batch.filter(pa.array(dims == dim))
            m = np.asarray(rows.column("v").flatten()).reshape(len(rows), dim)
            ids, top, norm = rows.column("id").to_numpy(zero_copy_only=False), np.abs(m).max(axis=1, initial=0), np.sqrt((m * m).sum(axis=1))
            if top.max(initial=0) >= 2.0**63:
                raise OverflowError("a component does not fit 64 bits")
            kinds = np.select([top <= np.iinfo(KINDS[x]).max for x in (1, 2, 4)], (1, 2, 4), 8)
            for size in np.unique(kinds).tolist():
                own = np.flatnonzero(kinds == size)
                ends = np.arange(len(own) + 1, dtype=np.int32) * (dim * size)
                v = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(m[own].astype(KINDS[size]).tobytes())])
                yield pa.record_batch([pa.array(ids[own]), pa.array(np.full(len(own), dim, np.int32)), pa.array(norm[own]), v], ["id", "dim", "norm", "v"])


def _matrices(batch: pa.RecordBatch):
    """(dimension, ids, vectors as doubles) of the rows of a batch, in their order but for rows of other dimensions and kinds."""
    dims, values = batch.column("dim").to_numpy(zero_copy_only=False), batch.column("v").to_pylist()
    ids, sizes = batch.column("id").to_numpy(zero_copy_only=False), np.array([len(x) for x in values], np.int64)
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        m = np.zeros((len(own), dim))
        for size in np.unique(sizes[own]).tolist() if dim else ():
            at = np.flatnonzero(sizes[own] == size)
            m[at] = np.frombuffer(b"".join(values[i] for i in own[at].tolist()), KINDS[size // dim]).reshape(len(at), dim)
        yield dim, ids[own], m


def _gram(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, m in _matrices(batch):
            sums[dim] = sums.get(dim, 0) + m.T @ m
    for dim, m in sums.items():
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.record_batch([pa.array(np.full(dim * dim, dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m.ravel())], ["dim", "i", "j", "s"])


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension the right singular vectors of the rows, largest first, as columns."""
    sums = rows.select("id", "v", "dim").mapInArrow(_gram, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for dim, part in sums.groupby("dim"):
        m = np.zeros((dim, dim))
        m[part.i, part.j] = part.s
        out[int(dim)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def _pack(most: int):
    """Sorted rows -> blocks of one dimension: number in the partition, ids, and whole numbers in the least kind that holds them."""
    def block(no, ids, v, dim):
        ids, v = np.concatenate(ids), np.concatenate(v)
        kind = next(k for k in KINDS.values() if np.abs(v).max(initial=0) <= np.iinfo(k).max)
        longest = np.sqrt((v * v).sum(axis=1)).max()
        return pa.record_batch([pa.array([x], t) for x, t in zip((dim, no, len(ids), longest, ids.tobytes(), v.astype(kind).tobytes()), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["dim", "no", "n", "longest", "ids", "v"])

    def run(batches):
        held: dict[int, tuple[list, list, int]] = {}
        made = 0
        for batch in batches:
            for dim, own_ids, own_v in _matrices(batch):
                at = 0
                while at < len(own_ids):
                    ids, vs, n = held.pop(dim, ([], [], 0))
                    cut = slice(at, at + most - n)
                    ids.append(own_ids[cut].copy())
                    vs.append(own_v[cut].copy())
                    at, n = cut.stop, n + len(ids[-1])
                    if n == most:
                        yield block(made, ids, vs, dim)
                        made += 1
                    else:
                        held[dim] = ids, vs, n
        for dim, (ids, vs, _) in held.items():
            yield block(made, ids, vs, dim)
            made += 1
    return run


BLOCK = "dim int, no int, n int, longest double, ids binary, v binary"


def _blocks(folder: str, names: list[str], dim: int):
    """(file, number, ids, whole numbers) of the blocks of one dimension, file by file."""
    fs, path = filesystem(folder)
    for name in names:
        with fs.open_input_file(f"{path}/{name}") as f, pq.ParquetFile(f, pre_buffer=False) as file:
            for batch in file.iter_batches(1, columns=["dim", "no", "n", "ids", "v"], use_threads=False):
                for at in np.flatnonzero(batch.column("dim").to_numpy() == dim).tolist():
                    n, (ids, v) = batch.column("n")[at].as_py(), (batch.column(c)[at].as_py() for c in ("ids", "v"))
                    yield name, batch.column("no")[at].as_py(), np.frombuffer(ids, np.int64), np.frombuffer(v, KINDS[len(v) // (n * dim)]).reshape(n, dim) if dim else np.zeros((n, 0), np.int8)


def _turned(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated heads, residual norms, norms."""
    m = v.astype(float)
    r = m @ turn
    return r[:, :HEAD], np.sqrt((r[:, HEAD:] ** 2).sum(axis=1)), np.sqrt((m * m).sum(axis=1))


def exact_scores(q: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of q[rows] and v[cols]; small: every partial sum is a whole number that a double holds."""
    if not small:
        return np.array([sum(a * b for a, b in zip(q[i].tolist(), v[j].tolist(), strict=True)) for i, j in zip(rows.tolist(), cols.tolist(), strict=True)], np.int64)
    if 4 * len(rows) > len(q) * len(v):
        return (q.astype(float) @ v.T.astype(float))[rows, cols].astype(np.int64)
    out = np.empty(len(rows), np.int64)
    for lo in range(0, len(rows), 1 << 14):
        cut = slice(lo, lo + (1 << 14))
        out[cut] = np.einsum("ij,ij->i", q[rows[cut]].astype(float), v[cols[cut]].astype(float))
    return out


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of the results (row, score, id) are the k best of their row, in order."""
    order = np.lexsort((ids, -scores, rows))
    own = rows[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    return order[np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) < k]


class _Results:
    """The k best of each query of a group, and its floor: what a result must be above to count, a smaller id being above."""

    def __init__(self, n: int, k: int):
        self.k, self.n, self.scores, self.ids = k, np.zeros(n, np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.floor, self.floor_id = np.full(n, -np.inf), np.zeros(n, np.int64)

    def above(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Beyond 2**52 equal doubles need not be equal scores."""
        floor = self.floor[rows]
        return (scores > floor) | (scores == floor) & ((ids < self.floor_id[rows]) | (np.abs(floor) >= 2.0**52))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        hit, at = np.unique(rows, return_inverse=True)
        had, rank = np.nonzero(np.arange(self.k) < self.n[hit][:, None])
        rows, scores, ids = (np.concatenate(x) for x in ((had, at), (self.scores[hit[had], rank], scores), (self.ids[hit[had], rank], ids)))
        own = _best(rows, scores, ids, self.k)
        rows, scores, ids = rows[own], scores[own], ids[own]
        self.n[hit] = n = np.bincount(rows, minlength=len(hit))
        rank = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        self.scores[hit[rows], rank], self.ids[hit[rows], rank] = scores, ids
        full = hit[n == self.k]
        self.floor[full], self.floor_id[full] = self.scores[full, -1], self.ids[full, -1]


def _meet(ids: np.ndarray, v: np.ndarray, c_turned: tuple, q_ids: np.ndarray, q: dict[type, np.ndarray], q_turned: tuple, most: int, best: _Results) -> None:
    """Adds the results of a block of candidates; ``q``: the whole numbers of the queries, by kind."""
    (head, rest, norm), (q_head, q_rest, q_norm) = c_turned, q_turned
    top = norm.max()
    live = np.flatnonzero(q_norm * top * (1 + SLACK) + 1e-6 >= best.floor)
    if not len(live):
        return
    reach = float(q_norm.max()) * float(top)
    # Whole numbers whose partial sums are all below 2**24 (2**53) are added up exactly in floats (doubles).
    exact, rough = np.float32 if reach < 2.0**24 else float if reach < 2.0**52 else None, np.float32 if reach < 2.0**52 else float
    c_bound = np.ascontiguousarray(np.column_stack((head, rest, np.full(len(ids), SLACK * top), np.full(len(ids), 1e-6))).T.astype(rough))
    bound = lambda at, c: np.column_stack((q_head[at], q_rest[at], q_norm[at], np.ones(len(at)))).astype(rough) @ c_bound[:, c] >= best.floor[at].astype(rough)[:, None]
    whole = exact is not None and bound(live[:: -(-len(live) // 32)], slice(None)).mean() > 0.25
    if whole:
        if exact not in q:
            q[exact] = q[np.int64].astype(exact)
        columns = np.ascontiguousarray(v.T.astype(exact))
        room = np.empty(most * TILE, exact)
    twice = np.unique(ids, return_counts=True)[1].max()  # rows of a query's own id at most
    found = []
    for lo in range(0, len(live), most):
        at = live[lo : lo + most]
        for left in range(0, len(ids), TILE):
            c = slice(left, min(left + TILE, len(ids)))
            if whole:
                s = np.dot(q[exact][at], columns[:, c], out=room[: len(at) * (c.stop - left)].reshape(len(at), -1))
                floor = best.floor[at].astype(exact)
                if (new := np.flatnonzero(floor == -np.inf)).size and s.shape[1] > best.k + twice:
                    floor[new] = np.partition(s[new], -best.k - twice, axis=1)[:, -best.k - twice]
                some = np.flatnonzero(s.max(axis=1) >= floor)
                rows, cols = np.nonzero(s[some] >= floor[some][:, None])
                rows = some[rows]
                scores = s[rows, cols].astype(np.int64)
            else:
                rows, cols = np.nonzero(bound(at, c))
                scores = exact_scores(q[np.int64][at], v[c], rows, cols, exact is not None)
            rows, cols = at[rows], cols + left
            kept = (ids[cols] != q_ids[rows]) & best.above(rows, scores, ids[cols])
            if kept.any():
                found.append((rows[kept], scores[kept], ids[cols[kept]]))
                if best.floor[at[0]] == -np.inf or sum(len(x[0]) for x in found) > 1 << 18:
                    best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    found = []
    if found:
        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _score(k: int, most: int, turn: dict[int, np.ndarray], folders: tuple, tasks: list[tuple]):
    """Numbers of tasks -> their results. A task: dimension, files of candidates, first query, sizes of the blocks of queries by (file, number)."""
    blocks, asked, floors = folders

    def run(batches):
        for no in (x for batch in batches for x in batch.column("id").to_pylist()):
            dim, names, start, queries = tasks[no]
            own = turn.get(dim, np.eye(dim))  # empty vectors have no Gram matrix
            read = {(name, no): x for name, no, *x in _blocks(asked, sorted({name for name, _ in queries}), dim) if (name, no) in queries}
            q_ids, v = np.concatenate([read[x][0] for x in queries]), np.concatenate([read[x][1] for x in queries])
            del read
            q, q_turned, best = {np.int64: v}, _turned(v, own), _Results(len(v), k)
            if floors:
                fs, path = filesystem(floors)
                known = ds.dataset(path, filesystem=fs, format="parquet").to_table(filter=(ds.field("q") >= start) & (ds.field("q") < start + len(v)), use_threads=False)
                at = known.column("q").to_numpy() - start
                best.floor[at], best.floor_id[at] = known.column("score").to_numpy(), known.column("vec_id").to_numpy()
            for _, _, ids, v in _blocks(blocks, names, dim):
                _meet(ids, v, _turned(v, own), q_ids, q, q_turned, most, best)
            at, rank = np.nonzero(np.arange(k) < best.n[:, None])
            if len(at):
                yield pa.record_batch([pa.array(start + at), pa.array(q_ids[at]), pa.array(best.ids[at, rank]), pa.array(best.scores[at, rank])], ["q", "query_id", "vec_id", "score"])
    return run


FOUND = "q long, query_id long, vec_id long, score long"


def _written(rows: DataFrame, name: str, most: int) -> tuple[str, DataFrame]:
    """Folder of the blocks of rows; what is in it, by file."""
    at = new_folder(rows.sparkSession, name)
    rows.mapInArrow(_pack(most), BLOCK).write.parquet(at)
    return at, rows.sparkSession.read.schema(BLOCK).parquet(at).withColumn("file", F.col("_metadata.file_name"))


def _waves(files: list[tuple[str, int]]) -> list[list[list[str]]]:
    """(file, rows) by falling norm -> waves of parts of consecutive files: the first file, parts of an eighth of the rest if there are many, and others."""
    (first, _), *files = files
    each, parts, n = sum(n for _, n in files) / PARTS, [], 0
    for name, rows in files:
        if not parts or n + rows / 2 > each * len(parts):
            parts.append([])
        parts[-1].append(name)
        n += rows
    cut = len(parts) // 8 if len(parts) >= 16 else 0
    return [[[first]], parts[:cut], parts[cut:]]


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Both sides as quantised(); (query_id, rank, vec_id, score) of the k best candidates of each query but itself."""
    spark: SparkSession = candidates.sparkSession
    candidates, queries = (x.select("id", "v", "dim").mapInArrow(_narrow, ROWS) for x in (candidates, queries))
    # Of equal vectors only those of the k + 1 smallest ids can be among the k best of any query, one being its own; each task drops the others before they are shuffled.
    copies = F.dense_rank().over(Window.partitionBy("dim", "v").orderBy("id"))
    candidates = stage(candidates.withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    turn = rotations(candidates)
    n = partitions(spark)
    sized = F.col("norm").desc()
    blocks, there = _written(candidates.repartitionByRange(n, sized, "id").sortWithinPartitions(sized, "id"), "blocks", CANDIDATES)
    asked, named = _written(queries.repartition(n, "id").sortWithinPartitions("id"), "queries", QUERIES)
    files: dict[int, list] = {}
    for x in there.groupBy("dim", "file").agg(F.sum("n").alias("n"), F.max("longest").alias("longest")).collect():
        files.setdefault(x.dim, []).append((-x.longest, x.file, x.n))
    # Groups of blocks of queries; queries are numbered as they stand in them.
    groups: list[tuple[int, int, dict]] = []
    start = 0
    for x in sorted(named.select("dim", "file", "no", "n").collect()):
        if not groups or groups[-1][0] != x.dim or len(groups[-1][2]) == GROUP or (start - groups[-1][1] + x.n) * x.dim > NUMBERS:
            groups.append((x.dim, start, {}))
        groups[-1][2][x.file, x.no] = x.n
        start += x.n
    waves = {dim: _waves([x[1:] for x in sorted(own)]) for dim, own in files.items()}
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda found: reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    found, floors = [], None
    for wave in range(3):
        tasks = [(dim, part, at, own) for dim, at, own in groups if dim in waves for part in waves[dim][wave]]
        if not tasks:
            continue
        if found:
            floors = new_folder(spark, "floors")
            ranked(found).where(F.col("rank") == k).select("q", "score", "vec_id").write.parquet(floors)
        ran = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(_score(k, QUERIES, turn, (blocks, asked, floors), tasks), FOUND)
        found.append(stage(ran, "found"))
    if not found:
        found = [spark.createDataFrame([], FOUND)]
    return ranked(found).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("id") % 50 == 0), 5)
