"""The authenticated tree of a snapshot, built level by level: same entries, same root, whatever the partitions.

Chunking is a fold that forgets its past at every node start. Range partitions are therefore first folded from their own
first entry, over key hashes and sizes alone; the driver then carries the fold's state (two numbers) from partition to
partition, replaying the head of each until a true node start falls on one found there, after which the rest stands. The
true starts become the partition bounds of a second pass, in which every task begins with a node and so encodes whole nodes.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import MAX_INLINE, MAX_KEY, MAX_VALUE
from .boundary import SPLIT_DOMAIN, Chunker, key_hashes, parity_blocks, parity_of, splits_after
from .logical import check_edits
from .node import EMPTY, EMPTY_ROOT, PARITY_KIND, RAW, TREE_NODE, Node, Value, block_ids, branch_cost, leaf_cost

#: Entries of a partition at most, about; at least, while the session has partitions to spare; and entries at its head that the driver may replay at once.
ROWS, LEAST, HEAD = 100_000, 5_000, 512
#: Rows, nodes, and bytes of values that a task works on together, about.
SLICE, NODES, BYTES = 1000, 64, 2 << 20
#: Partitions at most for each that the rows or the session ask for: the driver gets HEAD entries of each, and each is a task.
SHARES = 4
ENTRY = "key binary, body binary, cid binary, entries long, bytes long"
NODE = "key binary, body binary, cid binary, entries long, bytes long, parity array<struct<cid: binary, body: binary>>"
FOLD = "part int, n long, keys array<binary>, hashes array<long>, costs array<int>, starts array<int>, size int, closed boolean"


def _prepared(rows: list[dict], level: int) -> tuple[list[int], list[int]]:
    hashes = key_hashes(SPLIT_DOMAIN, level, [r["key"] for r in rows]).tolist() if rows else []
    costs = [branch_cost(len(r["key"])) if level else leaf_cost(len(r["key"]), len(r["body"]) if r["cost_body"] is None else r["cost_body"]) for r in rows]
    return hashes, costs


def _parts(bounds: list[bytes]):
    """A column function of keys: the partition of each. Only keys go to Python."""
    @F.arrow_udf("int")
    def part(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, k) for k in keys.to_pylist()], pa.int32())
    return part


def _slices(batches):
    """Batches of at most SLICE rows: what a task makes of a batch's values is several times their size."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def _by_part(batches):
    """(part, its rows) of batches sorted by part, in pieces."""
    for batch in _slices(batches):
        rows = batch.to_pylist()
        lo = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i]["part"] != rows[lo]["part"]:
                yield rows[lo]["part"], rows[lo:i]
                lo = i


def _fold(level: int):
    def run(batches):
        out, chunker = None, None
        def done():
            return pa.record_batch([pa.array([out[f]], t) for f, t in zip(("part", "n", "keys", "hashes", "costs", "starts"), (pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)]
                                   + [pa.array([chunker.size], pa.int32()), pa.array([chunker.closed])], [f.split()[0] for f in FOLD.split(", ")])
        for part, rows in _by_part(batches):
            if out is None or out["part"] != part:
                if out is not None:
                    yield done()
                out, chunker = {"part": part, "n": 0, "keys": [], "hashes": [], "costs": [], "starts": []}, Chunker()
            for r, h, cost in zip(rows, *_prepared(rows, level), strict=True):
                opens = chunker.starts(h, cost)
                if out["n"] < HEAD:
                    out["keys"].append(r["key"])
                    out["hashes"].append(h)
                    out["costs"].append(cost)
                    if opens:
                        out["starts"].append(out["n"])
                out["n"] += 1
        if out is not None:
            yield done()
    return run


def true_starts(folds: list, more) -> list[bytes]:
    """First true node start of each partition that has one. more(part) gives all of a partition's (keys, hashes, costs, starts)."""
    state, out = Chunker(), []
    for f in folds:
        keys, hashes, costs, starts, n = f["keys"], f["hashes"], f["costs"], set(f["starts"]), f["n"]
        for _ in range(2):
            now, first, joined = Chunker(), None, False
            now.size, now.closed = state.size, state.closed
            for i, (h, cost) in enumerate(zip(hashes, costs, strict=True)):
                if now.starts(h, cost):
                    first = keys[i] if first is None else first
                    if i in starts:
                        joined = True
                        break
            if joined or len(keys) == n:
                break
            keys, hashes, costs, own = more(f["part"])
            starts = set(own)
        if joined:
            state.size, state.closed = f["size"], f["closed"]
        else:
            state = now
        if first is not None:
            out.append(first)
    return out


def _whole(level: int, batches):
    """Lists of nodes as (rows, node, body, id, parity), of batches sorted by part and key. What is hashed is hashed for a list at once."""
    held: list[dict] = []
    ready: list[list[dict]] = []
    part, chunker, size = None, Chunker(), 0

    def flush():
        own = []
        for rows in ready:
            node = Node(level, [r["key"] for r in rows])
            if level:
                node.children = [(r["cid"], r["entries"], r["bytes"]) for r in rows]
            else:
                node.values = [Value.of(r["body"], r["cid"]) for r in rows]
            own.append(node)
        parity = parity_of(own, [lambda i, rows=rows: rows[i]["body"] for rows in ready])
        for node, coded in zip(own, parity, strict=True):
            node.parity = [c for c, _ in coded]
        bodies = [node.encode() for node in own]
        return list(zip(ready, own, bodies, block_ids([(TREE_NODE, body) for body in bodies]), parity, strict=True))

    for number, rows in _by_part(batches):
        if number != part:
            if held:
                ready.append(held)
            part, chunker, held = number, Chunker(), []
        for r, h, cost in zip(rows, *_prepared(rows, level), strict=True):
            if chunker.starts(h, cost) and held:
                ready.append(held)
                held = []
                if len(ready) >= NODES or size >= BYTES:
                    yield flush()
                    ready, size = [], 0
            held.append(r)
            size += len(r["body"])
    if held:
        ready.append(held)
    if ready:
        yield flush()


def _encode(level: int, bodies: bool = True):
    def run(batches):
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("cid", pa.binary()), ("body", pa.binary())]))]
        for own in _whole(level, batches):
            cols = list(zip(*[(n.keys[0], body, cid, *n.agg, [{"cid": c, "body": b if bodies else None} for c, b in p]) for _, n, body, cid, p in own], strict=True))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "body", "cid", "entries", "bytes", "parity"])
    return run


def _referenced(batches):
    """Gives entries with referenced values their block ids."""
    for batch in _slices(batches):
        bodies = batch.column("body").to_pylist()
        long = [i for i, b in enumerate(bodies) if len(b) > MAX_INLINE]
        cids = [None] * len(bodies)
        for i, cid in zip(long, block_ids([(RAW, bodies[i]) for i in long]) if long else [], strict=True):
            cids[i] = cid
        zero = pa.array([0] * len(bodies), pa.int64())
        yield pa.record_batch([batch.column("key"), batch.column("body"), pa.array(cids, pa.binary()), zero, zero], ["key", "body", "cid", "entries", "bytes"])


def level_bounds(rows: DataFrame, level: int, n: int, per_part: int = ROWS) -> tuple[int, list[bytes]]:
    """(partitions at most, keys that begin them) for n rows (ENTRY): each begins with a node."""
    spare = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST))
    parts = max(1, min(-(-n // per_part), SHARES * max(spare, -(-n // ROWS))), spare)
    bounds: list[bytes] = []
    if parts > 1:
        # A bounded sample of keys; any bounds give the same nodes.
        keys = [r.key for r in rows.select("key").orderBy(F.xxhash64("key"), "key").limit(parts * 32).collect()]
        keys.sort()
        bounds = sorted({keys[i * len(keys) // parts] for i in range(1, parts)})
        size = F.when(F.octet_length("body") > MAX_INLINE, 32).otherwise(F.octet_length("body")) if not level else F.lit(0)
        slim = rows.select("key", F.lit(b"").alias("body"), size.cast("int").alias("cost_body"))
        dealt = slim.withColumn("part", _parts(bounds)("key")).repartitionById(parts, "part").sortWithinPartitions("part", "key")
        folds = sorted(dealt.mapInArrow(_fold(level), FOLD).collect(), key=lambda r: r["part"])  # HEAD entries a partition at most

        def more(part: int):
            own = dealt.where(F.col("part") == part).orderBy("key").collect()
            found = [r.asDict() for r in own]
            hashes, costs = _prepared(found, level)
            chunker = Chunker()
            return [r["key"] for r in found], hashes, costs, [i for i, (h, c) in enumerate(zip(hashes, costs, strict=True)) if chunker.starts(h, c)]

        bounds = true_starts(folds, more)[1:]
    return parts, bounds


def deal(rows: DataFrame, level: int, parts: int, bounds: list[bytes], marks: DataFrame | None = None) -> DataFrame:
    """The rows (ENTRY) by partition, sorted by key. marks (key, cid) travel with them, each before the row of its key; ``mark`` tells them."""
    full = rows.withColumn("cost_body", F.when(F.octet_length("body") > MAX_INLINE, 32).cast("int") if not level else F.lit(None).cast("int"))
    order = ["part", "key"]
    if marks is not None:
        order = [*order, F.desc("mark")]
        full = full.withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    return full.withColumn("part", _parts(bounds)("key")).repartitionById(parts, "part").sortWithinPartitions(*order)


def level_nodes(rows: DataFrame, level: int, cut: tuple[int, list[bytes]], bodies: bool = True) -> DataFrame:
    """The nodes over rows (ENTRY), by the level's bounds; with or without the bodies of their parity."""
    return deal(rows, level, *cut).mapInArrow(_encode(level, bodies), NODE)


@dataclass
class Tree:
    """A root, its height and aggregate, the nodes of each level, and the blocks that store it all."""

    root: bytes
    height: int
    agg: tuple[int, int]
    levels: list[DataFrame] = field(repr=False)
    entries: DataFrame | None = field(repr=False, default=None)
    #: The leaves' partitions and bounds; and whether the leaves' parity is there by id only.
    cut: tuple[int, list[bytes]] | None = field(repr=False, default=None)
    slim: bool = False

    def release(self) -> None:
        """Gives up what the build has kept; the tree stays usable and is then computed again where it is read."""
        for kept in (*self.levels, self.entries):
            if kept is not None:
                kept.unpersist()

    def nodes(self) -> DataFrame:
        out = self.levels[0].withColumn("level", F.lit(0))
        for i, level in enumerate(self.levels[1:], 1):
            out = out.unionByName(level.withColumn("level", F.lit(i)))
        return out

    def blocks(self, once: bool = True) -> DataFrame:
        """(cid, kind, body), each once; or as often as it is made, which spares a shuffle of all bodies."""
        if self.slim:
            raise ValueError("the leaves' parity has not been kept")
        nodes = self.nodes()
        out = nodes.select("cid", F.lit(TREE_NODE).alias("kind"), "body")
        parity = nodes.select(F.explode("parity").alias("p")).select("p.cid", F.lit(PARITY_KIND).alias("kind"), "p.body")
        out = out.unionByName(parity)
        if self.entries is not None:
            out = out.unionByName(self.entries.where("cid is not null").select("cid", F.lit(RAW).alias("kind"), "body"))
        return out.dropDuplicates(["cid"]) if once else out


def build(entries: DataFrame, per_part: int = ROWS, slim: bool = False) -> Tree:
    """The tree of entries (key, value), whose keys must be unique and at most MAX_KEY bytes. slim: the bodies of the leaves'
    parity, which can be several times the values, are not kept; pack_tree codes them again."""
    spark = entries.sparkSession
    # Kept, so that long values are hashed once, and the table is read once, however many passes follow.
    rows = entries.select("key", F.col("value").alias("body")).mapInArrow(_referenced, ENTRY).persist(StorageLevel.MEMORY_AND_DISK)
    n, level, levels = rows.count(), 0, []
    check_edits(rows.select("key", F.col("body").alias("value")))
    if not n:
        empty = spark.createDataFrame([(b"", EMPTY, EMPTY_ROOT, 0, 0, [])], NODE)
        return Tree(EMPTY_ROOT, 1, (0, 0), [empty])
    values, current, first = rows, rows, None
    while True:
        cut = level_bounds(current, level, n, per_part)
        first = first or cut
        nodes = level_nodes(current, level, cut, bool(level) or not slim).persist()
        n = nodes.count()
        levels.append(nodes)
        if n == 1:
            top = nodes.select("cid", "entries", "bytes").first()
            return Tree(bytes(top.cid), level + 1, (top.entries, top.bytes), levels, values, first, slim)
        current, level = nodes.select("key", "body", "cid", "entries", "bytes"), level + 1


def build_local(entries: list[tuple[bytes, bytes]], rule=splits_after) -> tuple[bytes, dict[bytes, tuple[int, bytes]]]:
    """(root, blocks by id as (kind, body)) of sorted entries in memory: for small trees, single batches and tests."""
    blocks: dict[bytes, tuple[int, bytes]] = {}
    if not entries:
        return EMPTY_ROOT, {EMPTY_ROOT: (TREE_NODE, EMPTY)}
    rows = []
    for key, data in entries:
        v = Value.of(data)
        if v.is_ref:
            blocks[v.cid] = (RAW, data)
        rows.append((key, v, data))
    level = 0
    while True:
        keys = [r[0] for r in rows]
        hashes = key_hashes(SPLIT_DOMAIN, level, keys).tolist()
        chunker, runs = Chunker(rule), []
        for r, h in zip(rows, hashes, strict=True):
            if chunker.starts(h, branch_cost(len(r[0])) if level else leaf_cost(len(r[0]), len(r[1].stored))):
                runs.append([])
            runs[-1].append(r)
        made = []
        for run in runs:
            node = Node(level, [r[0] for r in run])
            if level:
                node.children = [r[1] for r in run]
            else:
                node.values = [r[1] for r in run]
            parity = parity_blocks(node, lambda i, run=run: run[i][2])
            blocks.update({c: (PARITY_KIND, b) for c, b in parity})
            node.parity = [c for c, _ in parity]
            made.append((node, node.encode()))
        ids = block_ids([(TREE_NODE, body) for _, body in made])
        blocks.update({c: (TREE_NODE, body) for c, (_, body) in zip(ids, made, strict=True)})
        if len(made) == 1:
            return ids[0], blocks
        rows = [(n.keys[0], (cid, *n.agg), body) for cid, (n, body) in zip(ids, made, strict=True)]
        level += 1


class TreeError(Exception):
    """Why a streaming build stops: NotSorted, MissingMember, KeyTooLong, ValueTooLong, TooDeep, or Poisoned after any failure that came late."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


class TreeBuilder:
    """A tree from entries in key order, one at a time. sink(id, kind, body) gets each block once its node closes, members
    before the nodes that name them, the root last; parity comes with finish_with_parity. One open node a level is held."""

    def __init__(self, sink, rule=splits_after, batch: int = 256) -> None:
        self.sink, self.rule, self.batch = sink, rule, batch
        self.levels: list[dict] = []
        self.waiting: list[tuple[bytes, Value, bytes | None]] = []
        self.seen: dict[bytes, bytes] = {}
        self.last, self.poisoned, self.parity = None, False, []

    def see(self, cid: bytes, body: bytes) -> None:
        """Gives the body of a referenced value that a later push names."""
        self.seen[cid] = body

    def push_bytes(self, key: bytes, data: bytes) -> None:
        v = Value.of(data)
        self._take(key, v, data)
        if v.is_ref:
            self.sink(v.cid, RAW, data)

    def push(self, key: bytes, v: Value) -> None:
        """An entry whose value is known by id and length; its body must have been seen, since parity is coded over it."""
        if v.is_ref and v.cid not in self.seen:
            raise TreeError("MissingMember")
        self._take(key, v, self.seen[v.cid] if v.is_ref else v.inline)

    def _take(self, key: bytes, v: Value, data: bytes) -> None:
        if self.poisoned:
            raise TreeError("Poisoned")
        if len(key) > MAX_KEY:
            raise TreeError("KeyTooLong")
        if v.length > MAX_VALUE:
            raise TreeError("ValueTooLong")
        if self.last is not None and self.last >= key:
            raise TreeError("NotSorted")
        self.last = key
        self.waiting.append((key, v, data))
        if len(self.waiting) >= self.batch:  # keys are hashed many at once
            self._flush()

    def _flush(self) -> None:
        rows, self.waiting = self.waiting, []
        try:
            self._add(0, rows)
        except Exception:
            self.poisoned = True
            raise

    def _add(self, level: int, rows: list[tuple[bytes, object, bytes]]) -> None:
        if not rows:
            return
        if level > 255:
            raise TreeError("TooDeep")
        if level == len(self.levels):
            self.levels.append({"chunker": Chunker(self.rule), "rows": [], "closed": 0, "first": None})
        at = self.levels[level]
        for row, h in zip(rows, key_hashes(SPLIT_DOMAIN, level, [r[0] for r in rows]).tolist(), strict=True):
            cost = branch_cost(len(row[0])) if level else leaf_cost(len(row[0]), len(row[1].stored))
            if at["chunker"].starts(h, cost) and at["rows"]:
                self._close(level)
            at["rows"].append(row)

    def _close(self, level: int) -> None:
        at = self.levels[level]
        rows, at["rows"] = at["rows"], []
        node = Node(level, [r[0] for r in rows])
        if level:
            node.children = [r[1] for r in rows]
        else:
            node.values = [r[1] for r in rows]
        parity = parity_blocks(node, lambda i: rows[i][2])
        node.parity = [c for c, _ in parity]
        body = node.encode()
        cid = block_ids([(TREE_NODE, body)])[0]
        self.parity += parity
        self.sink(cid, TREE_NODE, body)
        child = (node.keys[0], (cid, *node.agg), body)
        at["closed"] += 1
        if at["closed"] == 1:
            at["first"] = child  # the root, if no other follows
            return
        if at["first"] is not None:
            first, at["first"] = at["first"], None
            self._add(level + 1, [first])
        self._add(level + 1, [child])

    def finish_with_parity(self) -> tuple[bytes, list[tuple[bytes, bytes]]]:
        """(root, (id, body) of all parity blocks)."""
        if self.poisoned:
            raise TreeError("Poisoned")
        self._flush()
        self.poisoned = True  # finished: nothing may follow
        if not self.levels:
            self.sink(EMPTY_ROOT, TREE_NODE, EMPTY)
            return EMPTY_ROOT, []
        level = 0
        while True:
            at = self.levels[level]
            if at["rows"]:
                self._close(level)
            if at["closed"] == 1:
                return at["first"][1][0], self.parity
            level += 1

    def finish(self) -> bytes:
        return self.finish_with_parity()[0]
