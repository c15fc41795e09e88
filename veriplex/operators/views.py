"""A tree's nodes as relations, and the operators on them: recorded sums, checks, frontiers, new blocks, parity."""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boundary import MAX_MEMBER_NODE, MAX_MEMBER_VALUE, BoundaryError, check_node, encode_group, fraud, member_ids, repair_group
from .build import Tree, build
from .logical import Range, apply, effective, whole
from .node import PARITY_KIND, RAW, TREE_NODE, block_ids, parse, try_parse

EDGE = "parent binary, level int, pos int, min_key binary, child binary, entries long, bytes long"
LEAF_ROW = "leaf binary, pos int, key binary, is_ref boolean, length int, stored binary"


def _edges(batches):
    for batch in batches:
        rows = []
        for cid, body in zip(batch.column("cid").to_pylist(), batch.column("body").to_pylist(), strict=True):
            node, _ = try_parse(body)
            rows += [(cid, node.level, i, k, *c) for i, (k, c) in enumerate(zip(node.keys, node.children, strict=True))] if node and node.level else []
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in EDGE.split(", ")])


def edges(nodes: DataFrame) -> DataFrame:
    """One row a child of every branch among nodes (cid, body)."""
    return nodes.select("cid", "body").mapInArrow(_edges, EDGE)


def _leaf_rows(batches):
    for batch in batches:
        rows = []
        for cid, body in zip(batch.column("cid").to_pylist(), batch.column("body").to_pylist(), strict=True):
            node, _ = try_parse(body)
            rows += [(cid, i, k, v.is_ref, v.length, v.stored) for i, (k, v) in enumerate(zip(node.keys, node.values, strict=True))] if node and not node.level else []
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.binary(), pa.int32(), pa.binary(), pa.bool_(), pa.int32(), pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in LEAF_ROW.split(", ")])


def leaf_rows(nodes: DataFrame) -> DataFrame:
    """One row an entry of every leaf among nodes (cid, body)."""
    return nodes.select("cid", "body").mapInArrow(_leaf_rows, LEAF_ROW)


HEADER = "cid binary, level int, n int, min_key binary, max_key binary, entries long, bytes long, pcount int, error string, boundary string"


def _headers(batches):
    for batch in batches:
        rows = []
        for cid, body in zip(batch.column("cid").to_pylist(), batch.column("body").to_pylist(), strict=True):
            node, error = try_parse(body)
            if node is None:
                rows.append((cid, None, None, None, None, None, None, None, error, None))
                continue
            try:
                check_node(node)
                bad = None
            except BoundaryError as e:
                bad = e.kind
            rows.append((cid, node.level, len(node), node.keys[0] if node.keys else None, node.keys[-1] if node.keys else None, *node.agg, len(node.parity), None, bad))
        cols = list(zip(*rows, strict=True)) or [()] * 10
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in HEADER.split(", ")])


def headers(nodes: DataFrame) -> DataFrame:
    """What each node says of itself, why it does not parse, and which boundary rule it breaks."""
    return nodes.select("cid", "body").mapInArrow(_headers, HEADER)


def spanned(tree: Tree) -> DataFrame:
    """Edges with ``upper``: the next sibling's key, else the bound that the parent inherited; one join a level, from the top."""
    own = edges(tree.nodes()).persist()
    after = F.lead("min_key").over(Window.partitionBy("parent").orderBy("pos"))
    out, above = None, None
    for level in range(tree.height - 1, 0, -1):
        here = own.where(F.col("level") == level).withColumn("sibling", after)
        here = here.withColumn("inherited", F.lit(None).cast("binary")) if above is None else here.join(above, "parent", "left")
        here = here.withColumn("upper", F.coalesce("sibling", "inherited")).drop("sibling", "inherited")
        above = here.select(F.col("child").alias("parent"), F.col("upper").alias("inherited"))
        out = here if out is None else out.unionByName(here)
    return own.withColumn("upper", F.lit(None).cast("binary")) if out is None else out


def span(r: Range, low: Column, top: Column) -> Column:
    """Inside, Edge or null: how keys from low on and below top (null: open) lie to the range."""
    r = r.with_after()
    apart, inside = F.lit(False), F.lit(True)
    if r.hi.key is not None:
        apart = apart | ((low > F.lit(r.hi.key)) if r.hi.included else (low >= F.lit(r.hi.key)))
        inside = inside & top.isNotNull() & (top <= F.lit(r.hi.key))
    if r.lo.key is not None:
        apart = apart | (top.isNotNull() & (top <= F.lit(r.lo.key)))
        inside = inside & ((low >= F.lit(r.lo.key)) if r.lo.included else (low > F.lit(r.lo.key)))
    return F.when(apart, F.lit(None)).when(F.coalesce(inside, F.lit(False)), "Inside").otherwise("Edge")


def aggregate_claimed(tree: Tree, r: Range = Range()) -> DataFrame:
    """(entries, bytes) by recorded sums: the topmost edges inside the range, and the entries of the leaves on its two edges."""
    whole(r)
    size = (F.octet_length("key") + F.col("length")).cast("long")
    if tree.height == 1:
        return leaf_rows(tree.levels[0]).where(r.condition(F.col("key"))).agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    e = spanned(tree).withColumn("span", span(r, F.col("min_key"), F.col("upper")))
    up = e.select(F.col("child").alias("parent"), F.col("span").alias("above"))
    e = e.join(up, "parent", "left").where((F.col("above").isNull() & (F.col("level") == tree.height - 1)) | (F.col("above") == "Edge"))
    e = e.where(F.lit(not r.is_empty()))
    recorded = e.where("span = 'Inside'").select("entries", "bytes")
    leaves = e.where("span = 'Edge' and level = 1").select(F.col("child").alias("cid"))  # two at most
    read = leaf_rows(tree.levels[0].join(F.broadcast(leaves), "cid", "left_semi")).where(r.condition(F.col("key")))
    both = recorded.unionByName(read.select(F.lit(1).cast("long").alias("entries"), size.alias("bytes")))
    return both.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


FAULTS = ("level", "entries", "bytes", "first key", "parse", "overlap")


def contradictions(spanned_edges: DataFrame, node_headers: DataFrame) -> DataFrame:
    """(parent, child, fault) of edges whose child is not what the parent says, a row for each of FAULTS: level, aggregates,
    first key, a block that does not parse, or a last key past the inherited bound."""
    h = node_headers.select("cid", F.col("level").alias("own_level"), F.col("entries").alias("own_entries"), F.col("bytes").alias("own_bytes"), F.col("min_key").alias("own_key"), "max_key", "error")
    met = spanned_edges.join(h, F.col("child") == F.col("cid"))
    wrong = (F.col("own_level") + 1 != F.col("level"), F.col("entries") != F.col("own_entries"), F.col("bytes") != F.col("own_bytes"), ~F.col("min_key").eqNullSafe(F.col("own_key")),
             F.col("error").isNotNull(), F.col("upper").isNotNull() & (F.col("max_key") >= F.col("upper")))
    found = F.filter(F.array(*[F.when(w, F.lit(name)) for name, w in zip(FAULTS, wrong, strict=True)]), lambda x: x.isNotNull())
    return met.select("parent", "child", F.explode(found).alias("fault"))


def violations(tree: Tree) -> DataFrame:
    """(parent, child, fault) of a tree's edges that contradict the node below them."""
    return contradictions(spanned(tree), headers(tree.nodes()))


def _checked(batches):
    for batch in batches:
        cids, bodies = batch.column("cid").to_pylist(), batch.column("body").to_pylist()
        ids = block_ids([(TREE_NODE, b) for b in bodies]) if bodies else []
        for cid, body, own in zip(cids, bodies, ids, strict=True):
            if own != cid:
                raise ValueError(f"block {cid.hex()} does not hash to its id")
            node = parse(body)
            if node.level:
                raise ValueError(f"block {cid.hex()} is not a leaf")
            check_node(node)
        yield batch


def aggregate_verified(tree: Tree, r: Range = Range()) -> DataFrame:
    """(entries, bytes) counted over the entries of the leaves that meet the range, each hashed, parsed and checked on the way; a bad block ends the job."""
    whole(r)
    size = (F.octet_length("key") + F.col("length")).cast("long")
    leaves = tree.levels[0].select("cid", "body")
    if tree.height > 1:
        met = spanned(tree).where(F.lit(not r.is_empty()) & (F.col("level") == 1) & span(r, F.col("min_key"), F.col("upper")).isNotNull())
        leaves = leaves.join(met.select(F.col("child").alias("cid")), "cid", "left_semi")
    rows = leaf_rows(leaves.mapInArrow(_checked, "cid binary, body binary")).where(r.condition(F.col("key")))
    return rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def dereferenced(leaves: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, value) of the leaf rows that hold references, by their ids; a missing block or one of a wrong length ends the job."""
    refs = leaves.where("is_ref").select("key", "length", F.col("stored").alias("cid"))
    met = refs.join(blocks.where(F.col("kind") == RAW).select("cid", "body"), "cid", "left")
    ok = F.octet_length("body").eqNullSafe(F.col("length"))
    return met.select("key", F.when(ok, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("lost value "), F.hex("cid"))).cast("binary")).alias("value"))


def lying(tree: Tree, leaves: DataFrame) -> DataFrame:
    """The branches over the named leaves (cid), each saying one entry more of them than there is: for tests of the checks."""
    owners = edges(tree.levels[1]).join(leaves, F.col("child") == F.col("cid"), "left_semi").groupBy("parent").agg(F.collect_set("child").alias("liars"))
    rows = tree.levels[1].select("cid", "body").join(owners, F.col("cid") == F.col("parent"))

    def run(batches):
        for batch in batches:
            bodies = []
            for body, liars in zip(batch.column("body").to_pylist(), batch.column("liars").to_pylist(), strict=True):
                node, named = parse(body), set(liars)
                node.children = [(c, n + (c in named), size) for c, n, size in node.children]
                bodies.append(node.encode())
            yield pa.record_batch([pa.array(block_ids([(TREE_NODE, b) for b in bodies]) if bodies else [], pa.binary()), pa.array(bodies, pa.binary())], ["cid", "body"])

    return rows.mapInArrow(run, "cid binary, body binary")


def frauds(tree: Tree) -> DataFrame:
    """Pairs of a branch and a child that contradict each other, by the two blocks alone."""
    return fraudulent(tree.nodes().select("cid", "body"))


def fraudulent(n: DataFrame) -> DataFrame:
    """The same among any blocks (cid, body)."""
    pairs = edges(n).select("parent", "child").join(n.select(F.col("cid").alias("parent"), F.col("body").alias("parent_body")), "parent").join(n.select(F.col("cid").alias("child"), F.col("body").alias("child_body")), "child")

    def run(batches):
        for batch in batches:
            found = [fraud(p, c) for p, c in zip(batch.column("parent_body").to_pylist(), batch.column("child_body").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("parent"), batch.column("child")], ["parent", "child"]).filter(pa.array(found))

    return pairs.mapInArrow(run, "parent binary, child binary")


def new_nodes(a: Tree, b: Tree) -> DataFrame:
    """Nodes of b that a has not: what a holder of a needs to read b."""
    return b.nodes().join(a.nodes().select("cid"), "cid", "left_anti")


def structural_changes(a: Tree, b: Tree) -> DataFrame:
    """(key, change, old, new): leaves that both trees share hold no change, so only the others are joined."""
    def own(x: Tree, y: Tree, name: str) -> DataFrame:
        rows = leaf_rows(x.levels[0].join(y.levels[0].select("cid"), "cid", "left_anti"))
        return rows.select("key", F.struct("is_ref", "length", "stored").alias(name))

    if a.root == b.root:
        return own(a, b, "old").select("key", F.lit("").alias("change"), "old", F.col("old").alias("new")).where(F.lit(False))
    both = own(a, b, "old").join(own(b, a, "new"), "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("key", F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Removed").otherwise("Changed").alias("change"), "old", "new")


def apply_tree(tree: Tree, entries: DataFrame, edits: DataFrame, per_part: int = 100_000) -> tuple[Tree, DataFrame, DataFrame]:
    """(tree after the edits, its new blocks, replaced node ids). The root is that of a rebuild, since shape follows from contents; a batch of no-ops returns the same tree."""
    real = effective(entries, edits)
    if real.isEmpty():
        none = tree.blocks().where(F.lit(False))
        return tree, none, none.select("cid")
    after = build(apply(entries, real), per_part)
    fresh = after.blocks().join(tree.blocks().select("cid"), "cid", "left_anti")
    replaced = tree.nodes().select("cid").join(after.nodes().select("cid"), "cid", "left_anti")
    return after, fresh, replaced


GROUP = "node binary, level int, class int, grp int, members array<binary>, parity array<binary>"


def _groups(batches):
    for batch in batches:
        rows = []
        for cid, body in zip(batch.column("cid").to_pylist(), batch.column("body").to_pylist(), strict=True):
            node, _ = try_parse(body)
            rows += [(cid, node.level, c, i, m, node.parity[8 * i:8 * i + 8]) for i, (c, m) in enumerate(member_ids(node))] if node else []
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in GROUP.split(", ")])


def parity_groups(nodes: DataFrame) -> DataFrame:
    """One row a parity group: its node, class, number, member ids and parity ids."""
    return nodes.select("cid", "body").mapInArrow(_groups, GROUP)


def _states(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each member and parity block of each group, with its body where the store has it: 44 rows a group at most."""
    slots = groups.select("node", "level", "grp", F.size("members").alias("k"), F.posexplode(F.concat("members", "parity")).alias("slot", "cid"))
    return slots.join(blocks.select("cid", "body"), "cid", "left")


def repaired_slots(groups: DataFrame, blocks: DataFrame, lost: Column | None = None) -> DataFrame:
    """(node, grp, slot, cid, kind, body) of members that the store lacks, rebuilt from any k blocks of their groups and checked by
    their ids. ``lost``, a condition on slot, hides members from their own group alone: a copy that another group has stays there."""
    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["slot"])
        k, leaf = rows[0]["k"], rows[0]["level"] == 0
        kind = RAW if leaf else TREE_NODE
        gone = [r["slot"] for r in rows[:k] if r["body"] is None]
        held = [None if r["body"] is None else (1 + len(r["body"])).to_bytes(4, "little") + bytes([kind]) + r["body"] if r["slot"] < k else r["body"] for r in rows]
        out = []
        if gone and sum(h is not None for h in held) >= k:
            states = repair_group(k, held, MAX_MEMBER_VALUE if leaf else MAX_MEMBER_NODE)
            out = [(rows[i]["node"], rows[i]["grp"], i, rows[i]["cid"], kind, states[i][1:]) for i in gone]
            ids = block_ids([(kind, row[-1]) for row in out])
            out = [row for row, cid in zip(out, ids, strict=True) if row[3] == cid]
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["node", "grp", "slot", "cid", "kind", "body"])

    states = _states(groups, blocks)
    if lost is not None:
        states = states.withColumn("body", F.when(~(lost & (F.col("slot") < F.col("k"))), F.col("body")))
    return states.groupBy("node", "grp").applyInArrow(run, "node binary, grp int, slot int, cid binary, kind int, body binary")


def repair_groups(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(cid, kind, body) of members that the store lacks, each once. A block that several groups name is lost to all of them, and
    one group may rebuild it where another cannot; so there are rounds, each with what the last has rebuilt, until one rebuilds nothing."""
    members = groups.select("node", "grp", F.explode("members").alias("cid"))
    held, found, before = blocks.select("cid", "body"), None, None
    while True:
        lacking = members.join(held.select("cid"), "cid", "left_anti").persist(StorageLevel.MEMORY_AND_DISK)
        n = lacking.select("cid").distinct().count()
        if found is not None and n in (0, before):
            return found
        before = n
        fresh = repaired_slots(groups.join(lacking.select("node", "grp").distinct(), ["node", "grp"], "left_semi"), held)
        fresh = fresh.select("cid", "kind", "body").dropDuplicates(["cid"]).persist(StorageLevel.MEMORY_AND_DISK)
        found = fresh if found is None else found.unionByName(fresh)
        held = held.unionByName(fresh.select("cid", "body"))


def recoded(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(cid, kind, body) of the groups' parity, computed from their members."""
    def run(key, table):
        rows = sorted((r for r in table.to_pylist() if r["slot"] < r["k"]), key=lambda r: r["slot"])
        kind = bytes([RAW if rows[0]["level"] == 0 else TREE_NODE])
        bodies = [] if any(r["body"] is None for r in rows) else encode_group([kind + r["body"] for r in rows])
        ids = block_ids([(PARITY_KIND, b) for b in bodies]) if bodies else []
        return pa.table([pa.array(ids, pa.binary()), pa.array([PARITY_KIND] * len(ids), pa.int32()), pa.array(bodies, pa.binary())], ["cid", "kind", "body"])

    return _states(groups, blocks).groupBy("node", "grp").applyInArrow(run, "cid binary, kind int, body binary")
