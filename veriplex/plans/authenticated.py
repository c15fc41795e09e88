"""Queries on the tree: blocks, checks, recorded sums, structural differences, proofs, parity, packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.gf256 import MUL
from ..operators import logical as L
from ..operators import proof as P
from ..operators import stored as S
from ..operators import views as V
from ..operators.apply import apply_cold
from ..operators.boundary import group_sizes
from ..operators.cursor import Cursor
from ..operators.diff import diff_cold
from ..operators.build import Tree, build
from ..operators.logical import Bound, Range
from ..operators.node import PARITY_KIND
from ..operators.pack import pack_blocks, tree_returned, unpack
from ..operators.reader import Reader, converge, range_page
from ..sources.blocks import missing, overlay
from .logical import _VALUE_BYTES
from .shared import A_SQL, B_SQL, C_SQL, D_SQL, documents, okey, order_edits, orders

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


def order_tree(spark, sf_dir) -> Tree:
    return build(orders(spark, sf_dir).select("key", "value"))


def document_tree(spark, sf_dir) -> Tree:
    return build(documents(spark, sf_dir).select("key", "value"))


def fetcher(blocks):
    """Fetches named blocks from a table: what a cold reader asks for, 64 at a time."""
    blocks = blocks.select("cid", "body").persist()

    def fetch(cids):
        return {bytes(r.cid): bytes(r.body) for r in blocks.where(F.col("cid").isin([bytearray(c) for c in cids])).collect()}
    return fetch


@query()
def build_nodes(spark, sf_dir):
    n = order_tree(spark, sf_dir).nodes()
    return n.select("level", F.hex("key").alias("min_key"), F.hex("cid").alias("cid"), "entries", "bytes", F.octet_length("body").alias("size"))


@query()
def tree_shape(spark, sf_dir):
    return order_tree(spark, sf_dir).nodes().groupBy("level").agg(F.count("*").alias("nodes"), F.sum("entries").alias("entries"), F.max(F.octet_length("body")).alias("largest"))


@query("SELECT count(*) AS entries, CAST(sum(" + _VALUE_BYTES + ") AS BIGINT) AS bytes, true AS same_root FROM orders")
def root_id(spark, sf_dir):
    """The root of the table, and of the same rows in other partitions and another order: equal."""
    df = orders(spark, sf_dir).select("key", "value")
    a, b = build(df), build(df.repartition(7).sortWithinPartitions(F.col("key").desc()), per_part=1000)
    return spark.createDataFrame([(*a.agg, a.root == b.root)], "entries long, bytes long, same_root boolean")


@query("SELECT '6F2F' || printf('%016X', o_orderkey) AS key_hex, o_orderstatus || '|' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS value_text FROM orders")
def leaf_entries(spark, sf_dir):
    return V.leaf_rows(order_tree(spark, sf_dir).levels[0]).select(F.hex("key").alias("key_hex"), F.col("stored").cast("string").alias("value_text"))


@query(f"WITH {D_SQL} SELECT key_hex, size > 1024 AS is_ref, CAST(size AS INTEGER) AS length FROM d")
def leaf_references(spark, sf_dir):
    return V.leaf_rows(document_tree(spark, sf_dir).levels[0]).select(F.hex("key").alias("key_hex"), "is_ref", "length")


@query(f"WITH {D_SQL} SELECT count(*) AS n FROM (SELECT DISTINCT text FROM d WHERE size > 1024)")
def value_blocks(spark, sf_dir):
    return document_tree(spark, sf_dir).blocks().where("kind = 0").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS entries, CAST(coalesce(sum({_VALUE_BYTES}), 0) AS BIGINT) AS bytes FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def agg_range_claimed(spark, sf_dir):
    return V.aggregate_claimed(order_tree(spark, sf_dir), Range(Bound.including(okey(100)), Bound.excluding(okey(1100))))


@query(f"SELECT count(*) AS entries, CAST(coalesce(sum({_VALUE_BYTES}), 0) AS BIGINT) AS bytes FROM orders")
def agg_all_claimed(spark, sf_dir):
    return V.aggregate_claimed(order_tree(spark, sf_dir))


#: Keys by which faults are planted: their number modulo 1000, and the fault. The last leaf has no bound to overlap.
_PLANTED = {7: "entries", 107: "bytes", 207: "first key", 307: "level", 407: "overlap"}
_PLANTED_SQL = "SELECT '6F2F' || printf('%016X', o_orderkey) AS key_hex, fault FROM orders JOIN (VALUES " + ", ".join(f"({n}, '{f}')" for n, f in _PLANTED.items()) + """) t(rest, fault) ON o_orderkey % 1000 = rest
WHERE fault <> 'overlap' OR o_orderkey + 5000 < (SELECT max(o_orderkey) FROM orders)"""


def _planted(spark, sf_dir, tree):
    """(child, fault, key): the leaf of each planted key."""
    rows = V.leaf_rows(tree.levels[0]).select(F.col("leaf").alias("child"), "key", F.conv(F.hex(F.substring("key", 3, 8)), 16, 10).cast("long").alias("n"))
    kinds = spark.createDataFrame(list(_PLANTED.items()), "rest long, fault string")
    last = int.from_bytes(bytes(rows.agg(F.max("key")).first()[0])[2:], "big")
    return rows.join(F.broadcast(kinds), F.col("n") % 1000 == F.col("rest")).where((F.col("fault") != "overlap") | (F.col("n") + 5000 < last)).select("child", "fault", "key")


@query(_PLANTED_SQL)
def held_checks(spark, sf_dir):
    """Edges and headers with planted faults: each is found, by its key, and nothing else (which would have no key)."""
    tree = order_tree(spark, sf_dir)
    planted = _planted(spark, sf_dir, tree).persist()
    faults = planted.groupBy(F.col("child").alias("bad")).agg(F.collect_set("fault").alias("faults"))
    has = lambda f: F.coalesce(F.array_contains("faults", f), F.lit(False))
    e = V.spanned(tree).join(faults, F.col("child") == F.col("bad"), "left")
    bound = e.select(F.col("child").alias("of"), "upper", has("overlap").alias("over"))
    e = e.withColumns({"entries": F.col("entries") + has("entries").cast("int"), "bytes": F.col("bytes") + has("bytes").cast("int"), "level": F.col("level") + has("level").cast("int"),
                       "min_key": F.when(has("first key"), F.concat("min_key", F.lit(b"!"))).otherwise(F.col("min_key"))}).drop("bad", "faults")
    h = V.headers(tree.nodes()).join(bound, F.col("cid") == F.col("of"), "left").withColumn("max_key", F.when(F.coalesce("over", F.lit(False)), F.col("upper")).otherwise(F.col("max_key"))).drop("of", "upper", "over")
    found = V.contradictions(e, h).join(planted, ["child", "fault"], "left")
    return found.select(F.hex("key").alias("key_hex"), "fault")


@query("SELECT '6F2F' || printf('%016X', o_orderkey) AS key_hex FROM orders WHERE o_orderkey % 1000 = 7")
def fraud_bulk(spark, sf_dir):
    """Branches that say one entry too many of the leaves of planted keys: the two blocks alone prove each, and no honest pair."""
    tree = order_tree(spark, sf_dir)
    planted = _planted(spark, sf_dir, tree).where("fault = 'entries'").persist()
    liars = V.lying(tree, planted.select(F.col("child").alias("cid")).distinct())
    found = V.fraudulent(tree.nodes().select("cid", "body").unionByName(liars)).select("child").distinct()
    return found.join(planted, "child", "left").select(F.hex("key").alias("key_hex"))


@query(f"WITH {D_SQL} SELECT count(*) AS entries, CAST(sum(10 + size) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS bad FROM d")
def boundary_checks(spark, sf_dir):
    """What stands in leaves that parse and are cut where the rules say, and how many nodes of any level do not."""
    bad = F.col("error").isNotNull() | F.col("boundary").isNotNull()
    own = lambda c: F.sum(F.when(~bad & (F.col("level") == 0), F.col(c)).otherwise(0)).alias(c)
    return V.headers(document_tree(spark, sf_dir).nodes()).agg(own("entries"), own("bytes"), F.sum(bad.cast("long")).alias("bad"))


@query(f"SELECT count(*) AS least_entries, count(*) AS most_entries, CAST(sum({_VALUE_BYTES}) AS BIGINT) AS least_bytes, CAST(sum({_VALUE_BYTES}) AS BIGINT) AS most_bytes, 1 AS roots FROM orders")
def level_sums(spark, sf_dir):
    """Every level of the tree sums to the whole table, and the top level is one node."""
    levels = order_tree(spark, sf_dir).nodes().groupBy("level").agg(F.sum("entries").alias("e"), F.sum("bytes").alias("b"), F.count("*").cast("int").alias("n"))
    return levels.agg(F.min("e").alias("least_entries"), F.max("e").alias("most_entries"), F.min("b").alias("least_bytes"), F.max("b").alias("most_bytes"), F.min("n").alias("roots"))


@query(f"SELECT count(*) AS entries, CAST(coalesce(sum({_VALUE_BYTES}), 0) AS BIGINT) AS bytes FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def agg_range_checked(spark, sf_dir):
    """Counted over leaves whose blocks are hashed, parsed and checked."""
    return V.aggregate_verified(order_tree(spark, sf_dir), Range(Bound.including(okey(100)), Bound.excluding(okey(1100))))


@query(f"WITH {D_SQL} SELECT key_hex, md5(text) AS digest FROM d WHERE size > 1024")
def deref_values(spark, sf_dir):
    """References of the leaves, joined with the value blocks that they name."""
    tree = document_tree(spark, sf_dir)
    got = V.dereferenced(V.leaf_rows(tree.levels[0]), tree.blocks())
    return got.select(F.hex("key").alias("key_hex"), F.md5("value").alias("digest"))


def _trees(spark, sf_dir):
    a = orders(spark, sf_dir).select("key", "value")
    edits = order_edits(spark, sf_dir)
    return a, edits, build(a), build(L.apply(a, edits))


@query(f"WITH {A_SQL}, {B_SQL}, {C_SQL} SELECT * FROM c")
def diff_structural(spark, sf_dir):
    _, _, a, b = _trees(spark, sf_dir)
    return V.structural_changes(a, b).select(F.hex("key").alias("key_hex"), "change", F.col("old.stored").cast("string").alias("old_text"), F.col("new.stored").cast("string").alias("new_text"))


@query(f"WITH {A_SQL}, {B_SQL} SELECT count(*) AS entries, CAST(sum(octet_length(encode(value)) + len(key_hex) // 2) AS BIGINT) AS bytes, true AS same_root, true AS complete, true AS disjoint FROM b")
def apply_tree(spark, sf_dir):
    """An applied batch against a rebuild: the same root; old blocks and new ones are all that the tree needs; none is emitted twice."""
    entries, edits, a, b = _trees(spark, sf_dir)
    after, fresh, _ = V.apply_tree(a, entries, edits)
    lacks = b.blocks().select("cid").join(overlay(fresh.select("cid", "kind", "body"), a.blocks()).select("cid"), "cid", "left_anti")
    twice = fresh.join(a.blocks().select("cid"), "cid", "left_semi")
    return spark.createDataFrame([(*after.agg, after.root == b.root, lacks.isEmpty(), twice.isEmpty())], "entries long, bytes long, same_root boolean, complete boolean, disjoint boolean")


@query("SELECT count(*) + 1 - count(*) FILTER (o_orderkey = 64) + 1 - max(CAST(o_orderkey = 7 AS INTEGER)) AS entries, true AS same_root, true AS reads_part FROM orders")
def apply_incremental(spark, sf_dir):
    """Three edits applied from a root alone, blocks fetched as they are named: the root of a rebuild, and few blocks read."""
    entries, edits = orders(spark, sf_dir).select("key", "value"), [(okey(7), b"changed"), (okey(64), None), (okey(1000) + b"x", b"new")]
    tree, asked = order_tree(spark, sf_dir), set()
    fetch = fetcher(tree.blocks())

    def counted(need):
        asked.update(need)
        return fetch(need)

    got, _ = apply_cold(counted, tree.root, edits)
    after = build(L.apply(entries, spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in edits], "key binary, value binary")))
    return spark.createDataFrame([(after.agg[0], got.root == after.root, len(asked) < tree.blocks().count())], "entries long, same_root boolean, reads_part boolean")


@query()
def new_blocks(spark, sf_dir):
    _, _, a, b = _trees(spark, sf_dir)
    return V.new_nodes(a, b).select(F.hex("cid").alias("cid"), "level", "entries")


@query()
def replaced_blocks(spark, sf_dir):
    _, _, a, b = _trees(spark, sf_dir)
    return V.new_nodes(b, a).select(F.hex("cid").alias("cid"), "level", "entries")


@query()
def frontier(spark, sf_dir):
    """The leaves that a whole scan lacks when a store holds branches only, in scan order, 64 at most."""
    tree = order_tree(spark, sf_dir)
    held = tree.nodes().where("level > 0")
    wanted = V.spanned(tree).where("level = 1").select(F.col("child").alias("cid"), F.col("min_key").alias("place"))
    return missing(wanted, held).select(F.hex("cid").alias("cid"), F.hex("place").alias("place"))


@query("SELECT '6F2F' || printf('%016X', o_orderkey) AS key_hex, row_number() OVER (ORDER BY o_orderkey DESC) AS n FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def cold_store_scan(spark, sf_dir):
    """A page read from a root alone: each round fetches the blocks that the last one named."""
    tree = order_tree(spark, sf_dir)
    r = Range.prefix(b"o/", reverse=True, max_entries=20)
    page, _ = converge(lambda held: range_page(held, tree.root, r), fetcher(tree.blocks()), {})
    return spark.createDataFrame([(k.hex().upper(), i + 1) for i, (k, _) in enumerate(page.entries)], "key_hex string, n long")


_ASKED = (1, 7, 64, 1000, 1200, 10**12)


def _proofs(spark, sf_dir):
    tree = order_tree(spark, sf_dir)
    fetch, held, out = fetcher(tree.blocks()), {}, []
    for n in _ASKED:
        converge(lambda blocks, n=n: Reader(blocks, tree.root).get(okey(n)), fetch, held)
        out.append((n, P.prove(held, tree.root, okey(n)).encode()))
    return tree, out


@query()
def proof_point(spark, sf_dir):
    tree, proofs = _proofs(spark, sf_dir)
    return spark.createDataFrame([(n, len(p), bytearray(p)) for n, p in proofs], "n long, size int, proof binary").select("n", "size", F.sha2("proof", 256).alias("digest"))


@query("""SELECT k.n, CASE WHEN o.o_orderkey IS NULL THEN 'Absent' ELSE 'Present' END AS answer, o_orderstatus || '|' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS value_text
FROM (VALUES (1), (7), (64), (1000), (1200), (1000000000000)) k(n) LEFT JOIN orders o ON o.o_orderkey = k.n""")
def verify_proofs(spark, sf_dir):
    """Proofs checked in bulk by tasks that hold nothing but them and the root."""
    import pyarrow as pa

    tree, proofs = _proofs(spark, sf_dir)
    root = tree.root

    def run(batches):
        for batch in batches:
            got = [P.verify_bytes(root, okey(n), p) for n, p in zip(batch.column("n").to_pylist(), batch.column("proof").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("n"), pa.array([a for a, _, _ in got]), pa.array([v.decode() if v is not None else None for _, _, v in got], pa.string())], ["n", "answer", "value_text"])

    return spark.createDataFrame([(n, bytearray(p)) for n, p in proofs], "n long, proof binary").mapInArrow(run, "n long, answer string, value_text string")


@query("SELECT '6F2F' || printf('%016X', o_orderkey) AS key_hex FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 50")
def proof_range(spark, sf_dir):
    """A proven page: complete from its start to its last key, by the proof and the root alone."""
    tree = order_tree(spark, sf_dir)
    r, held = Range(lo=Bound.including(okey(100)), max_entries=50), {}
    converge(lambda blocks: range_page(blocks, tree.root, r), fetcher(tree.blocks()), held)
    page = P.verify_range_bytes(tree.root, r, P.prove_range(held, tree.root, r).encode())
    return spark.createDataFrame([(k.hex().upper(),) for k, _ in page.entries], "key_hex string")


@query(f"SELECT count(*) AS entries, CAST(coalesce(sum({_VALUE_BYTES}), 0) AS BIGINT) AS bytes FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def proof_aggregate(spark, sf_dir):
    from ..operators.reader import aggregate_claimed

    tree = order_tree(spark, sf_dir)
    r, held = Range(Bound.including(okey(100)), Bound.excluding(okey(1100))), {}
    converge(lambda blocks: aggregate_claimed(blocks, tree.root, r), fetcher(tree.blocks()), held)
    return spark.createDataFrame([P.verify_aggregate(tree.root, r, P.prove_aggregate(held, tree.root, r))], "entries long, bytes long")


@query(f"WITH {D_SQL} SELECT count(DISTINCT text) AS values_in_groups, true AS rebuilt, true AS recoded FROM d WHERE size > 1024")
def parity_repair(spark, sf_dir):
    """Every fifth member of every group is lost to it and rebuilt; parity computed again from the members is the parity listed."""
    tree = document_tree(spark, sf_dir)
    blocks, groups = tree.blocks().persist(), V.parity_groups(tree.nodes()).persist()
    fifth, digest = F.col("slot") % 5 == 3, F.sha2("body", 256).alias("digest")
    lost = groups.select("node", "grp", F.posexplode("members").alias("slot", "cid")).where(fifth).join(blocks, "cid").select("node", "grp", "slot", "cid", digest)
    bad = lost.exceptAll(V.repaired_slots(groups, blocks, fifth).select("node", "grp", "slot", "cid", digest))
    parity = V.recoded(groups, blocks).select("cid").distinct()
    odd = blocks.where(F.col("kind") == PARITY_KIND).select("cid").exceptAll(parity)
    values = groups.where("level = 0").select(F.explode("members").alias("cid")).distinct().count()
    return spark.createDataFrame([(values, bad.isEmpty(), odd.isEmpty())], "values_in_groups long, rebuilt boolean, recoded boolean")


@query(f"WITH {D_SQL}, v AS (SELECT DISTINCT text, size FROM d WHERE size > 1024) SELECT count(*) AS value_blocks, CAST(sum(size) AS BIGINT) AS value_bytes, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS extra FROM v")
def pack_roundtrip(spark, sf_dir):
    """Blocks packed by carriers and unpacked: the values that come back, and blocks lost or added. They are compared by digests of their bodies."""
    tree = build(documents(spark, sf_dir).select("key", "value"), slim=True)
    own = None if tree.entries is None else tree_returned(tree, lambda cid: cid[0], 64 * 1024)
    # What stands above the leaves is little, and is shuffled to its carriers; so is the one node of an empty tree.
    if levels := tree.levels if own is None else tree.levels[1:]:
        above = Tree(tree.root, tree.height, tree.agg, levels).blocks(once=False)
        got = unpack(pack_blocks(above.withColumn("carrier", F.conv(F.substring(F.hex("cid"), 1, 2), 16, 10).cast("int")), "carrier", 64 * 1024))
        for df, back in ((above, False), (got, True)):
            brief = df.select("cid", F.col("kind").cast("int"), F.octet_length("body").cast("long").alias("size"), F.unhex(F.sha2("body", 256)).alias("digest"), F.lit(back).alias("back"))
            own = brief if own is None else own.unionByName(brief)
    own = own.groupBy("cid", "kind", "size", "digest").agg(F.max((~F.col("back")).cast("long")).alias("there"), F.sum(F.col("back").cast("long")).alias("back")).withColumn("n", F.expr("there - back"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    value = F.when(F.col("kind") == 0, F.col("back")).otherwise(0)
    return own.agg(total(value).alias("value_blocks"), F.sum(F.when(F.col("kind") == 0, F.col("back") * F.col("size"))).cast("long").alias("value_bytes"),
                   total(F.greatest("n", F.lit(0))).alias("lost"), total(F.greatest(-F.col("n"), F.lit(0))).alias("extra"))


@query(f"SELECT count(*) AS entries, CAST(coalesce(sum({_VALUE_BYTES}), 0) AS BIGINT) AS bytes, true AS within_bound FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def stored_agg_claimed(spark, sf_dir):
    """A range's recorded sums from the blocks and the root alone, reading two paths."""
    tree = order_tree(spark, sf_dir)
    got = S.aggregate_claimed(tree.blocks(), tree.root, Range(Bound.including(okey(100)), Bound.excluding(okey(1100))))
    return spark.createDataFrame([(got.entries, got.bytes, got.nodes_read <= 2 * tree.height + 1)], "entries long, bytes long, within_bound boolean")


@query("SELECT '6F2F' || printf('%016X', o_orderkey) AS key_hex, o_orderstatus || '|' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS value_text FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def stored_scan(spark, sf_dir):
    """A range's entries from the blocks and the root: only nodes that meet the range are looked up."""
    tree = order_tree(spark, sf_dir)
    rows = S.scan(tree.blocks(), tree.root, Range(Bound.including(okey(100)), Bound.excluding(okey(1100))))
    return rows.select(F.hex("key").alias("key_hex"), F.col("stored").cast("string").alias("value_text"))


@query(f"WITH {D_SQL} SELECT key_hex, md5(text) AS digest FROM d")
def stored_reopened(spark, sf_dir):
    """A stored tree opened by its root: every entry, values read through their references."""
    built = document_tree(spark, sf_dir)
    tree = S.open_tree(built.blocks(), built.root)
    rows = V.leaf_rows(tree.levels[0])
    whole = rows.where("not is_ref").select("key", F.col("stored").alias("value")).unionByName(V.dereferenced(rows, tree.blocks()))
    return whole.select(F.hex("key").alias("key_hex"), F.md5("value").alias("digest"))


@query(f"WITH {A_SQL}, {B_SQL}, {C_SQL} SELECT * FROM c")
def stored_diff(spark, sf_dir):
    """Changes between two roots of one store, from the roots down: shared subtrees are never read."""
    _, _, a, b = _trees(spark, sf_dir)
    # One tree's blocks and the other's new ones, as a store has them: a table, not the plan of two builds.
    found = S.difference(S.kept(overlay(b.blocks(), a.blocks())), a.root, b.root).changes()
    return found.select(F.hex("key").alias("key_hex"), "change", F.col("old.stored").cast("string").alias("old_text"), F.col("new.stored").cast("string").alias("new_text"))


@query(f"WITH {A_SQL}, {B_SQL}, {C_SQL} SELECT * FROM c WHERE key_hex < '6F2F' || printf('%016X', 2000)")
def diff_cold_paged(spark, sf_dir):
    """The changes of a range from two roots alone, by pages of 50, each round fetching what the last page named."""
    _, _, a, b = _trees(spark, sf_dir)
    found, _ = diff_cold(fetcher(overlay(b.blocks(), a.blocks())), a.root, b.root, Range(hi=Bound.excluding(okey(2000)), max_entries=50))
    text = lambda v: v.stored.decode() if v is not None else None
    rows = [(k.hex().upper(), "Added" if old is None else "Removed" if new is None else "Changed", text(old), text(new)) for k, old, new in found]
    return spark.createDataFrame(rows, "key_hex string, change string, old_text string, new_text string")


@query("""SELECT '6F2F' || printf('%016X', o_orderkey) AS key_hex, n FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderkey >= 1000) WHERE n < 300
UNION ALL SELECT '6F2F' || printf('%016X', o_orderkey), n FROM (SELECT o_orderkey, -row_number() OVER (ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderkey < 1000) WHERE n >= -300""")
def cursor_steps(spark, sf_dir):
    """A cursor's 300 steps forward from a key, and 300 back."""
    tree = order_tree(spark, sf_dir)
    fetch, held = fetcher(tree.blocks()), {}

    def walk(blocks):
        out = []
        for step in ("next", "prev"):
            at = Cursor.seek(Reader(blocks, tree.root), okey(1000))
            n = 0
            while n < 300 and (step == "next" or at.prev()):
                now = at.peek()
                if now is None:
                    break
                out.append((now[0].hex().upper(), n if step == "next" else -n - 1))
                n += 1
                if step == "next":
                    at.next()
        return out

    rows, _ = converge(walk, fetch, held)
    return spark.createDataFrame(rows, "key_hex string, n long")


@query(f"WITH {D_SQL} SELECT count(*) AS entries, CAST(0 AS BIGINT) AS faults, count(DISTINCT CASE WHEN size > 1024 THEN text END) AS lost_values FROM d")
def invariant_walk(spark, sf_dir):
    """A sound stored tree breaks no rule; without its value blocks each of them is named."""
    tree = document_tree(spark, sf_dir)
    blocks = tree.blocks().persist()
    faults = S.invariants(blocks, tree.root).count()
    lost = S.invariants(blocks.where("kind <> 0"), tree.root).where("fault = 'lost'").count()
    return spark.createDataFrame([(tree.agg[0], faults, lost)], "entries long, faults long, lost_values long")


@query("""WITH RECURSIVE p(i, x) AS (SELECT 0, 1 UNION ALL SELECT i + 1, CASE WHEN x >= 128 THEN xor(x * 2, 285) ELSE x * 2 END FROM p WHERE i < 254)
SELECT a.x AS a, b.x AS b, c.x AS product FROM p a JOIN p b ON true JOIN p c ON c.i = (a.i + b.i) % 255
UNION ALL SELECT 0, x, 0 FROM p UNION ALL SELECT x, 0, 0 FROM p UNION ALL SELECT 0, 0, 0""")
def gf_mul_table(spark, sf_dir):
    """All 65,536 products of the field, zero's included."""
    return spark.createDataFrame([(a, b, int(MUL[a, b])) for a in range(256) for b in range(256)], "a int, b int, product int")


@query()
def parity_group_sizes(spark, sf_dir):
    rows = [(n, i, s) for n in (1, 20, 21, 36, 37, 57, 73, 200) for i, s in enumerate(group_sizes([(j * 2654435761) % 2**32 for j in range(n)]))]
    return spark.createDataFrame(rows, "members int, grp int, size int")
