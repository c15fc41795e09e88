"""Plans on Spark: queries against their SQL, builds against fixed roots, trees against dictionaries, streams."""

import pathlib

import duckdb
import pytest
from conftest import dataset

import __spark_entry__ as entry
from veriplex.operators import logical as L
from veriplex.operators import views as V
from veriplex.operators.build import build, build_local
from veriplex.plans import ORACLE_SQL, QUERIES
from veriplex.sources.blocks import BlockTable, Overlay
from veriplex.streaming.maintain import SnapshotStream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    return sorted(tuple("None" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sql, name):
    got, want = QUERIES[name](spark, SF).toPandas(), sql.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in rows], "key binary, value binary")


def test_build_is_the_same_in_any_partitions(spark):
    rows = dataset(1, 1200)
    root, blocks = build_local(rows)
    for per_part in (10_000, 150):
        tree = build(frame(spark, rows[::-1]), per_part)
        assert tree.root == root and tree.agg == (len(rows), sum(len(k) + len(v) for k, v in rows))
    assert {bytes(r.cid) for r in tree.blocks().collect()} == set(blocks)


def test_references_parity_and_checks(spark):
    rows = [(b"z/%05d" % i, bytes([i % 251]) * (900 + 37 * i)) for i in range(150)]
    tree = build(frame(spark, rows), 60)
    root, blocks = build_local(rows)
    assert tree.root == root and {bytes(r.cid) for r in tree.blocks().collect()} == set(blocks)
    assert V.violations(tree).isEmpty() and V.frauds(tree).isEmpty()
    assert V.aggregate_claimed(tree).first().entries == 150


def test_apply_refusals(spark):
    base = frame(spark, [(b"a", b"1")])
    for bad, kind in (([(b"k" * 513, b"")], "KeyTooLong"), ([(b"k", b"x" * 262145)], "ValueTooLong"), ([(b"k", b"1"), (b"k", b"2")], "NotSorted")):
        with pytest.raises(L.ApplyError, match=kind):
            L.apply(base, frame(spark, bad))
    with pytest.raises(L.RangeError):
        L.page(base, L.Range(max_entries=0))
    with pytest.raises(L.AggregateError):
        L.aggregate(base, L.Range(reverse=True))
    with pytest.raises(L.DiffError):
        L.changes(base, base, L.Range(reverse=True))


def test_block_table(spark, tmp_path):
    store = BlockTable(spark, str(tmp_path / "blocks"))
    root = store.init()
    store.init()
    assert store.read().count() == 1 and store.fetch([root, b"x" * 32]).keys() == {root}
    store.publish("main", root, 1, (0, 0))
    assert bytes(store.heads().first().root) == root
    over = Overlay({b"a": b"1"})
    over.put(b"b", b"2")
    assert dict(over) == {b"a": b"1", b"b": b"2"}


def test_stream_of_edits(spark, tmp_path):
    source = tmp_path / "edits"
    frame(spark, [(b"a", b"1"), (b"b", b"1")]).coalesce(1).write.parquet(str(source / "1"))
    frame(spark, [(b"a", None), (b"c", b"2")]).coalesce(1).write.parquet(str(source / "2"))
    snap = SnapshotStream(spark, str(tmp_path / "snap"))
    done = []
    edits = spark.readStream.schema("key binary, value binary").option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    snap.start(edits, str(tmp_path / "check"), done.append).awaitTermination()
    got = {bytes(r.key): bytes(r.value) for r in snap.read(done[-1]).collect()}
    assert got == {b"b": b"1", b"c": b"2"} and len(done) == 2
    snap.take(frame(spark, [(b"a", None), (b"c", b"2")]), done[-1])
    assert {bytes(r.key) for r in snap.read(done[-1]).collect()} == {b"b", b"c"}


def test_plans_push_down_and_avoid_python(spark):
    r = L.Range(L.Bound.including(b"o/" + (100).to_bytes(8, "big")), L.Bound.excluding(b"o/" + (200).to_bytes(8, "big")))
    from veriplex.plans.shared import orders

    plan = L.scan(orders(spark, SF, r), r).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "Exchange" not in plan and "Python" not in plan


def test_stored_trees(spark, tmp_path):
    from veriplex.operators import stored as S
    from veriplex.operators.reader import Need

    a = dict(dataset(1, 1500))
    keys = sorted(a)
    b = {k: v for i, (k, v) in enumerate(sorted(a.items())) if i not in (40, 700)} | {keys[900]: b"changed", keys[20] + b"\1": b"n" * 2000}
    (ra, xa), (rb, xb) = build_local(sorted(a.items())), build_local(sorted(b.items()))
    store = BlockTable(spark, str(tmp_path / "blocks"))
    for x in (xa, xb):
        store.append(spark.createDataFrame([(bytearray(c), k, bytearray(body)) for c, (k, body) in x.items()], "cid binary, kind int, body binary"))
    blocks = store.read()
    tree = S.open_tree(blocks, rb)
    assert tree.agg == (len(b), sum(len(k) + len(v) for k, v in b.items())) and {bytes(r.cid) for r in tree.blocks().select("cid").collect()} == set(xb)
    assert V.violations(tree).isEmpty() and S.invariants(blocks, rb).isEmpty()
    r = L.Range(L.Bound.including(keys[100]), L.Bound.excluding(keys[1200]))
    inside = {k: v for k, v in a.items() if r.holds(k)}
    got = S.aggregate_claimed(blocks, ra, r)
    assert (got.entries, got.bytes) == (len(inside), sum(len(k) + len(v) for k, v in inside.items())) and got.nodes_read <= 2 * tree.height + 1
    assert S.aggregate_claimed(blocks, ra, L.Range(L.Bound.including(b"x"), L.Bound.excluding(b"a"))).nodes_read == 0
    assert {bytes(x.key) for x in S.scan(blocks, ra, r).collect()} == set(inside)
    d = S.difference(blocks, ra, rb)
    assert {(bytes(x.key), x.change) for x in d.changes().collect()} == {(keys[40], "Removed"), (keys[700], "Removed"), (keys[900], "Changed"), (keys[20] + b"\1", "Added")}
    nodes = lambda x: {c for c, (kind, _) in x.items() if kind == 1}
    assert {bytes(x.cid) for x in d.nodes(d.new).collect()} == nodes(xb) - nodes(xa) and {bytes(x.cid) for x in d.nodes(d.old).collect()} == nodes(xa) - nodes(xb)
    assert S.difference(blocks, ra, ra).changes().isEmpty()
    gone = bytes(tree.levels[0].orderBy("key").select("cid").first().cid)
    part = blocks.where(blocks.cid != bytearray(gone))
    assert [bytes(x.cid) for x in S.frontier(part, rb).collect()] == [gone]
    with pytest.raises(Exception, match="lost block"):
        S.scan(part, rb).count()
    with pytest.raises(Need):
        S.open_tree(blocks, b"x" * 32)
    leaf = xb[gone][1]
    torn = part.unionByName(spark.createDataFrame([(bytearray(gone), 1, bytearray(leaf[:-1] + bytes([leaf[-1] ^ 1])))], "cid binary, kind int, body binary"))
    assert ("id" in {x.fault for x in S.invariants(torn, rb).collect()})
    spark.catalog.clearCache()


def test_parity_with_copies_in_several_groups(spark, tmp_path):
    # Most groups hold more copies of texts that some group loses than there is parity.
    text = lambda i: f"{i % 12 if i % 10 < 6 else i} " * 600
    spark.createDataFrame([(i, text(i)) for i in range(500)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["parity_repair"](spark, str(tmp_path)).first()
    assert got.values_in_groups == len({text(i) for i in range(500)}) and got.rebuilt and got.recoded
    spark.catalog.clearCache()


def test_repair_in_rounds(spark):
    from veriplex.operators.boundary import encode_group
    from veriplex.operators.node import PARITY_KIND, RAW, block_ids

    bodies = [bytes([i]) * (1100 + i) for i in range(40)]
    ids = block_ids([(RAW, b) for b in bodies])
    store, groups = dict(zip(ids, bodies, strict=True)), []
    for no, own in enumerate((range(21), range(14, 40))):
        parity = encode_group([bytes([RAW]) + bodies[i] for i in own])
        names = block_ids([(PARITY_KIND, p) for p in parity])
        store |= dict(zip(names, parity, strict=True))
        groups.append((bytearray([no]), 0, 0, 0, [bytearray(ids[i]) for i in own], [bytearray(x) for x in names]))
    lost = {ids[i] for i in (*range(14, 20), *range(30, 36))}  # 6 of the first group, 12 of the second: 6 are left when the first is whole
    blocks = spark.createDataFrame([(bytearray(c), bytearray(b)) for c, b in store.items() if c not in lost], "cid binary, body binary")
    got = V.repair_groups(spark.createDataFrame(groups, V.GROUP), blocks).collect()
    assert {bytes(r.cid): bytes(r.body) for r in got} == {c: store[c] for c in lost} and len(got) == len(lost)
    spark.catalog.clearCache()


def test_plans_of_a_difference_do_not_grow_with_the_height(spark, tmp_path):
    from veriplex.operators import stored as S

    a = dict(dataset(3, 1500))
    b = dict(list(sorted(a.items()))[:-1])
    (ra, xa), (rb, xb) = build_local(sorted(a.items())), build_local(sorted(b.items()))
    blocks = spark.createDataFrame([(bytearray(c), k, bytearray(body)) for c, (k, body) in (xa | xb).items()], "cid binary, kind int, body binary")
    d = S.difference(blocks, ra, rb)
    size = lambda df: df._jdf.queryExecution().analyzed().toString().count("\n")
    assert len(d.old) > 2 and size(d.changes()) < 30 and size(S.scan(blocks, ra)) < 30
    assert [x.change for x in d.changes().collect()] == ["Removed"]
    spark.catalog.clearCache()


def test_partitions_of_a_build_are_bounded(spark, monkeypatch):
    from veriplex.operators import build as T

    rows, dealt, parts = dataset(5, 600), [], T._parts
    monkeypatch.setattr(T, "_parts", lambda bounds: (dealt.append(len(bounds) + 1), parts(bounds))[1])
    assert build(frame(spark, rows), per_part=5).root == build_local(rows)[0]
    assert max(dealt) <= T.SHARES * 4


def test_leaves_of_inline_values_hash_no_group(monkeypatch):
    from veriplex.operators import boundary as B
    from veriplex.operators.node import Node, Value

    hashed, hashes = [], B.key_hashes
    monkeypatch.setattr(B, "key_hashes", lambda domain, level, keys: (hashed.append(len(keys)), hashes(domain, level, keys))[1])
    keys = [b"k%03d" % i for i in range(60)]
    assert B.groups(Node(0, keys, [Value.of(b"v")] * 60)) == [] and not hashed
    assert sum(len(own) for _, own in B.groups(Node(0, keys, [Value.of(b"v" * (2000 if i % 2 else 1)) for i in range(60)]))) == 30 and hashed == [30]


def test_packs_hold_a_repeated_block_once(spark):
    from veriplex.operators.node import block_ids
    from veriplex.operators.pack import pack_blocks, unpack

    bodies = [bytes([i]) * 50 for i in range(20)]
    rows = [(bytearray(c), 0, bytearray(b), i % 2) for i, (c, b) in enumerate(zip(block_ids([(0, b) for b in bodies]), bodies, strict=True))]
    got = unpack(pack_blocks(spark.createDataFrame(rows * 3, "cid binary, kind int, body binary, part int"), "part", 300)).collect()
    assert sorted(bytes(r.body) for r in got) == bodies


def test_pack_roundtrip_shuffles_no_body_for_the_comparison(spark):
    plan = QUERIES["pack_roundtrip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Except" not in plan and "Deduplicate [cid" not in plan and "first(body" not in plan
    spark.catalog.clearCache()


def test_a_tree_is_packed_where_its_blocks_are_made(spark, monkeypatch):
    """Each block of the leaves once, whatever tasks make it; only entries and marks are shuffled."""
    from veriplex.operators import build as T
    from veriplex.operators.node import PARITY_KIND, RAW, parse
    from veriplex.operators.pack import members, pack_tree, returned, tree_returned

    # Runs of copies, so that tasks make equal values and equal groups, and so equal parity.
    rows = [(b"k%05d" % i, (b"%d " % (i // 100 % 3 * 50 + i % 50)) * 400 if i % 7 else b"short") for i in range(1200)]
    monkeypatch.setattr(T, "LEAST", 60)
    tree = build(frame(spark, rows), per_part=60, slim=True)
    root, want = build_local(rows)
    above = {c for c, (kind, body) in want.items() if kind == 1 and parse(body).level} | {c for _, body in want.values() if body[:4] == b"PT01" and parse(body).level for c in parse(body).parity}
    assert tree.root == root and len(tree.cut[1]) >= 3
    packed = pack_tree(tree, lambda cid: cid[0] % 4, 20_000).persist()
    packs = packed.where("pack is not null").collect()
    got = [(c, k, b, r.carrier) for r in packs for k, b, c in members(bytes(r.pack))]
    assert len(got) == len({c for c, *_ in got}) and {c: (k, b) for c, k, b, _ in got} == {c: x for c, x in want.items() if c not in above}
    assert all(c[0] % 4 == g for c, _, _, g in got) and max(len(r.pack) for r in packs) <= 20_000
    listed = packed.where("pack is null")
    assert listed.count() > len(got) and {bytes(r.cid) for r in listed.select("cid").collect()} == {c for c, *_ in got}
    assert returned(packed).exceptAll(tree_returned(tree, lambda cid: cid[0] % 4, 20_000)).isEmpty()
    back = returned(packed).where("back")
    assert sorted((bytes(r.cid), r.size) for r in back.collect()) == sorted((c, len(b)) for c, _, b, _ in got)
    assert {k for _, k, _, _ in got} == {RAW, 1, PARITY_KIND}
    with pytest.raises(ValueError):
        tree.blocks()
    spark.catalog.clearCache()


def test_pack_roundtrip_on_odd_tables(spark, tmp_path):
    for name, texts in (("none", []), ("one", ["x" * 2000]), ("short", ["a", ""]), ("copies", ["y" * 5000] * 300 + ["z" * 1025] * 2)):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        got, long = QUERIES["pack_roundtrip"](spark, str(tmp_path / name)).first(), {t for t in texts if t and len(t) > 1024}
        assert (got.value_blocks, got.value_bytes, got.lost, got.extra) == (len(long), sum(map(len, long)) if long else None, 0, 0)
    spark.catalog.clearCache()
