"""Queries on the logical layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import entry_cost, is_reference, leaf_cost, signed_be64, size_class, stored_length, successor
from ..operators import logical as L
from ..operators.logical import Bound, Range
from ..sources.tables import load, table_snapshot
from .shared import A_SQL, B_SQL, C_SQL, D_SQL, dkey, documents, hexed, okey, order_edits, orders, text

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


ROW = ("o_orderkey", "o_custkey")
ROW_SQL = "'6F2F' || printf('%016X', o_orderkey) AS key_hex, o_orderkey, o_custkey"


def _scan(name: str, r: Range, where: str) -> None:
    def run(spark, sf_dir):
        return hexed(L.scan(orders(spark, sf_dir, r), r), *ROW)
    run.__name__ = name
    query(f"SELECT {ROW_SQL} FROM orders WHERE {where}")(run)


def _page(name: str, r: Range, sql: str) -> None:
    def run(spark, sf_dir):
        return hexed(L.page(orders(spark, sf_dir, r), r), "n", *ROW)
    run.__name__ = name
    query(sql)(run)


_scan("get_present", Range(Bound.including(okey(7)), Bound.including(okey(7))), "o_orderkey = 7")
_scan("get_absent", Range(Bound.including(okey(10**12)), Bound.including(okey(10**12))), "false")
_scan("range_incl_incl", Range(Bound.including(okey(100)), Bound.including(okey(300))), "o_orderkey BETWEEN 100 AND 300")
_scan("range_excl_excl", Range(Bound.excluding(okey(100)), Bound.excluding(okey(300))), "o_orderkey > 100 AND o_orderkey < 300")
_scan("range_half_open", Range(lo=Bound.including(okey(1200))), "o_orderkey >= 1200")
_scan("range_upper_only", Range(hi=Bound.excluding(okey(250))), "o_orderkey < 250")
_scan("range_inverted_empty", Range(Bound.including(okey(300)), Bound.including(okey(100))), "false")
_scan("range_single_excluded", Range(Bound.excluding(okey(100)), Bound.including(okey(100))), "false")
_scan("prefix_scan", Range.prefix(okey(512)[:9]), "o_orderkey BETWEEN 512 AND 767")
_scan("prefix_all_ff", Range.prefix(b"\xff\xff"), "false")
_scan("prefix_empty", Range.prefix(b""), "true")
_scan("prefix_too_long", Range.prefix(b"o/" + b"\xff" * 600), "false")
_page("page_forward", Range.prefix(b"o/", max_entries=25), f"SELECT row_number() OVER (ORDER BY o_orderkey) AS n, {ROW_SQL} FROM orders ORDER BY o_orderkey LIMIT 25")
_page("page_reverse_latest20", Range.prefix(b"o/", reverse=True, max_entries=20),
      f"SELECT row_number() OVER (ORDER BY o_orderkey DESC) AS n, {ROW_SQL} FROM orders ORDER BY o_orderkey DESC LIMIT 20")
_page("page_after_key", Range.prefix(b"o/", after=okey(400), max_entries=15), f"SELECT row_number() OVER (ORDER BY o_orderkey) AS n, {ROW_SQL} FROM orders WHERE o_orderkey > 400 ORDER BY o_orderkey LIMIT 15")
_page("page_reverse_after", Range.prefix(b"o/", reverse=True, after=okey(400), max_entries=15),
      f"SELECT row_number() OVER (ORDER BY o_orderkey DESC) AS n, {ROW_SQL} FROM orders WHERE o_orderkey < 400 ORDER BY o_orderkey DESC LIMIT 15")
_page("page_after_outside_bounds", Range(Bound.including(okey(500)), Bound.including(okey(900)), after=okey(20), max_entries=10),
      f"SELECT row_number() OVER (ORDER BY o_orderkey) AS n, {ROW_SQL} FROM orders WHERE o_orderkey BETWEEN 500 AND 900 ORDER BY o_orderkey LIMIT 10")


@query(f"SELECT {ROW_SQL} FROM orders WHERE o_orderkey IN (1, 7, 64, 1000, 999999999)")
def multi_get(spark, sf_dir):
    keys = [1, 7, 64, 1000, 999999999]
    span = Range(Bound.including(okey(min(keys))), Bound.including(okey(max(keys))))
    return hexed(L.get(orders(spark, sf_dir, span), *map(okey, keys)), *ROW)


_BYTES_SQL = f"""WITH {D_SQL}, f AS (SELECT *, row_number() OVER (ORDER BY doc_id{{desc}}) AS n, sum(10 + stored) OVER (ORDER BY doc_id{{desc}}) AS page_bytes FROM d {{where}})
SELECT key_hex, n, CAST(page_bytes AS BIGINT) AS page_bytes FROM f WHERE n <= {{most}} AND (n = 1 OR page_bytes <= {{bytes}})"""


@query(_BYTES_SQL.format(desc="", where="", most=1000, bytes=5000))
def page_byte_limit(spark, sf_dir):
    r = Range.prefix(b"d/", max_entries=1000, max_bytes=5000)
    return hexed(L.page(documents(spark, sf_dir, r), r), "n", "page_bytes")


@query(_BYTES_SQL.format(desc=" DESC", where="", most=40, bytes=100000))
def page_reverse_byte_limit(spark, sf_dir):
    r = Range.prefix(b"d/", reverse=True, max_entries=40, max_bytes=100000)
    return hexed(L.page(documents(spark, sf_dir, r), r), "n", "page_bytes")


@query(_BYTES_SQL.format(desc="", where="WHERE doc_id >= 5", most=1000, bytes=1))
def page_single_oversize_entry(spark, sf_dir):
    r = Range(lo=Bound.including(dkey(5)), max_entries=1000, max_bytes=1)
    return hexed(L.page(documents(spark, sf_dir, r), r), "n", "page_bytes")


@query(f"WITH {A_SQL}, {B_SQL} SELECT key_hex, row_number() OVER (ORDER BY key_hex) AS n, value AS value_text FROM b WHERE key_hex > '6F2F' || printf('%016X', 250) ORDER BY key_hex LIMIT 30")
def page_resume_newer_snapshot(spark, sf_dir):
    r = Range.prefix(b"o/", after=okey(250), max_entries=30)
    newer = L.apply(orders(spark, sf_dir).select("key", "value"), order_edits(spark, sf_dir))
    return hexed(L.page(newer, r), "n", text("value"))


@query("""WITH e(name, served, next_hex, page_end) AS (
SELECT 'limit', least(20, count(*)), '6F2F' || printf('%016X', (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 20))), 'Limit' FROM orders
UNION ALL SELECT 'range', count(*), NULL, 'EndOfRange' FROM orders WHERE o_orderkey BETWEEN 100 AND 110
UNION ALL SELECT 'tree', count(*), NULL, 'EndOfTree' FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) - 5 FROM orders)
UNION ALL SELECT 'empty', 0, NULL, 'EndOfRange')
SELECT name, CAST(served AS BIGINT) AS served, next_hex, page_end FROM e""")
def page_end_status(spark, sf_dir):
    df = orders(spark, sf_dir)
    most = bytes(df.agg(F.max("key")).first()[0])
    tail = okey(int.from_bytes(most[2:], "big") - 5)
    cases = {"limit": Range(max_entries=20), "range": Range(Bound.including(okey(100)), Bound.including(okey(110))), "tree": Range(lo=Bound.excluding(tail)),
             "empty": Range(Bound.including(okey(300)), Bound.including(okey(100)))}
    out = None
    for name, r in cases.items():
        one = L.page_status(df.select("key", "value"), r).select(F.lit(name).alias("name"), "served", F.hex("next_key").alias("next_hex"), "page_end")
        out = one if out is None else out.unionByName(one)
    return out


for _name, _how, _sql in (("seek_ge", "ge", "SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= 333"), ("seek_gt", "gt", "SELECT min(o_orderkey) FROM orders WHERE o_orderkey > 333"),
                          ("seek_le", "le", "SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= 333"), ("seek_lt", "lt", "SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 333"),
                          ("seek_first", "first", "SELECT min(o_orderkey) FROM orders"), ("seek_last", "last", "SELECT max(o_orderkey) FROM orders")):
    def _seek(spark, sf_dir, how=_how):
        at = Bound.including(okey(333))
        bounds = Range(lo=at) if how in ("ge", "gt") else Range(hi=at) if how in ("le", "lt") else Range()
        return hexed(L.seek(orders(spark, sf_dir, bounds), okey(333), how), *ROW)
    _seek.__name__ = _name
    query(f"SELECT {ROW_SQL} FROM orders WHERE o_orderkey = ({_sql})")(_seek)

_VALUE_BYTES = "2 + 8 + octet_length(encode(o_orderstatus || '|' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)))"


@query(f"SELECT count(*) AS entries, CAST(coalesce(sum({_VALUE_BYTES}), 0) AS BIGINT) AS bytes FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def agg_range_verified(spark, sf_dir):
    r = Range(Bound.including(okey(100)), Bound.excluding(okey(1100)))
    return L.aggregate(orders(spark, sf_dir, r), r)


@query("SELECT CAST(0 AS BIGINT) AS entries, CAST(0 AS BIGINT) AS bytes")
def agg_empty(spark, sf_dir):
    r = Range(Bound.including(okey(9)), Bound.including(okey(3)))
    return L.aggregate(orders(spark, sf_dir, r), r)


@query("""SELECT kind, entries FROM (SELECT 'c/' AS kind, count(*) AS entries FROM customer UNION ALL SELECT 'o/', count(*) FROM orders UNION ALL SELECT 's/', count(*) FROM supplier
UNION ALL SELECT 'l/', count(*) FROM lineitem UNION ALL SELECT 'v/', count(*) FROM events)""")
def agg_prefix_by_type(spark, sf_dir):
    rows = None
    for name in ("customer", "orders", "supplier", "lineitem", "events"):
        one = table_snapshot(spark, sf_dir, name).select("key", "value")
        rows = one if rows is None else rows.unionByName(one)
    return L.aggregate_by(rows, F.substring("key", 1, 2).cast("string")).select("kind", "entries")


@query(f"SELECT o_orderstatus AS kind, count(*) AS entries, CAST(sum({_VALUE_BYTES}) AS BIGINT) AS bytes FROM orders GROUP BY o_orderstatus")
def agg_by_status(spark, sf_dir):
    return L.aggregate_by(orders(spark, sf_dir), F.col("o_orderstatus"))


def _versions(spark, sf_dir):
    a = orders(spark, sf_dir).select("key", "value")
    return a, L.apply(a, order_edits(spark, sf_dir))


def _diff(name: str, keep: str, r: Range = Range(), where: str = "true") -> None:
    def run(spark, sf_dir):
        a, b = _versions(spark, sf_dir)
        return hexed(L.changes(a, b, r).where(keep), "change", text("old"), text("new"))
    run.__name__ = name
    query(f"WITH {A_SQL}, {B_SQL}, {C_SQL} SELECT * FROM c WHERE {keep} AND {where}")(run)


_diff("diff_added", "change = 'Added'")
_diff("diff_removed", "change = 'Removed'")
_diff("diff_changed", "change = 'Changed'")
_diff("diff_all", "true")
_diff("diff_ranged", "true", Range(Bound.including(okey(200)), Bound.excluding(okey(1200))), "key_hex >= '6F2F' || printf('%016X', 200) AND key_hex < '6F2F' || printf('%016X', 1200)")


@query("SELECT '' AS key_hex, '' AS change WHERE false")
def diff_equal_roots(spark, sf_dir):
    a = orders(spark, sf_dir).select("key", "value")
    return hexed(L.changes(a, a), "change")


_COST_SQL = "octet_length(encode(coalesce(old_text, ''))) + octet_length(encode(coalesce(new_text, ''))) + len(key_hex) // 2"


@query(f"""WITH {A_SQL}, {B_SQL}, {C_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY key_hex) AS n, sum({_COST_SQL}) OVER (ORDER BY key_hex) AS run FROM c)
SELECT key_hex, n, change, CAST(run AS BIGINT) AS page_bytes FROM p WHERE n <= 12 AND run - ({_COST_SQL}) < 200""")
def diff_paged(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    return hexed(L.change_page(a, b, Range(max_entries=12, max_bytes=200)), "n", "change", "page_bytes")


@query(f"""WITH {A_SQL}, {B_SQL}, {C_SQL} SELECT key_hex, row_number() OVER (ORDER BY key_hex) AS n, change FROM c WHERE key_hex > '6F2F' || printf('%016X', 340) ORDER BY key_hex LIMIT 5""")
def diff_resumed(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    resume = L.Resume(b"a", b"b", okey(340))
    return hexed(L.change_page(a, b, Range(max_entries=5, max_bytes=0), (b"a", b"b"), resume), "n", "change")


@query(f"WITH {A_SQL}, {B_SQL} SELECT key_hex, value AS value_text FROM b")
def apply_put_delete(spark, sf_dir):
    return hexed(_versions(spark, sf_dir)[1], text("value"))


@query("SELECT '' AS key_hex WHERE false")
def apply_noop(spark, sf_dir):
    a = orders(spark, sf_dir).select("key", "value")
    absent = a.select(F.concat("key", F.lit(b"?")).alias("key"), F.lit(None).cast("binary").alias("value"))
    return hexed(L.effective(a, a.union(absent)))


@query(f"WITH {A_SQL}, {B_SQL} SELECT key_hex, row_number() OVER (ORDER BY key_hex DESC) AS n, value AS value_text FROM b ORDER BY key_hex DESC LIMIT 20")
def apply_then_scan(spark, sf_dir):
    r = Range.prefix(b"o/", reverse=True, max_entries=20)
    return hexed(L.page(_versions(spark, sf_dir)[1], r), "n", text("value"))


@query(f"WITH {A_SQL}, {B_SQL} SELECT count(*) AS edits FROM (SELECT key_hex FROM a WHERE n % 1000 = 500 UNION ALL SELECT key_hex FROM a WHERE n % 333 = 7 AND n % 1000 <> 500 UNION ALL SELECT key_hex FROM a WHERE n % 1000 = 250)")
def apply_effective_edits(spark, sf_dir):
    a = orders(spark, sf_dir).select("key", "value")
    return L.effective(a, order_edits(spark, sf_dir)).agg(F.count("*").alias("edits"))


@query(f"WITH {D_SQL} SELECT key_hex, size > 1024 AS is_ref, CAST(size AS BIGINT) AS size, CAST(stored AS BIGINT) AS stored FROM d")
def value_encoding(spark, sf_dir):
    v = F.col("value")
    return hexed(documents(spark, sf_dir), is_reference(v).alias("is_ref"), F.octet_length(v).cast("long").alias("size"), stored_length(v).cast("long").alias("stored"))


@query(f"WITH {D_SQL} SELECT CASE WHEN size <= 1024 THEN -1 WHEN size <= 4096 THEN 0 WHEN size <= 16384 THEN 1 WHEN size <= 65536 THEN 2 ELSE 3 END AS class, count(*) AS entries FROM d GROUP BY 1")
def size_classes(spark, sf_dir):
    size = F.octet_length("value")
    return documents(spark, sf_dir).groupBy(F.coalesce(size_class(size), F.lit(-1)).alias("class")).agg(F.count("*").alias("entries"))


@query(f"WITH {D_SQL} SELECT key_hex, CAST(10 + stored AS BIGINT) AS page_cost, CAST(13 + 10 + stored AS BIGINT) AS leaf_cost FROM d")
def entry_costs(spark, sf_dir):
    k, v = F.col("key"), F.col("value")
    return hexed(documents(spark, sf_dir), entry_cost(k, v).cast("long").alias("page_cost"), leaf_cost(k, v).cast("long").alias("leaf_cost"))


@query(f"WITH {D_SQL} SELECT count(*) AS entries, CAST(sum(10 + size) AS BIGINT) AS bytes FROM d")
def logical_bytes(spark, sf_dir):
    return L.aggregate(documents(spark, sf_dir))


@query("SELECT '' AS key_hex WHERE false")
def order_check(spark, sf_dir):
    return hexed(L.out_of_order(table_snapshot(spark, sf_dir, "lineitem").select("key")))


@query("SELECT count(*) AS entries FROM lineitem")
def repeated_keys_numbered(spark, sf_dir):
    return table_snapshot(spark, sf_dir, "lineitem").select("key").distinct().agg(F.count("*").alias("entries"))


@query("SELECT x AS n, row_number() OVER (ORDER BY x) AS place FROM (VALUES (-9223372036854775807), (-1), (0), (1), (9223372036854775807), (-4242)) t(x)")
def signed_key_order(spark, sf_dir):
    from pyspark.sql import Window

    df = spark.createDataFrame([(x,) for x in (-9223372036854775807, -1, 0, 1, 9223372036854775807, -4242)], "n long")
    return df.withColumn("place", F.row_number().over(Window.orderBy(signed_be64(F.col("n"))))).select("n", F.col("place").cast("long").alias("place"))


@query("""WITH c(h, before, after) AS (SELECT CAST(o_orderkey * 2654435761 % 4294967296 AS HUGEINT), CAST(28 + o_orderkey % 9000 AS HUGEINT), CAST(28 + o_orderkey % 9000 + 40 + o_custkey % 900 AS HUGEINT) FROM orders)
SELECT CAST(h AS BIGINT) AS h, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after,
after >= 1024 AND h * 374809600000000 < (after * after * after * after - before * before * before * before) * 4294967296 AS splits FROM c""")
def splits_decimal(spark, sf_dir):
    """The boundary inequality in exact decimals, without Python."""
    n, big = F.col("o_orderkey"), lambda c: c.cast("decimal(10,0)")
    df = load(spark, sf_dir, "orders").select((n * 2654435761 % 4294967296).alias("h"), (28 + n % 9000).alias("before"), (28 + n % 9000 + 40 + F.col("o_custkey") % 900).alias("after"))
    fourth = lambda c: big(F.col(c)) * big(F.col(c)) * (big(F.col(c)) * big(F.col(c))).cast("decimal(18,0)")
    left = F.col("h").cast("decimal(11,0)") * F.lit(4400**4).cast("decimal(15,0)")
    right = (fourth("after").cast("decimal(26,0)") - fourth("before").cast("decimal(26,0)")).cast("decimal(27,0)") * F.lit(2**32).cast("decimal(10,0)")
    return df.select("h", "before", "after", ((F.col("after") >= 1024) & (left < right)).alias("splits"))


@query("""SELECT * FROM (VALUES ('61', '62'), ('61FF', '62'), ('FFFF', NULL), ('', NULL), ('0100', '0101'), ('61FFFF00', '61FFFF01')) t(prefix_hex, successor_hex)""")
def successor_cases(spark, sf_dir):
    rows = [(p.hex().upper(), s.hex().upper() if (s := successor(p)) is not None else None) for p in (b"a", b"a\xff", b"\xff\xff", b"", b"\x01\x00", b"a\xff\xff\x00")]
    return spark.createDataFrame(rows, "prefix_hex string, successor_hex string")
