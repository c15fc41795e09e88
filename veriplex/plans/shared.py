"""What the queries share: snapshots of tables, two versions of one, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import be64, prefixed
from ..operators.logical import Bound, Range
from ..sources.tables import load, scan_table, table_snapshot


def okey(n: int) -> bytes:
    return b"o/" + n.to_bytes(8, "big")


def dkey(n: int) -> bytes:
    return b"d/" + n.to_bytes(8, "big")


def order_value():
    return F.concat_ws("|", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").cast("string")).cast("binary")


def orders(spark: SparkSession, sf_dir: str, r: Range = Range()) -> DataFrame:
    return scan_table(spark, sf_dir, "orders", r, order_value())


def documents(spark: SparkSession, sf_dir: str, r: Range = Range()) -> DataFrame:
    return scan_table(spark, sf_dir, "documents", r, F.col("text").cast("binary"))


def snapshot(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table_snapshot(spark, sf_dir, name)


def order_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value): drops ids of 500 modulo 1000, changes those of 7 modulo 333, adds a key after those of 250 modulo 1000."""
    df, n = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = prefixed("o/", be64(n))
    drop = df.where(n % 1000 == 500).select(key.alias("key"), F.lit(None).cast("binary").alias("value"))
    change = df.where((n % 333 == 7) & (n % 1000 != 500)).select(key.alias("key"), F.concat(order_value(), F.lit(b"!")).alias("value"))
    add = df.where(n % 1000 == 250).select(F.concat(key, F.lit(b"x")).alias("key"), F.lit(b"new").alias("value"))
    return drop.union(change).union(add)


def hexed(df: DataFrame, *rest, key: str = "key") -> DataFrame:
    return df.select(F.hex(key).alias("key_hex"), *rest)


def text(col: str):
    return F.col(col).cast("string").alias(f"{col}_text")


A_SQL = "a AS (SELECT '6F2F' || printf('%016X', o_orderkey) AS key_hex, o_orderkey AS n, o_orderstatus || '|' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS value FROM orders)"
B_SQL = ("b AS (SELECT key_hex, value || CASE WHEN n % 333 = 7 THEN '!' ELSE '' END AS value FROM a WHERE n % 1000 <> 500 "
         "UNION ALL SELECT key_hex || '78', 'new' FROM a WHERE n % 1000 = 250)")
C_SQL = ("c AS (SELECT coalesce(a.key_hex, b.key_hex) AS key_hex, CASE WHEN a.key_hex IS NULL THEN 'Added' WHEN b.key_hex IS NULL THEN 'Removed' ELSE 'Changed' END AS change, "
         "a.value AS old_text, b.value AS new_text FROM a FULL OUTER JOIN b ON a.key_hex = b.key_hex WHERE a.value IS DISTINCT FROM b.value)")
D_SQL = "d AS (SELECT '642F' || printf('%016X', doc_id) AS key_hex, doc_id, text, octet_length(encode(text)) AS size, CASE WHEN octet_length(encode(text)) > 1024 THEN 32 ELSE octet_length(encode(text)) END AS stored FROM documents)"
