"""Tables as snapshots: order-preserving keys and canonical row values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import be64, prefixed

#: Key prefix and key columns of each table. lineitem repeats its key, so a number within the key goes last.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "region": ("r/", ("r_regionkey",)), "nation": ("n/", ("n_nationkey",)), "customer": ("c/", ("c_custkey",)), "supplier": ("s/", ("s_suppkey",)), "part": ("p/", ("p_partkey",)),
    "orders": ("o/", ("o_orderkey",)), "lineitem": ("l/", ("l_orderkey", "l_linenumber")), "events": ("v/", ("event_id",)), "documents": ("d/", ("doc_id",)),
    "embeddings": ("e/", ("vec_id",)), "pages": ("g/", ("page_id",)), "benchmark": ("b/", ("item_id",)), "labels": ("q/", ("doc_id",)), "conversations": ("t/", ("conv_id", "turn")),
}
REPEATED = {"lineitem"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_value(df: DataFrame, columns: list[str]) -> Column:
    """A row as bytes: JSON of its columns by name, nulls included, so equal rows have equal bytes."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary")


def snapshot(df: DataFrame, prefix: str, key_columns: tuple[str, ...], value: Column | None = None, repeated: bool = False) -> DataFrame:
    """(key, value, and the columns of df). Columns that only the value needs are pruned when the value is not read."""
    rest = [c for c in df.columns if c not in key_columns]
    parts = [be64(F.col(c)) for c in key_columns]
    if repeated:
        df = df.withColumn("key_no", F.row_number().over(Window.partitionBy(*key_columns).orderBy(*rest)))
        parts.append(be64(F.col("key_no")))
    return df.withColumn("key", prefixed(prefix, *parts)).withColumn("value", row_value(df, rest) if value is None else value)


def table_snapshot(spark: SparkSession, sf_dir: str, name: str, value: Column | None = None) -> DataFrame:
    prefix, keys = TABLES[name]
    return snapshot(load(spark, sf_dir, name), prefix, keys, value, name in REPEATED)


def column_bounds(r, prefix: bytes) -> tuple[int | None, int | None]:
    """Least and largest number that a first key column can have in range, None where it is open: a superset of the range's keys."""
    r = r.with_after()
    lo = hi = None
    if r.lo.key is not None and r.lo.key[:len(prefix)] == prefix:
        lo = int.from_bytes(r.lo.key[len(prefix):len(prefix) + 8].ljust(8, b"\0"), "big")
    if r.hi.key is not None and r.hi.key[:len(prefix)] == prefix:
        hi = int.from_bytes(r.hi.key[len(prefix):len(prefix) + 8].ljust(8, b"\xff"), "big")
    return lo, hi


def scan_table(spark: SparkSession, sf_dir: str, name: str, r, value: Column | None = None) -> DataFrame:
    """The table's snapshot in range. The bounds also go to the key column as numbers, and so to the Parquet scan and its row groups."""
    prefix, keys = TABLES[name]
    lo, hi = column_bounds(r, prefix.encode())
    df, most = load(spark, sf_dir, name), (1 << 63) - 1
    if lo is not None:
        df = df.where(F.col(keys[0]) >= F.lit(min(lo, most)))
    if hi is not None:
        df = df.where(F.col(keys[0]) <= F.lit(min(hi, most)))
    return snapshot(df, prefix, keys, value, name in REPEATED).where(r.condition(F.col("key")))
