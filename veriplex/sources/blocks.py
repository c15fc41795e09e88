"""Block stores: a table of (cid, kind, body), appended to and read by id."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.node import EMPTY, EMPTY_ROOT, TREE_NODE

SCHEMA = "cid binary, kind int, body binary"


class BlockTable:
    """Blocks in Parquet files. Appending is idempotent: blocks are named by their content, and reads drop repeats."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, blocks: DataFrame) -> None:
        blocks.select("cid", F.col("kind").cast("int").alias("kind"), "body").write.mode("append").parquet(self.path)

    def init(self) -> bytes:
        """Stores the empty tree and returns its root."""
        self.append(self.spark.createDataFrame([(bytearray(EMPTY_ROOT), TREE_NODE, bytearray(EMPTY))], SCHEMA))
        return EMPTY_ROOT

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).dropDuplicates(["cid"])

    def fetch(self, cids: list[bytes]) -> dict[bytes, bytes]:
        """The bodies of the named blocks that there are; readers name 64 at a time at most."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("cid").isin([bytearray(c) for c in cids])).select("cid", "body").collect()
        return {bytes(r.cid): bytes(r.body) for r in rows}

    def publish(self, name: str, root: bytes, height: int, agg: tuple[int, int]) -> None:
        """Names a root, after all its blocks are there."""
        self.spark.createDataFrame([(name, bytearray(root), height, *agg)], "name string, root binary, height int, entries long, bytes long").write.mode("append").parquet(f"{self.path}.heads")

    def heads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}.heads")


def overlay(fresh: DataFrame, base: DataFrame) -> DataFrame:
    """Fresh blocks first, the base's others after."""
    return fresh.unionByName(base.join(fresh.select("cid"), "cid", "left_anti"))


def missing(wanted: DataFrame, blocks: DataFrame, limit: int = 64) -> DataFrame:
    """The first wanted (cid, place) that a store does not hold."""
    return wanted.join(blocks.select("cid"), "cid", "left_anti").orderBy("place").limit(limit)


class Overlay(Mapping):
    """A dictionary of fresh blocks before another mapping."""

    def __init__(self, base: Mapping[bytes, bytes]) -> None:
        self.base, self.fresh = base, {}

    def put(self, cid: bytes, body: bytes) -> None:
        self.fresh[cid] = body

    def __getitem__(self, cid: bytes) -> bytes:
        return self.fresh[cid] if cid in self.fresh else self.base[cid]

    def __iter__(self) -> Iterator[bytes]:
        yield from self.fresh
        yield from (c for c in self.base if c not in self.fresh)

    def __len__(self) -> int:
        return sum(1 for _ in self)
