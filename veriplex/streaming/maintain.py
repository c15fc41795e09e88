"""Incremental maintenance: every micro-batch of edits becomes one batch applied to a snapshot."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.logical import apply


class SnapshotStream:
    """Keeps (key, value) in versioned Parquet folders; a batch seen before is not applied again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def version(self, n: int) -> str:
        return os.path.join(self.path, f"version={n:012d}")

    def read(self, n: int) -> DataFrame:
        if n < 0:
            return self.spark.createDataFrame([], "key binary, value binary")
        return self.spark.read.parquet(self.version(n))

    def take(self, edits: DataFrame, batch: int) -> None:
        """edits: key, value (null deletes), and optionally seq, the largest of which wins in a batch."""
        order = F.col("seq").desc() if "seq" in edits.columns else F.lit(0)
        last = edits.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(order))).where("__n = 1").select("key", "value")
        apply(self.read(batch - 1), last).write.mode("overwrite").parquet(self.version(batch))

    def start(self, edits: DataFrame, checkpoint: str, done: Callable[[int], None] | None = None):
        def each(df: DataFrame, batch: int) -> None:
            self.take(df, batch)
            if done:
                done(batch)

        return edits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
