"""Helpers that the training-data operators share: staging, text patterns and joins that survive hot keys."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, and runs of anything else: the words of every operator.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds over 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 200
HOT_SALTS = 1024


#: Small rows of a staged file: below the first number more tasks would have too little to do, above the second there are more tasks than cores.
FILE_ROWS = (20_000, 500_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only a session on one machine that names none gets one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="veriplex-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veriplex/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of any executor.

    ``rows``: about how many there are at most; few rows are then written by as many tasks as there are cores, not by one for each partition."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, min(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS[0])), -(-rows // FILE_ROWS[1])))
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more, instead of whenever the driver happens to collect garbage."""
    for _ in range(2):  # first Python's handles go, then what they held; files go in the background
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def remove(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for at in paths:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file in the shared store."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def slices(batch, column: str = "text", size: int = 4 << 20):
    """Arrow batches of about ``size`` bytes of a column; a longer value is alone."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    cuts = np.append(np.searchsorted(ends, np.arange(size, int(ends[-1]) + size, size), side="left") + 1, len(ends)).clip(1, len(ends))
    at = 0
    for cut in np.unique(cuts).tolist():
        yield batch.slice(at, cut - at)
        at = cut


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, total: int | None = None) -> DataFrame:
    """rows left-joined with groups (one row a key, ``size`` rows of ``rows`` in each; ``total`` in all, counted if not given).

    Keys that hold over 1/HOT_SHARE of all rows, HOT_SHARE at most, are broadcast; their rows then go to the second
    join under salts made from ``spread``, so that no task gets a group of unbounded size.
    """
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    names = [c for c in groups.columns if c != key]
    kept = F.struct(*names)
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total)).select(F.col(key).alias("__hk"), kept.alias("__hot"))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(total)).select(
        F.col(key).alias("__ck"), F.lit(-1).cast("long").alias("__cs"), kept.alias("__cold"))
    rows = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hk")), "left").withColumn(
        "__s", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(HOT_SALTS))).otherwise(F.lit(-1)).cast("long"))
    joined = rows.join(cold, (F.col(key) == F.col("__ck")) & (F.col("__s") == F.col("__cs")), "left")
    joined = joined.withColumn("__got", F.coalesce("__hot", "__cold"))
    return joined.select("*", *[F.col(f"__got.{c}").alias(c) for c in names]).drop("__hk", "__hot", "__ck", "__cs", "__cold", "__s", "__got")


def boxed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, id, text) of docs: row is a struct of all their columns, so that no name of theirs meets a name used here."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return own.select("row", F.col("row.doc_id").cast("long").alias("id"), text_of(f"row.{text}").alias("text"))


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of the nodes in edges (a, b), component being the smallest node reachable.

    Alternates the large-star and small-star steps until the edges stay as they are; each round is staged. The only
    aggregates are minima, which combine before the shuffle. A node is joined with its minimum through attach(), which
    spreads the edges of a node that holds a large share of them.
    """
    a, b = F.col("a"), F.col("b")
    edges = stage(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    n, seen = edges.count(), None
    while n:
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
        large = attach(both.withColumnRenamed("a", "u"), low, "u", "n", b, 2 * n).where(b > F.col("u")).select(b.alias("a"), F.col("m").alias("b"))
        large = stage(large.where(a != b).distinct(), "large", n)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumnRenamed("a", "u")
        small = attach(large.withColumnRenamed("a", "u"), low, "u", "n", b, n).select(F.explode(F.array(
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stage(small.where(a != b).distinct(), "small", 2 * n)
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        n = mark.n
        if mark == seen:
            break
        seen = mark
    own = edges.select(F.col("a").alias("node"), b.alias("component"))
    return own.union(edges.select(b.alias("node"), b.alias("component")).distinct())
