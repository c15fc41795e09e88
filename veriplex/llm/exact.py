"""Operator 7, exact deduplication: keyed streaming state on disk, native Spark expressions only.

A digest table of the input is read as a stream. A streaming aggregation keeps, for ever and in RocksDB, one entry a
digest: the number of rows, and of the row that stays its length, identifier and content locator (the file it came
from). Hits, digests with more than one row, are then checked on their full normalised bytes.

Defined cases: null text is the empty text; all texts without any word are equal; of equal texts the one with most code
points stays, then the smallest doc_id, a null doc_id last; rows repeated with one doc_id give one result row each;
columns other than doc_id and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, attach, boxed, new_folder, partitions, stage, text_of, unboxed

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bits of the bitmap of hits: a fixed 8 MiB whatever the input.
BITMAP_BITS = 1 << 26
#: Input rows for a partition of the state, each a store of its own with fixed costs; the session's shuffle partitions are the most.
STATE_ROWS = 20_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def _digest(text: Column, digest: str) -> Column:
    return F.sha2(normalised(text), 256) if digest == "sha256" else F.lpad(F.hex(F.crc32(normalised(text).cast("binary"))), 8, "0")


def _state(spark, digests: DataFrame, folder: str, n: int) -> DataFrame:
    """The keyed state after the stream has taken in every row of ``folder``: (digest, keep, n)."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
        "spark.sql.streaming.internal.stateStore.partitions": str(max(1, min(partitions(spark), -(-n // STATE_ROWS)))),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    at = new_folder(spark, "state")
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(digests.schema).parquet(folder)
        state = rows.groupBy("digest").agg(
            F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("not_id"), "locator")).alias("keep"), F.count("*").alias("n"))
        query = (state.writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", at).trigger(availableNow=True).start())
        query.awaitTermination()
        if query.lastProgress is None:  # no file at all
            return spark.createDataFrame([], state.schema)
        found = spark.read.format("statestore").load(at)
        names = found.schema["value"].dataType.names
        return found.select("key.digest", F.col(f"value.{names[0]}").alias("keep"), F.col(f"value.{names[1]}").alias("n"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def flagged(rows: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    """rows with a boolean ``maybe``: true where the columns ``key`` stand in keys, and seldom elsewhere. It is told from a
    broadcast bitmap, of a fixed size whatever the input; the more keys there are, the more rows it lets through."""
    bit = F.pmod(F.xxhash64(*key), F.lit(BITMAP_BITS))
    bits = keys.select(bit.alias("bit"))
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("map_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    names = rows.columns
    rows = rows.withColumn("bit", bit).withColumn("map_bucket", F.bitmap_bucket_number("bit")).withColumn("pos", F.bitmap_bit_position("bit"))
    held = F.expr("(shiftright(cast(conv(hex(substring(map, cast(pos div 8 as int) + 1, 1)), 16, 10) as int), cast(pos % 8 as int)) & 1) = 1")
    return rows.join(F.broadcast(maps), "map_bucket", "left").select(*names, F.coalesce(held, F.lit(False)).alias("maybe"))


def settled(docs: DataFrame, gone: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """docs without the rows that gone (own_id, own_key) names, and with those that again names kept once; same columns.
    Only rows that the bitmap lets through are shuffled with their texts."""
    mine = boxed(docs).select("row", "id", F.xxhash64("text").alias("key"))
    named = gone.unionByName(again) if again is not None else gone
    mine = flagged(mine, named.select(F.col("own_id").alias("id"), F.col("own_key").alias("key")), "id", "key")
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key"))
    doubt = mine.where("maybe").join(gone, same, "left_anti")
    if again is not None:
        once = doubt.join(again, same, "left_semi").dropDuplicates(["id", "key"])
        doubt = doubt.join(again, same, "left_anti").unionByName(once)
    return unboxed(mine.where("not maybe").select("row").unionByName(doubt.select("row")))


def _collided(docs: DataFrame, groups: DataFrame, digest: str) -> DataFrame:
    """Digests of hits whose full bytes differ. The bitmap lets through few rows besides the hits; their
    texts combine to a minimum and a maximum before the shuffle, so a large group sends two texts a task."""
    texts = docs.select(_digest(text_of(), digest).alias("digest"), normalised(text_of()).alias("norm"))
    maybe = flagged(texts, groups.where("n > 1").select("digest"), "digest").where("maybe")
    return maybe.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest")


def exact_groups(docs: DataFrame, digest: str = "sha256") -> DataFrame:
    """Per input row: doc_id, key, digest, n_points, keep_id, keep_points, group_size, locator. key, a hash of the text, tells rows of one doc_id apart."""
    spark = docs.sparkSession
    folder = new_folder(spark, "digests")
    text = text_of()
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), _digest(text, digest).alias("digest"), F.char_length(text).alias("n_points"),
                F.input_file_name().alias("locator")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    n = rows.count()
    groups = stage(_state(spark, rows, folder, n), "groups", n)
    bad = stage(_collided(docs, groups, digest), "collided", n)
    rows = rows.drop("locator")
    if not bad.isEmpty():
        # Equal digests over different bytes: the bytes themselves, by a second and a first digest, name those groups.
        full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), _digest(text, digest).alias("digest"), F.char_length(text).alias("n_points"),
                           normalised(text).alias("norm")).join(bad, "digest", "left_semi")
        full = full.withColumn("digest", F.concat_ws(":", "digest", F.sha2("norm", 256), F.sha2(F.reverse("norm"), 256))).drop("norm")
        rows = stage(rows.join(bad, "digest", "left_anti").unionByName(full), "digests")
        groups = stage(rows.groupBy("digest").agg(F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("not_id"), F.lit("").alias("locator"))).alias("keep"), F.count("*").alias("n")), "groups")
    groups = groups.select("digest", F.bitwise_not("keep.not_id").alias("keep_id"), F.col("keep.n_points").alias("keep_points"), F.col("n").alias("group_size"), "keep.locator")
    return attach(rows, groups, "digest", "group_size", F.struct("doc_id", "n_points"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row stands for; same columns. Rows repeated with one doc_id become one."""
    groups = exact_groups(docs.select("doc_id", "text"))
    # Of rows with the id that stays, those whose text is shorter, or of another order, go too: the longest is told by its points.
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    own = [F.col("doc_id").alias("own_id"), F.col("key").alias("own_key")]
    left = groups.where(stays & (F.col("group_size") > 1)).groupBy("digest").agg(F.min("key").alias("own_key"), F.first("doc_id").alias("own_id"), F.count("*").alias("n"), F.max("key").alias("other"))
    n = docs.select("doc_id").count()
    several = stage(left.where("n > 1"), "several", n)
    gone = groups.where(~stays).select(*own).distinct()
    if several.isEmpty():
        return settled(docs, stage(gone, "gone", n))
    again = several.select("own_id", "own_key")
    rest = groups.where(stays).join(several.where("own_key < other").select("digest", F.col("own_key").alias("least")), "digest").where("key > least").select(*own)
    return settled(docs, stage(gone.unionByName(rest.distinct()), "gone", n), again)
