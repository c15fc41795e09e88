"""Operator 10, mixing sources to target weights.

The words of a source, its documents one after another, are packed into blocks of BLOCK words. Targets in words come
from the weights by filling up to a cap of 2 times the source. An output shard of SHARD slots draws its counts of the
sources from a multinomial over what they still have to give, so that the totals come out; the slots of a source are
numbered through the shards, and slot n takes block perm(n mod blocks) of pass n div blocks, perm being a keyed
permutation of the source's block indices. The last slot of a source is cut to meet the target. Slots are joined with
blocks by source and index.

Shards come in groups of GROUP: a group's counts are one multinomial draw on the driver, its shards draw from these in a task.

Order in a source: documents are dealt to chunks by a hash of doc_id and stand in order of doc_id in each; chunks come in
runs of about as many as there are runs. So the running sum of a source of any size is made of bounded pieces.

Defined cases: null text has no words; a document without words is taken 0 times; a null source is a source of its
own, last in order; a null doc_id comes first in its chunk; repeated rows are documents of their own, in any order among
equal ones; extra columns are ignored by the query and kept by the mix; an empty table gives no rows.
The driver gathers one row a source and the counts of the groups: 8 bytes for each source and GROUP * SHARD slots.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import boxed, partitions, slices, stage, table, text_of, word_count

BLOCK = 2048
SHARD = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Shards of a group: the driver draws the counts of groups, tasks those of the shards in a group.
GROUP = 64
#: Documents of a chunk, about.
CHUNK = 1000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """share * sum(sizes) words by weight, a source stopping at cap times its size and the excess reshared."""
    out = [0.0] * len(sizes)
    live = [i for i, n in enumerate(sizes) if n > 0]
    left = share * sum(sizes)
    while live:
        unit = left / sum(weights[i % len(weights)] for i in live)
        full = [i for i in live if unit * weights[i % len(weights)] > cap * sizes[i]]
        if not full:
            for i in live:
                out[i] = unit * weights[i % len(weights)]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        live = [i for i in live if i not in set(full)]
    return out


def permuted(n: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..size-1 applied to n: a Feistel network of four rounds, walking its cycle into range."""
    bits = max(2, int(size - 1).bit_length() + int(size - 1).bit_length() % 2)
    half = bits // 2
    low = np.uint64((1 << half) - 1)
    seeds = np.random.default_rng(key).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
    out = np.array(n, np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        a, b = x >> np.uint64(half), x & low
        for s in seeds:
            f = (b + s) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= s
            a, b = b, a ^ ((f >> np.uint64(33)) & low)
        out[todo] = (a << np.uint64(half)) | b
        todo[todo] = out[todo] >= np.uint64(size)
    return out.astype(np.int64)


def _key(source: str | None, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{'' if source is None else 's' + source}".encode("utf-8", "surrogatepass")).digest()[:8], "big") >> 1


def quota(size: int, target: float, block: int, key: int) -> tuple[int, int]:
    """(slots, words of the last slot) that give a source its target, rounded."""
    want, blocks = round(target), -(-size // block)
    if not want:
        return 0, 0
    short = int(np.flatnonzero(permuted(np.arange(blocks), blocks, key) == blocks - 1)[0]) if blocks <= 1 << 20 else _where(blocks, key)
    tail = size - (blocks - 1) * block
    passes, rest = divmod(want, size)
    if not rest:
        passes, rest = passes - 1, size
    # In the last pass the first `slots` of the order give `rest` words.
    before = short * block
    if rest <= before or tail == block:
        slots = -(-rest // block)
        last = rest - (slots - 1) * block
    elif rest <= before + tail:
        slots, last = short + 1, rest - before
    else:
        more = rest - before - tail
        slots = short + 1 + -(-more // block)
        last = more - (slots - short - 2) * block
    return passes * blocks + slots, last


def _where(blocks: int, key: int) -> int:
    for at in range(0, blocks, 1 << 20):
        hit = np.flatnonzero(permuted(np.arange(at, min(blocks, at + (1 << 20))), blocks, key) == blocks - 1)
        if len(hit):
            return at + int(hit[0])
    raise AssertionError("not a permutation")


def shard_counts(slots: list[int], shard: int, seed: int | list[int]) -> np.ndarray:
    """Counts (shards, sources): each shard a multinomial draw over what is left, cut to it; the columns sum to slots."""
    left = np.array(slots, np.int64)
    draw, out = np.random.default_rng(seed), []
    while left.sum():
        n = int(min(shard, left.sum()))
        got = np.minimum(draw.multinomial(n, left / left.sum()), left)
        for i in np.argsort(-(left - got), kind="stable"):
            got[i] += min(left[i] - got[i], n - got.sum())
        out.append(got)
        left = left - got
    return np.array(out, np.int64).reshape(len(out), len(slots))


def placed(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, key, source, size, start (words of its source before it)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("key"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"))
    rows = stage(rows, "sizes")
    n = rows.count()
    chunks = max(1, -(-n // CHUNK))
    run = math.isqrt(chunks - 1) + 1
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), F.lit(chunks)))
    sums = stage(rows.groupBy("source", "chunk").agg(F.sum("size").alias("words")).withColumn("run", F.floor(F.col("chunk") / run)), "chunks", n)
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.groupBy("source", "run").agg(F.sum("words").alias("words"))
    runs = runs.select(F.col("source").alias("__s"), F.col("run").alias("__r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    before = Window.partitionBy("source", "run").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inside", F.coalesce(F.sum("words").over(before), F.lit(0))).join(runs, F.col("source").eqNullSafe(F.col("__s")) & (F.col("run") == F.col("__r")))
    sums = sums.select(F.col("source").alias("__s"), F.col("chunk").alias("__c"), (F.col("base") + F.col("inside")).alias("base"))
    within = Window.partitionBy("source", "chunk").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("__s")) & (F.col("chunk") == F.col("__c")))
    return stage(rows.select("doc_id", "key", "source", "size", (F.col("base") + F.col("inner")).alias("start")), "placed", n)


def _slots(plan: list[dict], shard: int, block: int, seed: int):
    """Groups (no, counts of the sources, counts before) -> slots (shard, slot, source_no, pass, block, words)."""
    def run(batches):
        for batch in batches:
            for group, own, first in zip(*[batch.column(c).to_pylist() for c in ("no", "counts", "before")], strict=True):
                counts = shard_counts(own, shard, [seed, group])
                before = np.cumsum(counts, axis=0) - counts + np.array(first, np.int64)
                for i in range(len(counts)):
                    slot = 0
                    for no, s in enumerate(plan):
                        n = before[i, no] + np.arange(counts[i, no])
                        if not len(n):
                            continue
                        index = permuted(n % s["blocks"], s["blocks"], s["key"])
                        words = np.where(n == s["slots"] - 1, s["last"], np.minimum(block, s["size"] - index * block))
                        columns = np.full(len(n), group * GROUP + i), slot + np.arange(len(n)), np.full(len(n), no, np.int32), (n // s["blocks"]).astype(np.int32), index, words
                        yield pa.record_batch([pa.array(c) for c in columns], ["shard", "slot", "source_no", "pass", "block", "words"])
                        slot += len(n)
    return run


def mix_slots(rows: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 10, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """(slots, sources) of the mix of rows as placed() gives them; sources: source_no, source, source_size, target."""
    spark = rows.sparkSession
    found = sorted(((r.source, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be", "surrogatepass")))
    goals = targets([n for _, n in found], weights, share, cap)
    plan = []
    for (source, n), goal in zip(found, goals, strict=True):
        key = _key(source, seed)
        slots, last = quota(n, goal, block, key)
        plan.append({"source": source, "size": n, "target": goal, "key": key, "blocks": max(1, -(-n // block)), "slots": slots, "last": last})
    counts = shard_counts([s["slots"] for s in plan], shard * GROUP, seed)
    before = np.cumsum(counts, axis=0) - counts
    sources = spark.createDataFrame([(i, s["source"], s["size"], float(s["target"])) for i, s in enumerate(plan)], "source_no int, source string, source_size long, target double")
    groups = spark.createDataFrame([(i, c, b) for i, (c, b) in enumerate(zip(counts.tolist(), before.tolist(), strict=True))], "no long, counts array<long>, before array<long>")
    groups = groups.repartition(max(1, min(len(counts), partitions(spark))), "no")
    return stage(groups.mapInArrow(_slots(plan, shard, block, seed), "shard long, slot long, source_no int, pass int, block long, words long"), "slots"), sources


def pieces(rows: DataFrame, slots: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: per slot and document in its block doc_id, key, size, shard, slot, pass, first and n (words of the document)."""
    named = rows.join(F.broadcast(sources.select("source_no", F.col("source").alias("__s"))), F.col("source").eqNullSafe(F.col("__s"))).where("size > 0")
    span = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    own = named.withColumn("block", F.explode(span))
    met = own.join(slots.hint("merge"), ["source_no", "block"])  # slots grow with the words, and their files are far smaller than they are
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    return met.select("doc_id", "key", "size", "source_no", "start", "shard", "slot", "pass", (lo - F.col("start")).alias("first"), (hi - lo).alias("n")).where("n > 0")


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    rows = placed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    slots, sources = mix_slots(rows)
    taken = pieces(rows, slots, sources).groupBy("source_no", "start").agg(F.sum("n").alias("taken"))
    named = rows.join(F.broadcast(sources.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s")))
    # A document with words is known by where it starts in its source; one without takes none.
    own = named.join(taken.withColumnRenamed("source_no", "__n").withColumnRenamed("start", "__b"), (F.col("source_no") == F.col("__n")) & (F.col("start") == F.col("__b")) & (F.col("size") > 0), "left")
    return own.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _cut(batches):
    """(row, spans, size, text) with text cut to the words of spans, neighbours joined."""
    for batch in (own for whole in batches for own in slices(whole)):
        texts = []
        for text, spans, size in zip(*[batch.column(c).to_pylist() for c in ("text", "spans", "size")], strict=True):
            if sum(s["n"] for s in spans) == size:
                texts.append(text)
                continue
            at = [m.span() for m in _WORD.finditer(text)]
            merged = []
            for first, n in sorted((s["first"], s["n"]) for s in spans):
                if merged and merged[-1][1] == first:
                    merged[-1][1] += n
                else:
                    merged.append([first, first + n])
            texts.append("\n".join(text[at[a][0]:at[b - 1][1]] for a, b in merged))
        yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def mix_documents(docs: DataFrame, seed: int = 10) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes any of its words, its text cut to those; n_chars follows."""
    rows = placed(docs.select("doc_id", "source", "text"))
    slots, sources = mix_slots(rows, seed=seed)
    got = pieces(rows, slots, sources).groupBy("doc_id", "key", "source_no", "start", "pass", "size").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    # Repeated rows: each start is a row of its own, and equal rows are told apart by their number.
    again = F.row_number().over(Window.partitionBy("doc_id", "key", "source_no", "pass").orderBy("start"))
    got = stage(got.withColumn("again", again), "mix", 2 * rows.count())
    repeated = not got.where("again > 1").isEmpty()
    got = got.join(F.broadcast(sources.select("source_no", F.col("source").alias("own_source"))), "source_no")  # a row a source
    got = got.select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), "own_source", "size", "spans", "again")
    own = boxed(docs).withColumn("key", F.xxhash64("text")).withColumn("source", F.col("row.source").cast("string"))
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")) & F.col("source").eqNullSafe(F.col("own_source"))
    if repeated:
        own = own.withColumn("no", F.row_number().over(Window.partitionBy("id", "key", "source").orderBy(F.lit(0))))
        same = same & (F.col("no") == F.col("again"))
    # The text travels once, beside the row.
    kinds = dict(docs.dtypes)
    rest = F.col("row").dropFields("text") if len(docs.columns) > 1 else F.col("row")
    met = own.withColumn("row", rest).join(got, same).select("row", "spans", "size", "text")
    out = met.mapInArrow(_cut, StructType([met.schema["row"], StructField("text", StringType())]))
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast(kinds.get("n_chars", "long"))}
    return out.select(*[(made[c] if c in made else F.col("row").getField(c)).alias(c) for c in docs.columns])
