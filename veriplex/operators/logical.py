"""Snapshots as DataFrames (key, value): reads, pages, aggregates, differences and edits as plans that Catalyst optimises."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import MAX_KEY, MAX_VALUE, entry_cost, is_reference, successor

DEFAULT_ENTRIES, DEFAULT_BYTES = 1024, 256 * 1024


class RangeError(Exception):
    """A refused scan; kind is NoLimit."""


class AggregateError(Exception):
    """A refused aggregate; NotWholeRange names what is paged."""


class DiffError(Exception):
    """A refused difference: RootsChanged or Unsupported."""


class ApplyError(Exception):
    """A refused batch: NotSorted (a key twice), KeyTooLong or ValueTooLong."""


@dataclass(frozen=True)
class Bound:
    key: bytes | None = None
    included: bool = True

    @staticmethod
    def including(key: bytes) -> Bound:
        return Bound(key, True)

    @staticmethod
    def excluding(key: bytes) -> Bound:
        return Bound(key, False)


OPEN = Bound()


@dataclass(frozen=True)
class Range:
    """Bounds, direction, keyset position and limits of a scan."""

    lo: Bound = OPEN
    hi: Bound = OPEN
    reverse: bool = False
    after: bytes | None = None
    max_entries: int = DEFAULT_ENTRIES
    max_bytes: int = DEFAULT_BYTES

    @staticmethod
    def prefix(p: bytes, **rest) -> Range:
        top = successor(p)
        return Range(Bound.including(p), Bound.excluding(top) if top is not None else OPEN, **rest)

    def with_after(self) -> Range:
        """The same keys with ``after`` folded into the bounds; an ``after`` outside them changes nothing."""
        if self.after is None:
            return self
        if self.reverse:
            tighter = self.hi.key is None or self.after <= self.hi.key
            return replace(self, hi=Bound.excluding(self.after) if tighter else self.hi, after=None)
        tighter = self.lo.key is None or self.after >= self.lo.key
        return replace(self, lo=Bound.excluding(self.after) if tighter else self.lo, after=None)

    def is_empty(self) -> bool:
        """Whether the bounds alone, position and direction included, leave no key."""
        r = self.with_after()
        if r.lo.key is None:
            return r.hi.key == b"" and not r.hi.included
        if r.hi.key is None:
            return False
        return r.lo.key > r.hi.key or r.lo.key == r.hi.key and not (r.lo.included and r.hi.included)

    def holds(self, key: bytes) -> bool:
        r = self.with_after()
        low = r.lo.key is None or key > r.lo.key or r.lo.included and key == r.lo.key
        return low and (r.hi.key is None or key < r.hi.key or r.hi.included and key == r.hi.key)

    def condition(self, key: Column) -> Column:
        """Plain comparisons, which reach the Parquet scan (a binary ``startswith`` would not)."""
        r, out = self.with_after(), F.lit(True)
        if self.is_empty():
            return F.lit(False)
        if r.lo.key is not None:
            out = out & ((key >= F.lit(r.lo.key)) if r.lo.included else (key > F.lit(r.lo.key)))
        if r.hi.key is not None:
            out = out & ((key <= F.lit(r.hi.key)) if r.hi.included else (key < F.lit(r.hi.key)))
        return out


def get(entries: DataFrame, *keys: bytes) -> DataFrame:
    return entries.where(F.col("key").isin(list(keys)) if len(keys) > 1 else F.col("key") == F.lit(keys[0]))


def scan(entries: DataFrame, r: Range) -> DataFrame:
    """Every entry in range, unordered and without limits."""
    return entries.where(r.condition(F.col("key")))


def page(entries: DataFrame, r: Range) -> DataFrame:
    """The page of a range in scan order, with ``n`` (from 1) and ``page_bytes`` (running cost).

    The entry limit comes first, as a top-k, so that the running sum sees max_entries rows at most; the byte limit stops before an
    entry that would exceed it, but one entry is always served.
    """
    if r.max_entries == 0:
        raise RangeError("NoLimit")
    order = F.col("key").desc() if r.reverse else F.col("key").asc()
    first = scan(entries, r).orderBy(order).limit(r.max_entries)
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = first.withColumn("n", F.row_number().over(Window.orderBy(order))).withColumn("page_bytes", F.sum(entry_cost(F.col("key"), F.col("value"))).over(w))
    return out.where((F.col("n") == 1) | (F.col("page_bytes") <= r.max_bytes))


def page_status(entries: DataFrame, r: Range) -> DataFrame:
    """One row: served, next_key (last served, if a limit stopped the page), page_end (Limit, EndOfRange or EndOfTree)."""
    if r.max_entries == 0:
        raise RangeError("NoLimit")
    spark = entries.sparkSession
    if r.is_empty():
        return spark.createDataFrame([(0, None, "EndOfRange")], "served long, next_key binary, page_end string")
    served = page(entries, r)
    last = F.min("key") if r.reverse else F.max("key")
    stats = served.agg(F.count("*").alias("served"), last.alias("last"))
    total = page(entries, replace(r, max_entries=min(r.max_entries + 1, 1 << 30), max_bytes=1 << 62)).agg(F.count("*").alias("seen"))
    ends = entries.agg(F.min("key").alias("least"), F.max("key").alias("most"))
    one = stats.join(total, F.lit(True)).join(ends, F.lit(True))  # three aggregates of one row each
    limited = (F.col("served") >= r.max_entries) | (F.col("seen") > F.col("served"))
    if r.reverse:
        lo = r.with_after().lo
        end = F.lit("EndOfTree") if lo.key is None else F.when((F.col("last") == F.col("least")) & (F.col("least") > F.lit(lo.key)), "EndOfTree").otherwise("EndOfRange")
    else:
        high = r.with_after().hi
        at_end = F.lit(True) if high.key is None else F.col("most").isNull() | ((F.col("most") <= F.lit(high.key)) if high.included else (F.col("most") < F.lit(high.key)))
        end = F.when(at_end, "EndOfTree").otherwise("EndOfRange")
    return one.select("served", F.when(limited, F.col("last")).alias("next_key"), F.when(limited, "Limit").otherwise(end).alias("page_end"))


def seek(entries: DataFrame, key: bytes | None, how: str) -> DataFrame:
    """The entry a cursor stands on: ``ge`` and ``gt`` the first from a key on, ``le`` and ``lt`` the last up to it, ``first``, ``last``."""
    k = F.col("key")
    if how in ("first", "last"):
        return entries.orderBy(k.asc() if how == "first" else k.desc()).limit(1)
    where = {"ge": k >= F.lit(key), "gt": k > F.lit(key), "le": k <= F.lit(key), "lt": k < F.lit(key)}[how]
    return entries.where(where).orderBy(k.asc() if how[0] == "g" else k.desc()).limit(1)


def whole(r: Range) -> None:
    """Aggregates are of whole ranges: direction, position and limits are refused."""
    for name, bad in (("reverse", r.reverse), ("after", r.after is not None), ("max_entries", r.max_entries != DEFAULT_ENTRIES), ("max_bytes", r.max_bytes != DEFAULT_BYTES)):
        if bad:
            raise AggregateError(f"NotWholeRange({name})")


def aggregate(entries: DataFrame, r: Range = Range()) -> DataFrame:
    """One row (entries, bytes) over the range; bytes are key and full value lengths. ANSI sums refuse to overflow."""
    whole(r)
    size = (F.octet_length("key") + F.octet_length("value")).cast("long")
    return scan(entries, r).agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def aggregate_by(entries: DataFrame, group: Column, name: str = "kind") -> DataFrame:
    """The same by a function of the key, such as its type prefix: partial sums, then one small shuffle."""
    size = (F.octet_length("key") + F.octet_length("value")).cast("long")
    return entries.groupBy(group.alias(name)).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"))


@dataclass(frozen=True)
class Resume:
    """Where a paged difference of two snapshots goes on."""

    a: bytes
    b: bytes
    after: bytes


def changes(a: DataFrame, b: DataFrame, r: Range = Range()) -> DataFrame:
    """(key, change, old, new) of the keys in range whose values differ: Added, Removed or Changed."""
    if r.reverse or r.after is not None:
        raise DiffError(f"Unsupported({'reverse' if r.reverse else 'after'})")
    left, right = (scan(x, r).select("key", F.col("value").alias(n)) for x, n in ((a, "old"), (b, "new")))
    both = left.join(right, "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("key", F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Removed").otherwise("Changed").alias("change"), "old", "new")


def change_cost() -> Column:
    side = lambda c: F.coalesce(F.when(is_reference(F.col(c)), 32).otherwise(F.octet_length(c)), F.lit(0))
    return F.octet_length("key") + side("old") + side("new")


def change_page(a: DataFrame, b: DataFrame, r: Range, roots: tuple[bytes, bytes] | None = None, resume: Resume | None = None) -> DataFrame:
    """A page of changes in key order, with ``n`` and ``page_bytes``. Limits of 0 are none; the byte limit is checked before each step, so it can be passed by one change."""
    if resume is not None:
        if roots is not None and (resume.a, resume.b) != roots:
            raise DiffError("RootsChanged")
        r = replace(replace(r, after=resume.after).with_after())
    out = changes(a, b, r).orderBy("key")
    out = out.limit(r.max_entries) if r.max_entries else out
    w = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("page_bytes", F.sum(change_cost()).over(w)).withColumn("n", F.row_number().over(Window.orderBy("key")))
    return out.where(F.col("page_bytes") - change_cost() < r.max_bytes) if r.max_bytes else out


def check_edits(edits: DataFrame) -> None:
    """Refuses a batch (key, value; a null value deletes) before anything is read."""
    bad = edits.agg(F.max(F.octet_length("key")).alias("k"), F.max(F.octet_length("value")).alias("v")).first()
    if (bad.k or 0) > MAX_KEY:
        raise ApplyError("KeyTooLong")
    if (bad.v or 0) > MAX_VALUE:
        raise ApplyError("ValueTooLong")
    if not edits.groupBy("key").count().where("count > 1").isEmpty():
        raise ApplyError("NotSorted")


def apply(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """The entries after a batch of puts and deletes: one full outer join, the edit winning."""
    check_edits(edits)
    e = edits.select("key", F.col("value").alias("new"), F.lit(True).alias("edited"))
    both = entries.select("key", "value").join(e, "key", "full_outer")
    return both.select("key", F.when(F.col("edited"), F.col("new")).otherwise(F.col("value")).alias("value")).where("value is not null")


def effective(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits that change anything: no-op puts and deletes of absent keys go."""
    e = edits.select("key", F.col("value").alias("new"))
    joined = e.join(entries.select("key", "value"), "key", "left")
    return joined.where(~F.col("new").eqNullSafe(F.col("value"))).select("key", F.col("new").alias("value"))


def out_of_order(entries: DataFrame) -> DataFrame:
    """Keys that break the contract: too long, or there twice."""
    return entries.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.octet_length("key") > MAX_KEY)).select("key")
