"""Packs: a set of blocks in one body, ordered by block id, with one encoding for each set."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .build import Tree, _whole, deal
from .node import PARITY_KIND, RAW, TREE_NODE, block_ids

# Fixed values of the format.
MAGIC, MAX_PACK, MIN_MEMBER, HEADER = b"PK01", 1024 * 1024, 5, 6
PACKED = "carrier int, pack binary, cid binary, kind int, size long, digest binary"
RETURNED = "cid binary, kind int, size long, digest binary, back boolean"
#: Bytes of packs whose members a task hashes together, about.
AT_ONCE = 1 << 22


class PackError(Exception):
    """NotAPack, Empty, CountDoesNotFit, Truncated, KindNotPackable, MemberTooLong, OutOfOrder, MemberNotWellFormed or
    TrailingBytes for a body; Empty, TooManyMembers, MemberTooLong or TooLarge for what cannot be packed."""

    def __init__(self, kind: str, member: int | None = None) -> None:
        super().__init__(kind if member is None else f"{kind}({member})")
        self.kind, self.member = kind, member


@dataclass(frozen=True)
class Policy:
    """What the caller decides: which kinds may travel, how long they may be, and whether a body is a block of its kind."""

    packable: Callable[[int], bool] = lambda kind: True
    max_body: Callable[[int], int] = lambda kind: MAX_PACK
    well_formed: Callable[[int, bytes], bool] = lambda kind, body: True


def build(members: list[tuple[int, bytes]], ids: list[bytes] | None = None) -> bytes:
    """The pack of the members (kind, body); ids: those of the members, if they have been hashed already."""
    if not members:
        raise PackError("Empty")
    own = sorted(dict(zip(block_ids(members) if ids is None else ids, members, strict=True)).items())
    if len(own) > 0xFFFF:
        raise PackError("TooManyMembers")
    size = HEADER + sum(MIN_MEMBER + len(body) for _, (_, body) in own)
    if size > MAX_PACK:
        raise PackError("TooLarge")
    return MAGIC + struct.pack("<H", len(own)) + b"".join(struct.pack("<BI", kind, len(body)) + body for _, (kind, body) in own)


def _scan(data: bytes, policy: Policy) -> tuple[list[tuple[int, bytes]], PackError | None]:
    """(kind, body) of the members up to the first that lengths or kinds refuse, and that refusal. Nothing is hashed."""
    if len(data) < HEADER or len(data) > MAX_PACK or data[:4] != MAGIC:
        raise PackError("NotAPack")
    (count,) = struct.unpack_from("<H", data, 4)
    if not count:
        raise PackError("Empty")
    if count * MIN_MEMBER > len(data) - HEADER:
        raise PackError("CountDoesNotFit")
    out, at = [], HEADER
    for i in range(count):
        if at + MIN_MEMBER > len(data):
            return out, PackError("Truncated", i)
        kind, size = struct.unpack_from("<BI", data, at)
        if not policy.packable(kind):
            return out, PackError("KindNotPackable", i)
        if size > policy.max_body(kind):
            return out, PackError("MemberTooLong", i)
        at += MIN_MEMBER
        if at + size > len(data):
            return out, PackError("Truncated", i)
        out.append((kind, data[at:at + size]))
        at += size
    return out, None if at == len(data) else PackError("TrailingBytes")


def _ids(found: list[tuple[int, bytes]]) -> Iterator[bytes]:
    """The members' ids, hashed in runs of 1, 2, 4 and so on: a fault costs the hashing of twice what stands before it at most."""
    at, n = 0, 1
    while at < len(found):
        yield from block_ids(found[at:at + n])
        at, n = at + n, 2 * n


def _checked(found: list[tuple[int, bytes]], fault: PackError | None, ids: Iterator[bytes], policy: Policy) -> list[tuple[int, bytes, bytes]]:
    out, last = [], b""
    for i, (kind, body) in enumerate(found):
        cid = next(ids)
        if cid <= last:
            raise PackError("OutOfOrder", i)
        if not policy.well_formed(kind, body):
            raise PackError("MemberNotWellFormed", i)
        out.append((kind, body, cid))
        last = cid
    if fault is not None:
        raise fault
    return out


def members(data: bytes, policy: Policy = Policy()) -> list[tuple[int, bytes, bytes]]:
    """(kind, body, id) of each member. What lengths and kinds refuse is not hashed; the first member at fault is named."""
    found, fault = _scan(data, policy)
    return _checked(found, fault, _ids(found), policy)


def members_of(packs: list[bytes], policy: Policy = Policy()) -> list[tuple[int, bytes, bytes]]:
    """The members of some packs, one pack after the other, all hashed together."""
    scanned = [_scan(data, policy) for data in packs]
    ids = iter(block_ids([m for found, _ in scanned for m in found]))
    return [m for found, fault in scanned for m in _checked(found, fault, ids, policy)]


def well_formed(data: bytes, policy: Policy = Policy()) -> bool:
    try:
        members(data, policy)
    except PackError:
        return False
    return True


def pack_blocks(blocks: DataFrame, group: str, target: int = MAX_PACK) -> DataFrame:
    """(group, pack): the blocks (cid, kind, body) of each group in packs of at most ``target`` bytes, in order of id. A group is streamed, not gathered; a block that is there twice is packed once."""
    def run(batches):
        import pyarrow as pa

        held, ids, size, own, last = [], [], HEADER, None, None
        for batch in batches:
            out, rows = [], []
            for g, cid, kind, body in zip(*[batch.column(c).to_pylist() for c in (group, "cid", "kind", "body")], strict=True):
                if (g, cid) != last:
                    last = g, cid
                    rows.append((g, kind, body))
            for (g, kind, body), cid in zip(rows, block_ids([(kind, body) for _, kind, body in rows]), strict=True):
                if held and (g != own or size + MIN_MEMBER + len(body) > target or len(held) == 0xFFFF):
                    out.append((own, build(held, ids)))
                    held, ids, size = [], [], HEADER
                own = g
                held.append((kind, body))
                ids.append(cid)
                size += MIN_MEMBER + len(body)
            if out:
                yield pa.record_batch([pa.array([g for g, _ in out], batch.schema.field(group).type), pa.array([p for _, p in out], pa.binary())], [group, "pack"])
        if held:
            yield pa.record_batch([pa.array([own], batch.schema.field(group).type), pa.array([build(held, ids)], pa.binary())], [group, "pack"])

    kind = dict(blocks.dtypes)[group]
    return blocks.select(group, "cid", "kind", "body").repartition(group).sortWithinPartitions(group, "cid").mapInArrow(run, f"{group} {kind}, pack binary")


def _leaf_packs(carrier: Callable[[bytes], int], target: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        marks: set[tuple[bytes, bytes]] = set()
        held: dict[int, tuple[list, list]] = {}
        sizes: dict[int, int] = {}

        def rows():
            for batch in batches:
                marked = batch.filter(batch.column("mark"))
                marks.update(zip(marked.column("key").to_pylist(), marked.column("cid").to_pylist(), strict=True))
                yield batch.filter(pc.invert(batch.column("mark"))) if len(marked) else batch

        def given(packs, listed):
            cols = [[g for g, _ in packs] + [None] * len(listed), [p for _, p in packs] + [None] * len(listed)]
            cols += [[None] * len(packs) + list(c) for c in (zip(*listed, strict=True) if listed else [()] * 4)]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in PACKED.split(", ")])

        for own in _whole(0, rows()):
            packs, listed = [], []
            for entries, node, body, cid, parity in own:
                key = node.keys[0]
                blocks = [(key, cid, TREE_NODE, body), *((key, c, PARITY_KIND, b) for c, b in dict(parity).items())]
                blocks += [(r["key"], r["cid"], RAW, r["body"]) for r in entries if r["cid"] is not None]
                for at, c, kind, block in blocks:
                    listed.append((c, kind, len(block), sha256(block).digest()))
                    if (at, c) in marks:
                        marks.discard((at, c))
                        continue
                    g = carrier(c)
                    if g in held and (sizes[g] + MIN_MEMBER + len(block) > target or len(held[g][0]) == 0xFFFF):
                        packs.append((g, build(*held.pop(g))))
                    if g not in held:
                        held[g], sizes[g] = ([], []), HEADER
                    held[g][0].append((kind, block))
                    held[g][1].append(c)
                    sizes[g] += MIN_MEMBER + len(block)
            yield given(packs, listed)
        for g in sorted(held):
            yield given([(g, build(*held[g]))], [])
    return run


def _dealt(tree: Tree) -> DataFrame:
    """The entries by leaf, and marks for the blocks that another task packs."""
    values = tree.entries.where("cid is not null").select("cid", "key")
    ids = values.unionByName(tree.levels[0].select(F.explode("parity.cid").alias("cid"), "key"))
    more = ids.groupBy("cid").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    return deal(tree.entries, 0, *tree.cut, ids.join(more, "cid").where("key <> first").select("key", "cid").distinct())


def pack_tree(tree: Tree, carrier: Callable[[bytes], int], target: int = MAX_PACK) -> DataFrame:
    """PACKED: the leaves of a tree, their parity and values in packs of at most ``target`` bytes, each of blocks that carrier(id) gives
    one number; and a row without a pack for every block that was there to be packed, with its SHA-256. The blocks are made and packed
    in the same task, so only the entries are shuffled. Of equal blocks that several tasks make, that with the smallest key is packed:
    the others are found by their ids alone, and are marked for the tasks that make them."""
    return _dealt(tree).mapInArrow(_leaf_packs(carrier, target), PACKED)


def _returned(batches):
    import pyarrow as pa

    def out(cols, back):
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary())
        return pa.record_batch([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array([back] * len(cols[0]), pa.bool_())], ["cid", "kind", "size", "digest", "back"])

    for batch in batches:
        listed = batch.filter(batch.column("pack").is_null())
        if len(listed):
            yield out([listed.column(c).to_pylist() for c in ("cid", "kind", "size", "digest")], False)
        for packs in _some(batch.column("pack").drop_null()):
            got = members_of(packs)
            yield out([[c for _, _, c in got], [k for k, _, _ in got], [len(b) for _, b, _ in got], [sha256(b).digest() for _, b, _ in got]], True)


def returned(packed: DataFrame) -> DataFrame:
    """RETURNED of PACKED: every block listed, back false; and every member of the packs as it comes back, back true."""
    return packed.mapInArrow(_returned, RETURNED)


def tree_returned(tree: Tree, carrier: Callable[[bytes], int], target: int = MAX_PACK) -> DataFrame:
    """returned(pack_tree(...)), where the task that has made a pack reads it, so that packs travel nowhere."""
    packs = _leaf_packs(carrier, target)
    return _dealt(tree).mapInArrow(lambda batches: _returned(packs(batches)), RETURNED)


def _some(column) -> Iterator[list[bytes]]:
    """The packs of a column, about AT_ONCE bytes at a time."""
    held, size = [], 0
    for data in column:
        held.append(data.as_py())
        size += len(held[-1])
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def unpack(packs: DataFrame) -> DataFrame:
    """(cid, kind, body) of every member of the packs."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for packs in _some(batch.column("pack")):
                got = members_of(packs)
                yield pa.record_batch([pa.array([c for _, _, c in got], pa.binary()), pa.array([k for k, _, _ in got], pa.int32()), pa.array([b for _, b, _ in got], pa.binary())], ["cid", "kind", "body"])

    return packs.select("pack").mapInArrow(run, "cid binary, kind int, body binary").where(F.col("cid").isNotNull())
