"""Blocks and nodes: one canonical encoding of each."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ..functions.blake3 import blake3, blake3_many
from ..functions.keys import MAX_INLINE, MAX_KEY, MAX_VALUE, common_prefix, key4

# Fixed values of the format.
MAGIC = b"PT01"
RAW, TREE_NODE, PARITY_KIND = 0, 1, 4
MAX_NODE, HEADER, LEAF_FIXED, BRANCH_FIXED, REF = 16384, 28, 7, 50, 32
MAX_PCOUNT = 128


def block_id(kind: int, body: bytes) -> bytes:
    return blake3(bytes([kind]) + body)


def block_ids(blocks: list[tuple[int, bytes]]) -> list[bytes]:
    return blake3_many([bytes([k]) + b for k, b in blocks])


class NodeError(Exception):
    """Why bytes are not a node; ``kind`` is the reason's name."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


class BuildError(Exception):
    """Why an entry or node cannot be built; ``kind`` is the reason's name."""

    def __init__(self, kind: str, detail: object = None) -> None:
        super().__init__(kind)
        self.kind, self.detail = kind, detail


@dataclass(frozen=True)
class Value:
    """Inline bytes, or a reference by block id and length: by length alone, never by choice."""

    inline: bytes | None = None
    cid: bytes | None = None
    length: int = 0

    @staticmethod
    def of(data: bytes, cid: bytes | None = None) -> Value:
        if len(data) <= MAX_INLINE:
            return Value(data, None, len(data))
        if len(data) > MAX_VALUE:
            raise BuildError("ValueTooLong")
        return Value(None, cid or block_id(RAW, data), len(data))

    @property
    def is_ref(self) -> bool:
        return self.inline is None

    @property
    def stored(self) -> bytes:
        return self.cid if self.is_ref else self.inline


@dataclass
class Node:
    level: int
    keys: list[bytes]
    values: list[Value] = field(default_factory=list)  # of a leaf
    children: list[tuple[bytes, int, int]] = field(default_factory=list)  # of a branch: id, count, bytes
    parity: list[bytes] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.keys)

    @property
    def agg(self) -> tuple[int, int]:
        if self.level:
            return sum(c[1] for c in self.children), sum(c[2] for c in self.children)
        return len(self.keys), sum(len(k) + v.length for k, v in zip(self.keys, self.values, strict=True))

    @property
    def logical_length(self) -> int:
        return HEADER + sum(self.costs())

    def costs(self) -> list[int]:
        if self.level:
            return [branch_cost(len(k)) for k in self.keys]
        return [leaf_cost(len(k), len(v.stored)) for k, v in zip(self.keys, self.values, strict=True)]

    def encode(self) -> bytes:
        if self.level and not self.keys:
            raise BuildError("WrongKind")
        if len(self.keys) > 0xFFFF:
            raise BuildError("TooManyEntries")
        for i, key in enumerate(self.keys):
            if len(key) > MAX_KEY:
                raise BuildError("KeyTooLong")
            if i and self.keys[i - 1] >= key:
                raise BuildError("NotSorted")
        for v in self.values:
            if not v.is_ref and len(v.inline) > MAX_INLINE or v.length > MAX_VALUE:
                raise BuildError("ValueTooLong")
            if v.is_ref and v.length <= MAX_INLINE:
                raise BuildError("ValueTooShort")
        if self.logical_length + REF * len(self.parity) > MAX_NODE:
            raise BuildError("NodeTooLarge")
        count, size = self.agg
        if count >= 1 << 64 or size >= 1 << 64:
            raise BuildError("Overflow")
        n = len(self.keys)
        shared = 0 if not n else len(self.keys[0]) if n == 1 else common_prefix(self.keys[0], self.keys[-1])
        bodies = []
        for i, key in enumerate(self.keys):
            suffix = key[shared:]
            if self.level:
                cid, c, b = self.children[i]
                bodies.append(struct.pack("<H", len(suffix)) + cid + struct.pack("<QQ", c, b) + suffix)
            else:
                v = self.values[i]
                bodies.append(struct.pack("<HBI", len(suffix), v.is_ref, v.length) + suffix + v.stored)
        at, offsets = HEADER + shared + 6 * n, []
        for body in bodies:
            offsets.append(at)
            at += len(body)
        return b"".join([
            MAGIC, struct.pack("<BBHQQHH", self.level, 0, n, count, size, len(self.parity), shared), self.keys[0][:shared] if n else b"",
            struct.pack(f"<{n}H", *offsets), struct.pack(f">{n}I", *[key4(k[shared:]) for k in self.keys]), *bodies, *self.parity])


def leaf_cost(key: int, stored: int) -> int:
    return 6 + LEAF_FIXED + key + stored


def branch_cost(key: int) -> int:
    return 6 + BRANCH_FIXED + key


def parse(data: bytes) -> Node:
    """The node in ``data``, or NodeError: accepts exactly what Node.encode makes."""
    size = len(data)
    if size < HEADER:
        raise NodeError("TooShort")
    if size > MAX_NODE:
        raise NodeError("TooLarge")
    if data[:4] != MAGIC:
        raise NodeError("BadMagic")
    level, flags, count, agg_count, agg_bytes, n_parity, shared = struct.unpack_from("<BBHQQHH", data, 4)
    if flags:
        raise NodeError("BadFlags")
    if n_parity > MAX_PCOUNT or (level and not count):
        raise NodeError("BadShape")
    if shared > MAX_KEY:
        raise NodeError("KeyTooLong")
    if not count and shared:
        raise NodeError("BadShape")
    table = HEADER + shared
    start, end = table + 6 * count, size - REF * n_parity
    if start > end:
        raise NodeError("TooShort")
    offsets, heads = struct.unpack_from(f"<{count}H", data, table), struct.unpack_from(f">{count}I", data, table + 2 * count)
    prefix, node, at = data[HEADER:table], Node(level, []), start
    total = [0, 0]
    last = None
    for i in range(count):
        if offsets[i] != at:
            raise NodeError("BadTiling" if start <= offsets[i] < end else "OffsetOutOfRange")
        fixed = BRANCH_FIXED if level else LEAF_FIXED
        if at + fixed > end:
            raise NodeError("BadEntry")
        klen = struct.unpack_from("<H", data, at)[0]
        key_at = at + fixed
        if level:
            child = (data[at + 2:at + 34], *struct.unpack_from("<QQ", data, at + 34))
            stop, add = key_at + klen, child[1:]
        else:
            kind, length = struct.unpack_from("<BI", data, at + 2)
            if kind > 1:
                raise NodeError("BadEntry")
            if (kind == 0) != (length <= MAX_INLINE) or length > MAX_VALUE:
                raise NodeError("NonCanonicalValue")
            stop, add = key_at + klen + (REF if kind else length), (1, shared + klen + length)
        if stop > end:
            raise NodeError("BadEntry")
        if shared + klen > MAX_KEY:
            raise NodeError("KeyTooLong")
        suffix = data[key_at:key_at + klen]
        if last is not None and last >= suffix:
            raise NodeError("KeysNotSorted")
        if heads[i] != key4(suffix):
            raise NodeError("BadKeyPrefix")
        total = [total[0] + add[0], total[1] + add[1]]
        if max(total) >= 1 << 64:
            raise NodeError("Overflow")
        node.keys.append(prefix + suffix)
        if level:
            node.children.append(child)
        else:
            stored = data[key_at + klen:stop]
            node.values.append(Value(None, stored, length) if kind else Value(stored, None, length))
        last, at = suffix, stop
    if at != end:
        raise NodeError("TrailingBytes")
    if total != [agg_count, agg_bytes]:
        raise NodeError("AggMismatch")
    if count and (len(node.keys[0]) if count == 1 else common_prefix(node.keys[0], node.keys[-1])) != shared:
        raise NodeError("NonCanonicalPrefix")
    node.parity = [data[i:i + REF] for i in range(end, size, REF)]
    return node


def try_parse(data: bytes) -> tuple[Node | None, str | None]:
    """(node, None) or (None, the reason's name)."""
    try:
        return parse(data), None
    except NodeError as e:
        return None, e.kind


EMPTY = Node(0, []).encode()
EMPTY_ROOT = block_id(TREE_NODE, EMPTY)
