"""Keys and values: order-preserving encodings, prefixes, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed limits of the format.
MAX_KEY, MAX_INLINE, MAX_VALUE, REFERENCE = 512, 1024, 256 * 1024, 32
CLASSES = (4096, 16384, 65536, 262144)


def successor(prefix: bytes) -> bytes | None:
    """The least key above every key with this prefix; None when there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def common_prefix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def key4(suffix: bytes) -> int:
    return int.from_bytes(suffix[:4].ljust(4, b"\0"), "big")


def be64(col: Column) -> Column:
    """8 big-endian bytes of a non-negative integer: byte order is number order."""
    return F.unhex(F.lpad(F.hex(col.cast("long")), 16, "0"))


def signed_be64(col: Column) -> Column:
    """The same for any integer: the sign bit is flipped."""
    return be64_bits(col.cast("long").bitwiseXOR(F.lit(-(1 << 63))))


def be64_bits(col: Column) -> Column:
    return F.unhex(F.lpad(F.hex(col), 16, "0"))


def prefixed(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix.encode()), *parts)


def is_reference(value: Column) -> Column:
    return F.octet_length(value) > MAX_INLINE


def stored_length(value: Column) -> Column:
    """Bytes that a value takes in its leaf, and on a page: its length, or a reference's."""
    return F.when(is_reference(value), F.lit(REFERENCE)).otherwise(F.octet_length(value))


def entry_cost(key: Column, value: Column) -> Column:
    """What an entry costs on a page."""
    return F.octet_length(key) + stored_length(value)


def leaf_cost(key: Column, value: Column) -> Column:
    """What an entry adds to a leaf's logical length."""
    return F.lit(13) + F.octet_length(key) + stored_length(value)


def size_class(length: Column) -> Column:
    """0..3 for referenced values, null for inline ones."""
    out = F.when(length <= MAX_INLINE, F.lit(None).cast("int"))
    for i, top in enumerate(CLASSES):
        out = out.when(length <= top, F.lit(i))
    return out


def class_of(length: int) -> int:
    return next(i for i, top in enumerate(CLASSES) if length <= top)
