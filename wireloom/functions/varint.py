"""Varints and zigzag as Column expressions; longs carry unsigned 64-bit values bit by bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32_BYTES, U64_BYTES = 5, 10


def col(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x).cast("long") if isinstance(x, int) else x


def byte_lit(x: int) -> Column:
    return F.lit(bytes([x]))


def in_range(v: Column | str, width: int) -> Column:
    """v, or null where it is no unsigned number of 32 bits; all 64-bit patterns are fine."""
    v = col(v).cast("long")
    return F.when(v.between(0, 0xFFFFFFFF), v) if width == 32 else v


def varint_len(v: Column | str, width: int = 64) -> Column:
    """Bytes of the varint of a value: 1 to 10, or 1 to 5 for 32 bits, and null beyond these."""
    bits = F.length(F.bin(in_range(v, width)))
    return F.shiftright(bits * 9, 6) + 1


def _groups(x: Column, first: int, n: int) -> Column:
    """n groups of seven bits from group first on, a byte each, the first in the highest of n bytes; no flags."""
    out = None
    for i in range(n):
        part = F.shiftleft(F.shiftrightunsigned(x, 7 * (first + i)).bitwiseAND(F.lit(127).cast("long")), 8 * (n - 1 - i))
        out = part if out is None else out.bitwiseOR(part)
    return out


def _bytes_of(x: Column, n: int) -> Column:
    """The low n bytes of a long, highest first."""
    return F.unhex(F.lpad(F.hex(x), 2 * n, "0"))


def varint_encode(v: Column | str, width: int = 64) -> Column:
    """Canonical varint bytes of a value; null for null, and for what isn't of 32 bits if width says so."""
    x = in_range(v, width)
    out = None
    for n in range(U64_BYTES, 8, -1):
        head = _bytes_of(_groups(x, 0, 8).bitwiseOR(F.lit(-0x7F7F7F7F7F7F7F80)), 8)
        tail = _bytes_of(_groups(x, 8, n - 8).bitwiseOR(F.lit(0x8000 if n == 10 else 0).cast("long")), n - 8)
        got = F.concat(head, tail)
        out = got if out is None else F.when(F.shiftrightunsigned(x, 7 * n) == 0, got).otherwise(out)
    for n in range(8, 0, -1):
        flags = sum(0x80 << 8 * i for i in range(1, n))
        flags -= (1 << 64) if flags >= 1 << 63 else 0
        got = _bytes_of(_groups(x, 0, n).bitwiseOR(F.lit(flags).cast("long")), n)
        out = F.when(F.shiftrightunsigned(x, 7 * n) == 0, got).otherwise(out)
    return out


def bound(value: Column, build) -> Column:
    """build(value) with value computed once, however often build mentions it."""
    return F.element_at(F.transform(F.array(value), build), 1)


def varint_decode(b: Column | str, width: int = 64) -> Column:
    """struct<value, used> of the varint that b begins with; null if it is cut off or too wide.

    Zero-padded encodings are fine. value holds the bits of an unsigned number.
    """
    most, top = (U32_BYTES, 0x0F) if width == 32 else (U64_BYTES, 0x01)

    def build(x: Column) -> Column:
        size = F.least(F.length(x), F.lit(most))
        numbers = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.conv(F.hex(F.substring(x, i, F.lit(1))), 16, 10).cast("long"))
        used = F.array_position(F.transform(numbers, lambda n: n < 128), True).cast("int")
        last = F.element_at(numbers, F.when(used > 0, used).otherwise(1))
        ok = (F.length(x) > 0) & (used > 0) & ((used < most) | (last <= top))
        bits = F.transform(F.slice(numbers, F.lit(1), F.greatest(used, F.lit(1))), lambda n, i: F.call_function("shiftleft", n.bitwiseAND(F.lit(127)), (i * 7).cast("int")))
        value = F.aggregate(bits, F.lit(0).cast("long"), lambda a, n: a.bitwiseOR(n))
        return F.when(ok, F.struct(value.alias("value"), used.alias("used")))

    return bound(col(b), build)


def bool_decode(b: Column | str) -> Column:
    """The first byte as a bool; null unless it is 0 or 1."""
    first = F.hex(F.substring(col(b), 1, 1))
    return F.when(first == "00", False).when(first == "01", True)


def zigzag_encode(v: Column | str, width: int = 64) -> Column:
    v = col(v).cast("long")
    if width == 32:
        return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 31)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def zigzag_decode(u: Column | str, width: int = 64) -> Column:
    u = col(u).cast("long")
    if width == 32:
        u = u.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(u, 1).bitwiseXOR(F.negate(u.bitwiseAND(F.lit(1))))


def unsigned(v: Column | str) -> Column:
    """The bits of a long as DECIMAL(20,0)."""
    return F.conv(F.hex(col(v).cast("long")), 16, 10).cast("decimal(20,0)")


def low32(v: Column | str, signed: bool = False) -> Column:
    """The low 32 bits of a long, unsigned (BIGINT) or signed (INT)."""
    low = col(v).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(F.shiftleft(low, 32), 32).cast("int") if signed else low


def little_endian(v: Column | str, size: int) -> Column:
    """The low bytes of a long, least first."""
    v = col(v).cast("long")
    out = None
    for i in range(size):
        part = F.shiftleft(F.shiftrightunsigned(v, 8 * i).bitwiseAND(F.lit(255).cast("long")), 8 * (size - 1 - i))
        out = part if out is None else out.bitwiseOR(part)
    return _bytes_of(out, size)
