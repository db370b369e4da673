"""Field numbers, wire types and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .varint import col, varint_decode, varint_encode

#: Fixed values of the wire format.
VARINT, I64, LEN, SGROUP, EGROUP, I32 = 0, 1, 2, 3, 4, 5
WIRE_TYPES = {"varint": VARINT, "i64": I64, "len": LEN, "sgroup": SGROUP, "egroup": EGROUP, "i32": I32}
MAX_FIELD_NUMBER = (1 << 29) - 1
MAX_MESSAGE = (1 << 31) - 1


def field_number(n: int) -> int:
    """n, checked when the plan is built."""
    if not 1 <= n <= MAX_FIELD_NUMBER:
        raise ValueError(f"field number {n} is outside 1..{MAX_FIELD_NUMBER}")
    return n


def tag(n: int, wire_type: str | int) -> int:
    """The raw tag of a field number and a wire type, by name or number."""
    kind = WIRE_TYPES[wire_type] if isinstance(wire_type, str) else wire_type
    if kind not in WIRE_TYPES.values():
        raise ValueError(f"no wire type {wire_type!r}")
    return field_number(n) << 3 | kind


def path(*steps: tuple[int, str | int]) -> tuple[int, ...]:
    """Tags from the root to a field: path((3, "len"), (1, "varint"))."""
    return tuple(tag(n, kind) for n, kind in steps)


def valid_field_number(n: Column | str) -> Column:
    return F.when(col(n).between(1, MAX_FIELD_NUMBER), col(n))


def valid_wire_type(t: Column | str, groups: bool = False) -> Column:
    low = col(t).bitwiseAND(F.lit(7))
    return F.when(low.isin(0, 1, 2, 5, *((3, 4) if groups else ())), low)


def valid_tag(t: Column | str, groups: bool = False) -> Column:
    """The raw tag, or null where its field number or wire type is none."""
    t = col(t).cast("long")
    return F.when(t.between(8, 0xFFFFFFFF) & valid_wire_type(t, groups).isNotNull(), t)


def make_tag(n: Column | str, wire_type: Column | str, groups: bool = False) -> Column:
    n, w = col(n).cast("long"), col(wire_type).cast("long")
    return F.when(w.between(0, 7) & valid_field_number(n).isNotNull(), valid_tag(F.shiftleft(n, 3).bitwiseOR(w), groups))


def tag_number(t: Column | str) -> Column:
    return F.shiftrightunsigned(col(t).cast("long"), 3).cast("int")


def tag_wire_type(t: Column | str) -> Column:
    return col(t).cast("long").bitwiseAND(F.lit(7)).cast("int")


def encode_tag(t: Column | str) -> Column:
    return varint_encode(t)


def decode_tag(b: Column | str, groups: bool = False) -> Column:
    """struct<tag, used> of the tag that b begins with, or null."""
    got = varint_decode(b, 32)
    return F.when(valid_tag(got["value"], groups).isNotNull(), F.struct(got["value"].alias("tag"), got["used"].alias("used")))
