"""Messages from columns, as expressions.

A field is a pair of expressions, its bytes and their number, so that a length
is known without building bytes. Nested bodies are bound once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import I32, I64, LEN, MAX_MESSAGE, SGROUP, VARINT, tag
from .varint import bound, col, little_endian, varint_encode, varint_len, zigzag_encode

MAX_DEPTH = 100


class DepthLimitExceeded(ValueError):
    """Messages are nested deeper than MAX_DEPTH."""


def _varint_bytes(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


@dataclass(frozen=True)
class Field:
    """One field of a message; null where its value is null, and then left out."""

    data: Column
    size: Column
    depth: int = 0


def _field(number: int, kind: int, data: Column, size: Column, depth: int = 0) -> Field:
    head = _varint_bytes(tag(number, kind))
    return Field(F.concat(F.lit(head), data), size + len(head), depth)


def varint(number: int, v: Column | str | int) -> Field:
    """uint64, int64 and (sign-extended) int32: the 64 bits of v."""
    v = col(v).cast("long")
    return _field(number, VARINT, varint_encode(v), varint_len(v))


def boolean(number: int, v: Column | str) -> Field:
    return varint(number, F.when(col(v), 1).when(~col(v), 0))


def sint(number: int, v: Column | str, width: int = 64) -> Field:
    return varint(number, zigzag_encode(v, width))


def fixed32(number: int, v: Column | str | int) -> Field:
    return _field(number, I32, little_endian(col(v), 4), F.lit(4))


def fixed64(number: int, v: Column | str | int) -> Field:
    return _field(number, I64, little_endian(col(v), 8), F.lit(8))


def _delimited(number: int, body: Column, size: Column, depth: int = 0) -> Field:
    data = bound(body, lambda b: F.concat(varint_encode(F.length(b)), b))
    return _field(number, LEN, data, size + varint_len(size), depth)


def binary(number: int, v: Column | str) -> Field:
    v = col(v)
    return _delimited(number, v, F.length(v))


def string(number: int, v: Column | str) -> Field:
    return binary(number, col(v).cast("binary"))


def _body(fields: Sequence[Field]) -> tuple[Column, Column]:
    empty = F.lit(b"")
    data = F.concat(*[F.coalesce(f.data, empty) for f in fields]) if fields else empty
    size = F.lit(0).cast("long")
    for f in fields:
        size = size + F.coalesce(f.size, F.lit(0))
    return data, size


def message(number: int, fields: Sequence[Field]) -> Field:
    """A nested message; of no fields, an empty one."""
    depth = 1 + max((f.depth for f in fields), default=0)
    if depth > MAX_DEPTH:
        raise DepthLimitExceeded(f"nesting of {depth} levels; the limit is {MAX_DEPTH}")
    data, size = _body(fields)
    return _delimited(number, data, size, depth)


def group(number: int, fields: Sequence[Field]) -> Field:
    data, size = _body(fields)
    end = _varint_bytes(tag(number, "egroup"))
    return _field(number, SGROUP, F.concat(data, F.lit(end)), size + len(end), 1 + max((f.depth for f in fields), default=0))


def packed(number: int, values: Column | str, one) -> Field:
    """A packed array: one(x) gives the bytes of an element."""
    body = concat_all(F.transform(col(values), one))
    return _delimited(number, body, F.length(body))


def concat_all(parts: Column) -> Column:
    """The parts of an array of binaries as one."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))


def repeated_messages(number: int, bodies: Column | str) -> Field:
    """A field for each body of an array of encoded messages, in its order."""
    head = F.lit(_varint_bytes(tag(number, LEN)))
    data = bound(concat_all(F.transform(col(bodies), lambda b: F.concat(head, varint_encode(F.length(b)), b))), lambda b: b)
    return Field(data, F.length(data))


def encode_message(fields: Sequence[Field], guard: bool = False) -> Column:
    """The bytes of a message; fields whose value is null are left out.

    guard computes the length first and fails with LengthOverflow over 2**31 - 1 bytes.
    """
    data, size = _body(fields)
    return F.when(_guarded(size) >= 0, data) if guard else data


def _guarded(size: Column) -> Column:
    size = size.cast("long")
    return F.when(size > MAX_MESSAGE, F.raise_error(F.concat(F.lit("LengthOverflow: "), size.cast("string"))).cast("long")).otherwise(size)


def encode_into(prefix: Column | str, fields: Sequence[Field]) -> Column:
    return F.concat(col(prefix), encode_message(fields))


def encoded_len(fields: Sequence[Field]) -> Column:
    """The length of encode_message(fields), without building it; over 2**31 - 1 it fails with LengthOverflow."""
    return _guarded(_body(fields)[1]).cast("int")
