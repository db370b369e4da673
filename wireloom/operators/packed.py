"""Packed arrays: payloads that are runs of varints or fixed values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.varint import col, little_endian, low32, varint_encode, zigzag_decode, zigzag_encode

#: Bytes of a varint at most and the greatest last byte, or the size of a fixed type.
VARINTS = {"uint32": (5, 0x0F), "int32": (5, 0x0F), "sint32": (5, 0x0F), "bool": (5, 0x0F), "uint64": (10, 0x01), "int64": (10, 0x01), "sint64": (10, 0x01)}
FIXED = {"fixed32": "<u4", "sfixed32": "<i4", "float": "<f4", "fixed64": "<i8", "sfixed64": "<i8", "double": "<f8"}


def _read(kind: str):
    real = kind in ("float", "double")
    out = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType() if real else T.LongType())), T.StructField("error", T.IntegerType())])

    def rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        return data[at[0] : at[-1]], at - at[0]

    def varints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of all rows, their bounds, and the place of each row's first bad element (or -1)."""
        most, top = VARINTS[kind]
        n_rows = len(at) - 1
        stop = data < 0x80
        stop_here = stop.copy()
        stop_here[at[1:][at[1:] > at[:-1]] - 1] = True  # a row's end cuts an element off
        ends = np.flatnonzero(stop_here) + 1
        row = np.searchsorted(at, ends - 1, "right") - 1
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - starts
        bad = ~stop[ends - 1] | (size > most) | ((size == most) & (data[ends - 1] > top))
        error = np.full(n_rows, -1)
        first = np.flatnonzero(bad)[::-1]
        error[row[first]] = starts[first] - at[row[first]]
        good = (error[row] < 0) | (starts - at[row] < error[row])
        starts, size, row = starts[good], size[good], row[good]
        value = np.zeros(len(starts), np.uint64)
        for i in range(int(size.max(initial=0))):
            value |= np.where(i < size, data[np.minimum(starts + i, len(data) - 1)] & 0x7F, 0).astype(np.uint64) << np.uint64(7 * i)
        return value.view(np.int64), np.searchsorted(row, np.arange(n_rows + 1)), error

    def read(column: pa.Array) -> pa.Array:
        null = np.asarray(column.is_null())
        if not len(column):
            return pa.array([], pa.struct([("values", pa.list_(pa.float64() if real else pa.int64())), ("error", pa.int32())]))
        data, at = rows(column)
        if kind in VARINTS:
            values, bounds, error = varints(data, at)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
        else:
            width = int(FIXED[kind][-1])
            size = np.diff(at)
            error = np.where(size % width, size // width * width, -1)
            size = np.where(error >= 0, 0, size)
            bounds = np.concatenate([[0], np.cumsum(size // width)])
            if len(data) and (error < 0).all():
                values = data.copy().view(FIXED[kind])
            else:
                keep = np.repeat(error < 0, np.diff(at))
                values = data[keep].copy().view(FIXED[kind])
            # A payload of the wrong size has no values at all.
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.float64 if real else np.int64)), mask=pa.array(error >= 0))
        return pa.StructArray.from_arrays([lists, pa.array(error.astype(np.int32), mask=error < 0)], names=["values", "error"], mask=pa.array(null))

    # Not one over batches: Spark puts all such functions of a query in one worker, where each of those has its own.
    read.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, out)


def packed(payload: Column | str, kind: str) -> Column:
    """struct<values, error> of a payload read as a packed array of a scalar type.

    error is the offset of the first bad element, after which nothing is read.
    A fixed array whose size doesn't fit has no values, and its error is where
    the last whole element ends. Varints of 32-bit types are read as 32 bits.
    """
    got = _read(kind)(col(payload))
    change = {"int32": lambda v: low32(v, True).cast("long"), "sint32": lambda v: zigzag_decode(v, 32), "sint64": lambda v: zigzag_decode(v), "bool": lambda v: (v != 0).cast("long")}.get(kind)
    if not change:
        return got
    return F.when(got.isNotNull(), F.struct(F.transform(got["values"], change).alias("values"), got["error"].alias("error")))


def packed_element(value: Column | str, kind: str) -> Column:
    """The bytes of one element; a negative int32 takes its 5-byte form."""
    v = col(value)
    if kind in ("uint32", "int32"):
        return varint_encode(low32(v))
    if kind in ("sint32", "sint64"):
        return varint_encode(zigzag_encode(v, 32 if kind == "sint32" else 64))
    if kind == "bool":
        return varint_encode(F.when(v.cast("boolean"), 1).otherwise(0))
    if kind in ("fixed32", "sfixed32"):
        return little_endian(v, 4)
    if kind in ("fixed64", "sfixed64"):
        return little_endian(v, 8)
    return varint_encode(v)


def push(payload: Column | str, value: Column | str, kind: str) -> Column:
    """A packed payload with one more element."""
    return F.concat(col(payload), packed_element(value, kind))
