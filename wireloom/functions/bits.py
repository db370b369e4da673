"""Bit patterns of floats and doubles, which SQL has no function for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _view(column: pa.Array, source: type, through: type, goal: type) -> pa.Array:
    null = np.asarray(column.is_null())
    values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(source)
    return pa.array(values.view(through).astype(goal), mask=null)


@F.arrow_udf(T.FloatType())
def float_of(bits: pa.Array) -> pa.Array:
    """The float whose bits are the low 32 of a long."""
    return _view(bits, np.uint32, np.float32, np.float32)


@F.arrow_udf(T.DoubleType())
def double_of(bits: pa.Array) -> pa.Array:
    return _view(bits, np.int64, np.float64, np.float64)


@F.arrow_udf(T.LongType())
def float_bits(values: pa.Array) -> pa.Array:
    return _view(values, np.float32, np.uint32, np.int64)


@F.arrow_udf(T.LongType())
def double_bits(values: pa.Array) -> pa.Array:
    return _view(values, np.float64, np.int64, np.int64)


def reading(kind: str, field: Column) -> Column:
    """A field's value as a scalar type; null where its wire type is another one.

    32-bit types read from varints take the low 32 bits.
    """
    from .varint import low32, zigzag_decode

    v, a, b = field["varint"], field["fixed32"], field["fixed64"]
    return {
        "uint64": lambda: v, "int64": lambda: v, "uint32": lambda: low32(v), "int32": lambda: low32(v, True),
        "sint64": lambda: zigzag_decode(v), "sint32": lambda: zigzag_decode(low32(v), 32).cast("int"), "bool": lambda: v != 0,
        "fixed32": lambda: a, "sfixed32": lambda: low32(a, True), "float": lambda: float_of(a),
        "fixed64": lambda: b, "sfixed64": lambda: b, "double": lambda: double_of(b),
        "bytes": lambda: F.when(field["wire_type"] == 2, field["bytes"]), "string": lambda: F.when(field["wire_type"] == 2, field["bytes"].cast("string")),
        "group": lambda: F.when(field["wire_type"] == 3, field["bytes"]),
    }[kind]()
