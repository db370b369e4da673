"""A bit filter of fixed size over 64-bit hashes.

It spares rows a join: what it lets through is joined, what it stops can't
match. Its size is a constant, whatever it is made of; a full filter lets all
through, and results are the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def make(hashes: DataFrame, column: str) -> bytes:
    """The filter of a column of longs; at most BITS bits come to the driver, as words of 32."""
    bit = F.pmod(F.col(column), F.lit(BITS))  # a power of two: as for the unsigned number
    words = hashes.select(bit.alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("v")).toArrow()
    bits = np.zeros(BITS // 32, np.uint32)
    bits[words["w"].to_numpy()] = words["v"].to_numpy().astype(np.uint32)
    return bits.tobytes()


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes % np.uint64(BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
