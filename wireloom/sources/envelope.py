"""Envelopes: frames of one flag byte, a big-endian length and a payload, one behind another."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import buffers, gather

FRAME = T.StructType([T.StructField(n, T.BinaryType() if n == "payload" else T.IntegerType()) for n in ("idx", "flags", "header_offset", "payload_offset", "payload_len", "payload")])
FRAMES = T.StructType([T.StructField("frames", T.ArrayType(FRAME)), T.StructField("error", T.StringType())])
HEADER = 5
#: Ways to read a compressed payload, in the order of trial: name and zlib's window bits.
FORMATS = {"gzip": 31, "deflate": 15, "deflate-raw": -15}


def _frames_batch(column: pa.Array) -> pa.Array:
    """The frames of all envelopes of a batch in step: step k reads the k-th header of each."""
    data, bounds, null = buffers(column)
    padded, n = np.append(data, np.zeros(HEADER, np.uint8)).astype(np.int64), len(column)
    row = np.flatnonzero(~null)
    at, stop = bounds[row], bounds[row + 1]
    errors: list[str | None] = [None] * n
    for r in row[at == stop].tolist():
        errors[r] = "no bytes"
    row, at, stop = (x[at < stop] for x in (row, at, stop))
    found, k = [], 0
    while len(row):
        left = stop - at
        size = sum(padded[np.minimum(at + 1 + i, len(padded) - 1)] << 8 * (3 - i) for i in range(4))
        short, cut = left < HEADER, left - HEADER < size
        for r, x in zip(row[short].tolist(), left[short].tolist(), strict=True):
            errors[r] = f"frame {k} has {x} of {HEADER} header bytes"
        for r, x, y in zip(*(v[~short & cut].tolist() for v in (row, size, left)), strict=True):
            errors[r] = f"frame {k} declares {x} byte(s); {y - HEADER} are left"
        good = ~short & ~cut
        found.append((row[good], np.full(int(good.sum()), k), padded[at[good]], at[good], size[good]))
        row, at, stop, k = row[good], at[good] + HEADER + size[good], stop[good], k + 1
        row, at, stop = (x[at < stop] for x in (row, at, stop))
    row, idx, flags, at, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
    bad = np.array([e is not None for e in errors], bool)
    order = np.lexsort((idx, row))
    order = order[~bad[row[order]]]
    row, idx, flags, at, size = (x[order] for x in (row, idx, flags, at, size))
    base = bounds[:-1][row]
    ints = [pa.array(x.astype(np.int32)) for x in (idx, flags, at - base, at - base + HEADER, size)]
    cells = pa.StructArray.from_arrays([*ints, gather(data, at + HEADER, at + HEADER + size)], names=FRAME.names)
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), cells, mask=pa.array(bad))
    return pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], names=FRAMES.names, mask=pa.array(null))


@F.arrow_udf(FRAMES)
def _frames(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        yield _frames_batch(column)


def frames(msg: Column | str) -> Column:
    """struct<frames, error>; on an error there are no frames."""
    return _frames(F.col(msg) if isinstance(msg, str) else msg)


def is_compressed(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(1)) != 0


def is_json(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(2)) != 0


def frame_rows(df: DataFrame, msg: str = "msg", keep: list[str] | None = None) -> DataFrame:
    """One row per frame of each envelope."""
    keep = [c for c in df.columns if c != msg] if keep is None else keep
    rows = df.select(*keep, frames(msg).alias("e")).select(*keep, F.inline("e.frames"))
    return rows.withColumns({"compressed": is_compressed(F.col("flags")), "json": is_json(F.col("flags"))})


def preferred(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The frame to look at: the first plain one, else the first that isn't compressed, else the first."""
    rank = F.struct(F.col("compressed"), F.col("compressed") | F.col("json"), F.col("idx"))
    return rows.groupBy(*keys).agg(F.min_by("idx", rank).alias("idx"))


def frame(flags: Column, payload: Column) -> Column:
    """The bytes of a frame."""
    size = F.lpad(F.hex(F.length(payload)), 8, "0")
    return F.concat(F.unhex(F.lpad(F.hex(flags), 2, "0")), F.unhex(size), payload)


def _inflate(first: str | None):
    order = [f for f in ([first] if first in FORMATS else []) + list(FORMATS)]

    def inflate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for b in column:
                raw = b.as_py()
                got = None if raw is None else {"payload": raw, "format": None}
                for name in order if raw is not None else []:
                    try:
                        box = zlib.decompressobj(FORMATS[name])
                        data = box.decompress(raw) + box.flush()
                        if box.eof:
                            got = {"payload": data, "format": name}
                            break
                    except zlib.error:
                        pass
                out.append(got)
            yield pa.array(out, pa.struct([("payload", pa.binary()), ("format", pa.string())]))

    inflate.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(inflate, T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("format", T.StringType())]))


def decompress(payload: Column | str, first: str | None = None) -> Column:
    """struct<payload, format>: the first format that reads it whole; none leaves it as it is, format null.

    Brotli can't be read here; such payloads come back as they are.
    """
    return _inflate(first)(F.col(payload) if isinstance(payload, str) else payload)


def compress(payload: Column | str, format: str = "gzip") -> Column:
    """Payloads compressed in one of FORMATS, with a header that doesn't depend on the time."""
    bits = FORMATS[format]

    def deflate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for b in column:
                box = zlib.compressobj(6, zlib.DEFLATED, bits)
                out.append(None if not b.is_valid else box.compress(b.as_py()) + box.flush())
            yield pa.array(out, pa.binary())

    deflate.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(deflate, T.BinaryType())(F.col(payload) if isinstance(payload, str) else payload)


def gzip(payload: Column | str) -> Column:
    return compress(payload, "gzip")


def from_references(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """refs (ref_id, source_id, modified_ms, start, size) with their bytes.

    A reference is good while its source has the modified_ms that it was made
    at; others have null bytes.
    """
    src = sources.select(F.col("id").alias("source_id"), F.col("modified_ms").alias("_now"), F.col("msg").alias("_src"))
    got = refs.join(src, "source_id", "left")
    ok = F.col("_now") == F.col("modified_ms")
    return got.withColumn("payload", F.when(ok, F.substring("_src", F.col("start") + 1, F.col("size")))).drop("_now", "_src")


def classify(msg: Column | str, decoded: Column) -> Column:
    """protobuf, envelope or raw: the first that the bytes are; decoded is their cursor."""
    return F.when(decoded["error"].isNull(), "protobuf").when(frames(msg)["error"].isNull(), "envelope").otherwise("raw")
