"""Look-ups in decoded messages: on the array of fields, and on rows of fields."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tags import LEN, SGROUP, tag
from ..sources.fields import _Bytes, buffers, decode_spans, slices


def all_of(fields: Column, t: int) -> Column:
    """The fields with a tag, in their order."""
    return F.filter(fields, lambda f: f["tag"] == t)


def all_by_parts(fields: Column, number: int, wire_type: str | int) -> Column:
    return all_of(fields, tag(number, wire_type))


def all_by_number(fields: Column, number: int) -> Column:
    """The fields of a number, whatever their wire types."""
    return F.filter(fields, lambda f: f["field_number"] == number)


def first(fields: Column, t: int) -> Column:
    return F.try_element_at(all_of(fields, t), F.lit(1))


def last(fields: Column, t: int) -> Column:
    return F.try_element_at(all_of(fields, t), F.lit(-1))


def nth(fields: Column, i: int) -> Column:
    return F.try_element_at(fields, F.lit(i + 1))


def has(fields: Column, t: int) -> Column:
    return F.exists(fields, lambda f: f["tag"] == t)


def bucket(fields: Column, t: int) -> Column:
    """struct<head, tail, n>: places of the first and last field of a tag, and how many there are."""
    mine = F.transform(all_of(fields, t), lambda f: f["ord"])
    return F.when(F.size(mine) > 0, F.struct(F.array_min(mine).alias("head"), F.array_max(mine).alias("tail"), F.size(mine).alias("n")))


def without(fields: Column, dead: Column) -> Column:
    """The fields whose places aren't in the array dead."""
    return F.filter(fields, lambda f: ~F.array_contains(dead, f["ord"]))


def to_bytes(fields: Column) -> Column:
    """Re-encodes fields in their order: tags in canonical form, the rest as it was."""
    from ..functions.encode import concat_all
    from ..functions.varint import varint_encode

    return concat_all(F.transform(fields, lambda f: F.concat(varint_encode(f["tag"]), F.substring(f["raw"], f["tag_end"] - f["offset"] + 1, F.length(f["raw"])))))


def wire_stats(fields: Column) -> Column:
    """How many fields there are of each wire type."""

    def n(kind: int) -> Column:
        return F.size(F.filter(fields, lambda f: f["wire_type"] == kind))

    return F.struct(F.size(fields).alias("fields"), n(0).alias("varints"), n(5).alias("fixed32s"), n(1).alias("fixed64s"), n(2).alias("lendels"), n(3).alias("groups"))


def with_occurrence(rows: DataFrame, keys: list[str], by: str = "field_number") -> DataFrame:
    """Adds occurrence: how many fields of the same number (or tag) come before in the message."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, by).orderBy("ord")) - 1)


def assemble(rows: DataFrame, keys: list[str], data: str = "raw", order: str = "ord") -> DataFrame:
    """Rows of field bytes back to messages: keys and msg, in the given order.

    One message's fields meet in a task; a message is bounded by its own 2 GB limit.
    """
    from ..functions.encode import concat_all

    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
    return rows.groupBy(*keys).agg(parts.alias("_parts")).select(*keys, concat_all(F.transform("_parts", lambda p: p["d"])).alias("msg"))


#: What lies at a byte: places in the message; path has the ords of the fields from the root down.
PLACE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("byte", "depth", "field_number", "wire_type", "begin", "end")] + [T.StructField("path", T.ArrayType(T.IntegerType()))])


def _deepest(column: pa.Array, places: pa.Array, tags: Sequence[int] | None, groups: bool) -> pa.Array:
    """For each place of each message: the deepest field there; payloads are entered where places lead, all in step."""
    data, bounds, null = buffers(column)
    flat, row = places.flatten(), np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False))
    asked = ~null[row] & np.asarray(flat.is_valid(), bool).reshape(len(flat))
    row, byte = row[asked], pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64)[asked]
    begin, stop = bounds[:-1][row], bounds[1:][row]
    at, width = byte + begin, len(data) + 1
    live = np.flatnonzero((byte >= 0) & (at < stop))
    best, met, b = np.full((4, len(row)), -1), [(live[:0], live[:0])], _Bytes(data)
    depth = 0
    while len(live):
        spans, own = np.unique(begin[live] * width + stop[live], return_inverse=True)
        u = decode_spans(b, spans // width, spans % width, groups)
        good = u.bad[own] == 0  # what doesn't decode is no message
        live, own = live[good], own[good]
        f = np.searchsorted(u.span * width + u.at, own * width + at[live], "right") - 1
        best[:, live] = np.stack([np.full(len(f), depth), u.tag[f], u.at[f], u.after[f]])
        met.append((live, u.ord[f]))
        go = ((u.kind[f] == LEN) | (u.kind[f] == SGROUP)) & (at[live] >= u.start[f]) & (at[live] < u.end[f])
        if tags is not None:
            go &= np.isin(u.tag[f], tags)
        live, f = live[go], f[go]
        begin[live], stop[live], depth = u.start[f], u.end[f], depth + 1
    some, base = best[0] >= 0, bounds[:-1][row]
    place, ords = (np.concatenate(x) for x in zip(*met, strict=True))
    order = np.argsort(place, kind="stable")  # levels came one after another
    paths = pa.ListArray.from_arrays(pa.array(np.searchsorted(place[order], np.append(np.flatnonzero(some), len(row))).astype(np.int32)), pa.array(ords[order].astype(np.int32)))
    cells = [byte, best[0], best[1] >> 3, best[1] & 7, best[2] - base, best[3] - base]
    found = pa.StructArray.from_arrays([*(pa.array(c[some].astype(np.int32)) for c in cells), paths], names=PLACE.names)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[some], np.arange(len(column) + 1)).astype(np.int32)), found)


def drilldown(msg: Column | str, places: Column | str, tags: Sequence[int] | None = None, groups: bool = False) -> Column:
    """array of PLACE: for each byte of an array of places, the deepest field that covers it.

    A payload that the byte lies in is entered if it decodes as a message, and if
    its tag is one of tags (any, if that is None). Places outside the message,
    and in messages that don't decode, give nothing.
    """
    wanted = None if tags is None else list(tags)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, at in batches:
            for lo, hi in slices(column):
                yield _deepest(column.slice(lo, hi - lo), at.slice(lo, hi - lo), wanted, groups)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    m, p = (F.col(x) if isinstance(x, str) else x for x in (msg, places))
    return F.arrow_udf(run, T.ArrayType(PLACE)).asNondeterministic()(m, p.cast("array<int>"))


def at_byte(rows: DataFrame, places: DataFrame, keys: list[str], place: str = "byte", base: str = "root_base", depth: str = "depth") -> DataFrame:
    """For each (keys, byte): the deepest field that covers it, from rows with root_base and depth (as tree gives them)."""
    start = F.col(base) + F.col("offset")
    spans = rows.withColumn("_start", start).withColumn("_stop", F.col(base) + F.col("end"))
    met = places.join(spans, keys).filter((F.col("_start") <= F.col(place)) & (F.col(place) < F.col("_stop")))
    deepest = Window.partitionBy(*keys, place).orderBy(F.desc(depth))
    return met.withColumn("_n", F.row_number().over(deepest)).filter("_n = 1").drop("_n", "_start", "_stop")


def tree(rows: DataFrame, keys: list[str], tags: list[int], groups: bool = False) -> DataFrame:
    """rows and the fields below them that lie on a chain of message tags, with parent path, depth and root_base.

    tags[i] is the tag to descend by on level i. Payloads that are no messages
    have nothing below them.
    """
    from ..sources.fields import scan

    level = rows.withColumns({"path": F.array().cast("array<int>"), "depth": F.lit(0), "root_base": F.lit(0)})
    out = level
    for i, t in enumerate(tags):
        inner = level.filter(F.col("tag") == t).select(*keys, F.concat("path", F.array("ord")).alias("path"), F.lit(i + 1).alias("depth"), (F.col("root_base") + F.col("value_start")).alias("root_base"), F.col("bytes").alias("_inner"))
        level = scan(inner, "_inner", [*keys, "path", "depth", "root_base"], groups=groups)
        out = out.unionByName(level)
    return out
