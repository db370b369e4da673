"""Messages to rows: one row per field, with exact positions and errors as data.

All messages of a batch are decoded in step: step k reads field k of every
message that still has one, with array operations, so many small messages cost
little each. What is not of the wire (look-ups, nesting, edits) is left to
joins and groupings of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tags import EGROUP, I32, I64, LEN, SGROUP, VARINT

INT, LONG = T.IntegerType(), T.LongType()
FIELD = T.StructType(
    [T.StructField(n, LONG if n in ("tag", "varint", "fixed32", "fixed64") else INT) for n in ("ord", "offset", "tag", "field_number", "wire_type", "varint", "fixed32", "fixed64", "tag_end", "value_start", "value_end", "end")]
    + [T.StructField("bytes", T.BinaryType()), T.StructField("raw", T.BinaryType())]
)
ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("offset", INT), T.StructField("start", INT), T.StructField("at", T.StringType())])
DECODED = T.StructType([T.StructField("fields", T.ArrayType(FIELD)), T.StructField("error", ERROR)])

#: Kinds of error and the parts of a field where they arise, by code.
KINDS = np.array(["", "InvalidTag", "InvalidVarint", "Truncated", "MalformedGroup"])
PARTS = np.array(["", "tag", "value", "fixed", "len", "payload", "group"])
BAD_TAG, BAD_VARINT, CUT, BAD_GROUP = 1, 2, 3, 4
SIZE = {I64: 8, I32: 4}


class _Bytes:
    """The bytes of a batch, and for each place the next one that ends a varint."""

    def __init__(self, data: np.ndarray):
        self.data = np.append(data, np.zeros(16, np.uint8))
        at = np.where(self.data < 0x80, np.arange(len(self.data)), len(self.data) + 16)
        self.last = np.minimum.accumulate(at[::-1])[::-1]

    def varint(self, at: np.ndarray, end: np.ndarray, most: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, lengths, and 0 or the code of what is wrong."""
        room = end - at
        size = self.last[np.minimum(at, len(self.data) - 1)] - at + 1
        ok = (size <= room) & (size <= most)
        size = np.where(ok, size, 1)
        value = np.zeros(len(at), np.uint64)
        for i in range(int(size.max(initial=0))):
            byte = self.data[np.minimum(at + i, len(self.data) - 1)]
            value |= np.where(i < size, byte & 0x7F, 0).astype(np.uint64) << np.uint64(7 * i)
        ok &= ~((size == most) & (self.data[np.minimum(at + size - 1, len(self.data) - 1)] > top))
        return value, size, np.where(ok, 0, np.where(room < most, CUT, BAD_VARINT))


def _group_ends(b: _Bytes, at: np.ndarray, stop: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the end tags of groups begin and end, or -1; groups go on in step, those open inside each on a stack."""
    begin, after = np.full(len(at), -1), np.full(len(at), -1)
    open_, depth, at = number[:, None].copy(), np.ones(len(at), np.int64), at.copy()
    live = np.flatnonzero(at < stop)
    while len(live):
        here, end = at[live], stop[live]
        tag, size, bad = b.varint(here, end, 5, 0x0F)
        kind, n, to = (tag & np.uint64(7)).astype(np.int64), (tag >> np.uint64(3)).astype(np.int64), here + size
        ok = (bad == 0) & (n > 0) & (kind <= I32)
        inner = live[on := ok & (kind == SGROUP)]
        if len(inner) and depth[inner].max() == open_.shape[1]:
            open_ = np.pad(open_, ((0, 0), (0, open_.shape[1])))
        open_[inner, depth[inner]] = n[on]
        depth[inner] += 1
        inner = live[on := ok & (kind == EGROUP)]
        depth[inner] -= 1
        ok[on] = open_[inner, depth[inner]] == n[on]
        done = ok & (kind == EGROUP)
        done[done] = depth[live[done]] == 0
        begin[live[done]], after[live[done]] = here[done], to[done]
        for k, width in SIZE.items():
            to[kind == k] += width
        for k, most, top in ((VARINT, 10, 0x01), (LEN, 5, 0x0F)):
            on = np.flatnonzero(ok & (kind == k))
            value, size, bad = b.varint(to[on], end[on], most, top)
            ok[on] = bad == 0
            to[on] += size + (value.astype(np.int64) if k == LEN else 0)
        at[live] = to
        live = live[ok & ~done & (to < end)]
    return begin, after


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, absent: np.ndarray | None = None, apart: bool = True) -> pa.Array:
    """Slices of data as a binary column; null where absent. apart: sorted slices that don't overlap."""
    size = np.maximum(ends - starts, 0)
    if absent is not None:
        size = np.where(absent, 0, size)
    offsets = np.concatenate([[0], np.cumsum(size)])
    if offsets[-1] > 2**31 - 1:
        raise ValueError("a batch decodes to over 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    full = size > 0
    if apart and full.any():
        lo, hi = int(starts[full][0]), int((starts + size)[full][-1])
        if offsets[-1] == hi - lo:
            picked = data[lo:hi]
        else:
            edge = np.zeros(hi - lo + 1, np.int8)
            edge[starts[full] - lo] += 1
            edge[(starts + size)[full] - lo] -= 1
            picked = data[lo:hi][np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    else:
        picked = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)]
    mask = None if absent is None else pa.py_buffer(np.packbits(~absent, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(starts), [mask, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(picked))])


def fixed(data: np.ndarray, at: np.ndarray, on: np.ndarray, size: int) -> pa.Array:
    out = np.zeros(len(at), np.int64)
    if on.any():
        raw = data[at[on][:, None] + np.arange(size)].copy()
        out[on] = raw.view(f"<u{size}").ravel().astype(np.uint64).view(np.int64)
    return pa.array(out, mask=~on)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column, bounds of its rows in them, and which rows are null."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if n and column.buffers()[2] else np.zeros(0, np.uint8)
    return data, at - at[0], np.asarray(column.is_null(), bool).reshape(n)


#: Bytes of the messages that are decoded in one go; a place takes some 30 bytes while that is done.
SLICE_BYTES = 1 << 20


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows (first, end) of about limit bytes; a longer message is a run of its own. At least one run."""
    bounds = buffers(column)[1]
    lo = 0
    while True:
        hi = min(len(column), max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1))
        yield lo, hi
        if (lo := hi) >= len(column):
            return


@dataclass(frozen=True)
class Units:
    """Fields of stretches of bytes, sorted by stretch, and what is wrong in each stretch (0: nothing), where, from which unit's start, in which part."""

    span: np.ndarray
    ord: np.ndarray
    at: np.ndarray
    tag: np.ndarray
    value: np.ndarray
    tag_end: np.ndarray
    start: np.ndarray
    end: np.ndarray
    after: np.ndarray
    bad: np.ndarray
    bad_at: np.ndarray
    bad_start: np.ndarray
    bad_part: np.ndarray

    @property
    def kind(self) -> np.ndarray:
        return self.tag & 7


def decode_spans(b: _Bytes, begin: np.ndarray, end_: np.ndarray, groups: bool = False) -> Units:
    """The fields of each stretch of the bytes, all stretches in step."""
    n_rows = len(begin)
    row = np.flatnonzero(end_ > begin)
    at, stop = begin[row], end_[row]
    kind_of, where_of, start_of, part_of = (np.zeros(n_rows, np.int64) for _ in range(4))
    found: list[tuple[np.ndarray, ...]] = []
    step = 0
    while len(row):
        raw_tag, size, bad = b.varint(at, stop, 5, 0x0F)
        part, where = np.full(len(row), 1), at.copy()
        kind, number = (raw_tag & np.uint64(7)).astype(np.int64), (raw_tag >> np.uint64(3)).astype(np.int64)
        known = (kind == VARINT) | (kind == I64) | (kind == LEN) | (kind == I32) | (groups & ((kind == SGROUP) | (kind == EGROUP)))
        bad = np.where((bad == 0) & ((number == 0) | ~known), BAD_TAG, bad)
        tag_end = at + size
        value, start, end = np.zeros(len(row), np.uint64), tag_end.copy(), tag_end.copy()
        after = tag_end.copy()
        for k, name, most, top in ((VARINT, 2, 10, 0x01), (LEN, 4, 5, 0x0F)):
            on = np.flatnonzero((bad == 0) & (kind == k))
            if not len(on):
                continue
            v, s, wrong = b.varint(tag_end[on], stop[on], most, top)
            bad[on], part[on], where[on] = wrong, name, tag_end[on]
            value[on], start[on] = v, tag_end[on] + (s if k == LEN else 0)
            end[on] = tag_end[on] + s + (v.astype(np.int64) if k == LEN else 0)
            after[on] = end[on]
            if k == LEN:
                short = on[(wrong == 0) & (end[on] > stop[on])]
                bad[short], part[short], where[short] = CUT, 5, start[short]
        for k, width in SIZE.items():
            on = np.flatnonzero((bad == 0) & (kind == k))
            end[on] = after[on] = tag_end[on] + width
            short = on[end[on] > stop[on]]
            bad[short], part[short], where[short] = CUT, 3, tag_end[short]
        if groups:
            on = np.flatnonzero((bad == 0) & (kind == EGROUP))
            bad[on], part[on], where[on] = BAD_GROUP, 6, at[on]
            on = np.flatnonzero((bad == 0) & (kind == SGROUP))
            if len(on):
                end[on], after[on] = _group_ends(b, tag_end[on], stop[on], number[on])
                on = on[end[on] < 0]
                bad[on], part[on], where[on] = BAD_GROUP, 6, tag_end[on]
        wrong, good = np.flatnonzero(bad), np.flatnonzero(bad == 0)
        r = row[wrong]
        kind_of[r], where_of[r], start_of[r], part_of[r] = bad[wrong], where[wrong], at[wrong], part[wrong]
        if len(good):
            found.append(tuple(x[good] for x in (row, np.full(len(row), step), at, raw_tag.astype(np.int64), value, tag_end, start, end, after)))
        more = good[after[good] < stop[good]]
        row, at, stop = row[more], after[more], stop[more]
        step += 1
    cells = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.uint64 if i == 4 else np.int64) for i in range(9)]
    order = np.lexsort((cells[1], cells[0]))
    return Units(*(x[order] for x in cells), kind_of, where_of, start_of, part_of)


def decode_batch(column: pa.Array, groups: bool = False, members: Sequence[str] = tuple(FIELD.names)) -> pa.Array:
    """The DECODED struct of each message, its fields with the members asked for; null messages give null."""
    data, bounds, null = buffers(column)
    u = decode_spans(_Bytes(data), bounds[:-1], np.where(null, bounds[:-1], bounds[1:]), groups)
    base, kind = bounds[:-1][u.span], u.kind

    def int_(x: np.ndarray) -> pa.Array:
        return pa.array(x.astype(np.int32))

    build = {
        "ord": lambda: int_(u.ord), "offset": lambda: int_(u.at - base), "tag": lambda: pa.array(u.tag), "field_number": lambda: int_(u.tag >> 3), "wire_type": lambda: int_(kind),
        "varint": lambda: pa.array(u.value.view(np.int64), mask=kind != VARINT), "fixed32": lambda: fixed(data, u.start, kind == I32, 4), "fixed64": lambda: fixed(data, u.start, kind == I64, 8),
        "tag_end": lambda: int_(u.tag_end - base), "value_start": lambda: int_(u.start - base), "value_end": lambda: int_(u.end - base), "end": lambda: int_(u.after - base),
        "bytes": lambda: gather(data, u.start, u.end, ~np.isin(kind, [LEN, SGROUP])), "raw": lambda: gather(data, u.at, u.after),
    }
    fields = pa.StructArray.from_arrays([build[m]() for m in members], names=list(members))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(u.span, np.arange(len(column) + 1)).astype(np.int32)), fields)
    error = pa.StructArray.from_arrays(
        [pa.array(KINDS[u.bad]), int_(np.where(u.bad > 0, u.bad_at - bounds[:-1], 0)), int_(np.where(u.bad > 0, u.bad_start - bounds[:-1], 0)), pa.array(PARTS[u.bad_part])], names=ERROR.names, mask=pa.array(u.bad == 0)
    )
    return pa.StructArray.from_arrays([lists, error], names=DECODED.names, mask=pa.array(null))


def decoded(members: Sequence[str]) -> T.StructType:
    """The type of a cursor whose fields have these members of FIELD, in their order there."""
    return T.StructType([T.StructField("fields", T.ArrayType(T.StructType([f for f in FIELD if f.name in members]))), T.StructField("error", ERROR)])


def _decoder(groups: bool, members: Sequence[str] | None):
    wanted = [m for m in FIELD.names if members is None or m in members]

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for lo, hi in slices(column):
                yield decode_batch(column.slice(lo, hi - lo), groups, wanted)

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, decoded(wanted)).asNondeterministic()  # else a later filter makes Spark run it twice


def cursor(msg: Column | str, groups: bool = False, members: Sequence[str] | None = None) -> Column:
    """struct<fields, error>: the fields before the first bad one, and what is wrong there.

    members are those of FIELD that are wanted; a struct from Python isn't pruned
    by Spark, so what isn't read later is better left out here.
    """
    return _decoder(groups, members)(F.col(msg) if isinstance(msg, str) else msg)


def malformed(error: Column) -> Column:
    """A cursor's error in the terms of whole-message decoding: Malformed, at the same place."""
    return F.when(error["kind"].isNotNull(), F.struct(F.lit("Malformed").alias("kind"), error["offset"].alias("offset")))


def walk_error(error: Column) -> Column:
    """A cursor's error in the terms of the walkers, which report units that are cut off at their start."""
    at, kind = error["at"], error["kind"]
    cut = kind == "Truncated"
    start, own = error["start"], error["offset"]
    return F.when(
        kind.isNotNull(),
        F.when(at == "payload", F.struct(F.lit("Truncated").alias("kind"), F.lit(None).cast("int").alias("offset")))
        .when(kind == "InvalidTag", F.struct(F.lit("InvalidTag").alias("kind"), F.lit(None).cast("int").alias("offset")))
        .otherwise(F.struct(F.lit("Malformed").alias("kind"), F.when(cut | (at == "tag"), start).otherwise(own).alias("offset"))),
    )


#: Whole-message decoding takes this many fields at most.
MAX_FIELDS = 65535


def scan(df: DataFrame, msg: str = "msg", keep: list[str] | None = None, mode: str = "document", groups: bool = False, members: Sequence[str] | None = None) -> DataFrame:
    """One row per field: the kept columns and the columns of FIELD (or those in members).

    mode "cursor" gives the fields before an error, "document" none of a bad
    message (or one of over 65,535 fields), "strict" fails the query. A column of
    FIELD whose name a kept column has gets underscores at its end.
    """
    keep = [c for c in df.columns if c != msg] if keep is None else keep
    got = df.select(*keep, cursor(msg, groups, members).alias(d := fresh(df, "_decoded")))
    error, fields = F.col(d)["error"], F.col(d)["fields"]
    bad = error["kind"].isNotNull() | (F.size(fields) > MAX_FIELDS)
    if mode == "document":
        got = got.filter(~bad)
    elif mode == "strict":
        text = F.concat(F.lit("bad message: "), F.coalesce(error["kind"], F.lit("CapacityExceeded")), F.lit(" at "), F.coalesce(error["offset"].cast("string"), F.lit("?")))
        got = got.withColumn(d, F.when(bad, F.raise_error(text).cast(got.schema[d].dataType)).otherwise(F.col(d)))
    return got.select(*keep, F.inline(fields).alias(*(fresh_in(keep, m) for m in FIELD.names if members is None or m in members)))


def errors(df: DataFrame, msg: str = "msg", keep: list[str] | None = None, groups: bool = False) -> DataFrame:
    """One row per message: the kept columns, n_fields before an error, and the error in three taxonomies."""
    keep = [c for c in df.columns if c != msg] if keep is None else keep
    got = df.select(*keep, cursor(msg, groups, ["ord"]).alias(d := fresh(df, "_decoded")))
    error, n = F.col(d)["error"], F.size(F.col(d)["fields"])
    document = F.coalesce(malformed(error), F.when(n > MAX_FIELDS, F.struct(F.lit("CapacityExceeded").alias("kind"), F.lit(None).cast("int").alias("offset"))))
    return got.select(*keep, n.alias("n_fields"), error.alias("cursor"), document.alias("document"), walk_error(error).alias("walk"))


def remaining(msg: Column | str, field: Column) -> Column:
    """The bytes of msg behind a field."""
    m = F.col(msg) if isinstance(msg, str) else msg
    return F.substring(m, field["end"] + 1, F.length(m))


def descend(rows: DataFrame, tag: int, keep: list[str], groups: bool = False, mode: str = "document") -> DataFrame:
    """The fields of the nested messages under a tag: keep, parent (ord of the field they lie in), FIELD.

    Only the payloads of matching fields are decoded.
    """
    inner = rows.filter(F.col("tag") == tag).select(*keep, F.col("ord").alias("parent"), F.col("bytes").alias(b := fresh(rows, "_inner")))
    return scan(inner, b, [*keep, "parent"], mode, groups)


def fresh_in(have: Sequence[str], name: str) -> str:
    """name, with underscores added until none of have is the same."""
    taken = {c.lower() for c in have}
    while name.lower() in taken:
        name += "_"
    return name


def fresh(df: DataFrame, name: str) -> str:
    return fresh_in(df.columns, name)
