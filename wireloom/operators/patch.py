"""Edits of messages by an edit log, and what a message looks like under its edits.

An edit names a field by its path in the message as it was before any edit:
(number, occurrence) steps, occurrences counted over all wire types. A log is
grouped by key and joined to the messages once; one Arrow function then edits a
batch. It decodes only messages that edits reach into, all of a level in step,
and puts them together again from the inside out. Bytes that no edit touches
stay as they are, and messages without edits never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tags import I32, I64, LEN, SGROUP, VARINT
from ..sources.fields import Units, _Bytes, buffers, decode_spans, fixed, fresh, gather, slices
from ..sources.walk import Pieces, varint_cells, varint_sizes, woven
from .paths import values_at, with_values

#: key, seq (order of edits of a key), txn (null: none), path, op, and what it sets.
#: ops: set, set_bytes, insert, delete, clear. insert's path is that of the message;
#: target, in place of a path, is the seq of an insert.
EDIT = "path array<struct<number:int,occurrence:int>>, seq int, txn string, op string, target int, tag bigint, value bigint, payload binary"
EDIT_NAMES = ("path", "seq", "txn", "op", "target", "tag", "value", "payload")
#: A field under edits: the path of the message it lies in, what it is, and what has become of it.
STATE = T.StructType(
    [T.StructField("parent", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("ord", "field_number", "occurrence", "wire_type", "offset", "end")] + [T.StructField("tag", T.LongType())]
    + [T.StructField(n, T.BooleanType()) for n in ("deleted", "inserted", "edited", "child")] + [T.StructField("varint", T.LongType()), T.StructField("fixed", T.LongType()), T.StructField("bytes", T.BinaryType())]
)


def committed(edits: DataFrame, transactions: DataFrame) -> DataFrame:
    """The edits outside transactions and those of committed ones (txn, state)."""
    done = transactions.filter("state = 'committed'").select("txn").distinct()
    return edits.filter("txn is null").unionByName(edits.filter("txn is not null").join(done, "txn", "left_semi").select(*edits.columns))


@dataclass
class Log:
    """Builds a log of edits. What is put in a transaction that raises, or is rolled back, is left out."""

    rows: list[dict[str, Any]] = field(default_factory=list)
    seq: int = 0

    def _add(self, op: str, **what: Any) -> int:
        self.seq += 1
        self.rows.append({"op": op, "seq": self.seq, **what})
        return self.seq

    @staticmethod
    def _where(at: Sequence[tuple[int, int]] | int) -> dict[str, Any]:
        return {"target": at} if isinstance(at, int) else {"path": list(at)}

    def set(self, at: Sequence[tuple[int, int]] | int, value: int) -> int:
        """at is a path, or the number of an insert."""
        return self._add("set", value=value, **self._where(at))

    def set_bytes(self, at: Sequence[tuple[int, int]] | int, payload: bytes) -> int:
        return self._add("set_bytes", payload=payload, **self._where(at))

    def insert(self, tag: int, value: int | bytes, into: Sequence[tuple[int, int]] = ()) -> int:
        return self._add("insert", path=list(into), tag=tag, **{"payload" if isinstance(value, bytes) else "value": value})

    def delete(self, at: Sequence[tuple[int, int]] | int) -> int:
        return self._add("delete", **self._where(at))

    def clear(self, at: Sequence[tuple[int, int]] | int) -> int:
        return self._add("clear", **self._where(at))

    @contextmanager
    def transaction(self) -> Iterator[Log]:
        kept = list(self.rows)
        try:
            yield self
        except BaseException:
            self.rows = kept
            raise

    def column(self) -> Column:
        """The log as a literal array, for the same edits of every message."""
        kind = T.ArrayType(T._parse_datatype_string(EDIT))

        def cell(e: dict[str, Any], n: str) -> Column:
            if n == "path" and e.get(n) is not None:
                return F.array(*(F.struct(F.lit(a), F.lit(b)) for a, b in e[n])).cast(kind.elementType[n].dataType)
            return F.lit(e.get(n)).cast(kind.elementType[n].dataType)

        rows = [F.struct(*(cell(e, n) for n in EDIT_NAMES)).cast(kind.elementType) for e in self.rows]
        return F.array(*rows) if rows else F.lit(None).cast(kind)

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = T._parse_datatype_string(EDIT)
        return spark.createDataFrame([tuple(e.get(f.name) for f in schema) for e in self.rows], schema)


# The editor: all messages of a batch that edits reach into at a depth are a level, edited in step.

OPS = ("set", "set_bytes", "insert", "delete", "clear")
SET, SET_BYTES, INSERT, DELETE, CLEAR, NOTHING = range(6)
Cells = tuple[np.ndarray, np.ndarray]  # bytes of items behind one another, and their sizes


def _ints(x: pa.Array, none: int = 0) -> np.ndarray:
    return pc.fill_null(x, none).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, behind one another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _delimited(kind: np.ndarray) -> np.ndarray:
    return (kind == LEN) | (kind == SGROUP)


@dataclass(frozen=True)
class _Edits:
    """The edits of a batch by row and seq, and behind them one that does nothing, for -1."""

    row: np.ndarray
    seq: np.ndarray
    op: np.ndarray
    aimed: np.ndarray  # at an insert
    steps: np.ndarray  # in its path
    first: np.ndarray  # its first step in number and occurrence
    number: np.ndarray
    occurrence: np.ndarray
    tag: np.ndarray
    value: np.ndarray
    no_value: np.ndarray
    data: np.ndarray  # payloads
    begin: np.ndarray
    size: np.ndarray
    no_payload: np.ndarray
    over: np.ndarray  # of inserts: the edit that set it last, and whether it was deleted, or cleared
    dead: np.ndarray
    clear: np.ndarray

    @staticmethod
    def of(messages: pa.Array, logs: pa.Array) -> _Edits:
        flat = logs.flatten()
        cells = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
        row = np.repeat(np.arange(len(logs)), _ints(pc.list_value_length(logs)))
        some = {n: np.asarray(cells[n].is_valid(), bool).reshape(len(flat)) for n in EDIT_NAMES}
        there = np.asarray(messages.is_valid(), bool).reshape(len(messages))
        at = np.flatnonzero(some["op"] & some["seq"] & (some["path"] | some["target"]) & there[row])
        at = at[np.lexsort((_ints(cells["seq"])[at], row[at]))]
        cells, some = {n: x.take(pa.array(at)) for n, x in cells.items()}, {n: x[at] for n, x in some.items()}
        row, seq, op = row[at], _ints(cells["seq"]), _ints(pc.index_in(cells["op"], pa.array(OPS)), NOTHING)
        aimed, tag, value = some["target"], _ints(cells["tag"]), _ints(cells["value"])
        # On a field, what sets nothing does nothing.
        op[~aimed & ((op == INSERT) & ~some["tag"] | (op == SET) & ~some["value"] | (op == SET_BYTES) & ~some["payload"])] = NOTHING
        steps = np.where(some["path"], _ints(pc.list_value_length(cells["path"])), 0)
        number, occurrence = (_ints(cells["path"].flatten().field(n), -1) for n in ("number", "occurrence"))
        data, bounds, _ = buffers(cells["payload"])
        over, dead, clear = np.full(len(at), -1), np.zeros(len(at), bool), np.zeros(len(at), bool)
        new, later = np.flatnonzero((op == INSERT) & ~aimed), np.flatnonzero(aimed)
        key = row[new] << 32 | seq[new] + (1 << 31)
        goal = row[later] << 32 | _ints(cells["target"])[later] + (1 << 31)
        lo, hi = np.searchsorted(key, goal), np.searchsorted(key, goal, "right")
        of, by = new[_ranges(lo, hi - lo)], np.repeat(later, hi - lo)
        sets = (op[by] == np.where(_delimited(tag[of] & 7), SET_BYTES, SET)) | (op[by] == CLEAR)
        np.maximum.at(over, of[sets], by[sets])
        over[(over >= 0) & (op[over] == CLEAR)] = -1
        dead[of[op[by] == DELETE]], clear[of[op[by] == CLEAR]] = True, True
        none = [np.append(x, y) for x, y in ((row, -1), (seq, -1), (op, NOTHING), (aimed, True), (steps, 0), (np.cumsum(steps) - steps, 0))]
        return _Edits(*none, number, occurrence, tag, value, ~some["value"], data, bounds[:-1], np.where(some["payload"], np.diff(bounds), 0), ~some["payload"], over, dead, clear)

    def payloads(self, at: np.ndarray) -> Cells:
        return self.data[_ranges(self.begin[at], self.size[at])], self.size[at]


@dataclass(frozen=True)
class _Level:
    """Messages at a depth: rows and bytes, each with a byte to spare behind it; their fields and what edits say of those."""

    row: np.ndarray
    data: np.ndarray
    begin: np.ndarray
    base: np.ndarray  # where it begins in its row's message, or -1
    path: pa.Array
    of: np.ndarray  # the messages that edits lie in
    edit: np.ndarray
    u: Units
    bad: np.ndarray
    over: np.ndarray  # of each field: the overlay that set it last, since the last clear; nothing takes back a delete
    dead: np.ndarray
    child: np.ndarray  # the message on the next level

    def inserts(self, e: _Edits, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The messages and edits of inserts into them; of several with one seq, the last."""
        mine = (e.op[self.edit] == INSERT) & (e.steps[self.edit] == depth) & ~self.bad[self.of]
        c, i = self.of[mine], self.edit[mine]
        last = np.ones(len(c), bool)
        last[:-1] = (c[1:] != c[:-1]) | (e.seq[i[1:]] != e.seq[i[:-1]])
        return c[last], i[last]


def _places(u: Units, wanted: np.ndarray) -> np.ndarray:
    """The fields at (container, number, occurrence), or -1."""
    key = u.span << 30 | u.tag >> 3
    order = np.argsort(key, kind="stable")
    key = key[order]
    goal = wanted[:, 0] << 30 | wanted[:, 1]
    first = np.searchsorted(key, goal)
    at = first + wanted[:, 2]
    ok = (at < len(key)) & (wanted[:, 2] >= 0) & (wanted[:, 1] > 0) & (wanted[:, 1] < 1 << 30)
    at = np.where(ok, at, 0)
    return np.where(ok & (key[at] == goal), order[at], -1) if len(key) else np.full(len(wanted), -1)


def _nth(span: np.ndarray, number: np.ndarray) -> np.ndarray:
    """How many of the same span and number come before."""
    order = np.lexsort((number, span))
    new = np.ones(len(order), bool)
    new[1:] = (span[order][1:] != span[order][:-1]) | (number[order][1:] != number[order][:-1])
    out, at = np.empty(len(order), np.int64), np.arange(len(order))
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _levels(messages: pa.Array, logs: pa.Array, groups: bool) -> tuple[_Edits, list[_Level]]:
    e = _Edits.of(messages, logs)
    data, bounds, null = buffers(messages)
    row = np.flatnonzero(~null & np.asarray(logs.is_valid(), bool).reshape(len(logs)))
    start, size, since, base = bounds[row], np.diff(bounds)[row], np.full(len(row), -1), np.zeros(len(row), np.int64)
    path = pa.array([""], pa.string()).take(pa.array(np.zeros(len(row), np.int64)))
    edit = np.flatnonzero(~e.aimed)
    of = np.searchsorted(row, e.row[edit])
    out: list[_Level] = []
    while len(row):
        begin = np.cumsum(size + 1) - size - 1
        body = np.zeros(int((size + 1).sum()), np.uint8)
        body[_ranges(begin, size)] = data[_ranges(start, size)]
        u = decode_spans(_Bytes(body), begin, begin + size, groups)
        bad, kind, depth = u.bad > 0, u.kind, len(out)
        some = ~bad[of] & (e.steps[edit] > depth)
        i, step = edit[some], e.first[edit[some]] + depth
        f = _places(u, np.stack([of[some], e.number[step], e.occurrence[step]], 1))
        i, f = i[f >= 0], f[f >= 0]
        here, over, dead = (e.steps[i] == depth + 1) & (e.op[i] != INSERT), np.full(len(u.at), -1), np.zeros(len(u.at), bool)
        dead[f[here & (e.op[i] == DELETE)]] = True
        # Values of the wrong wire type change nothing.
        sets = here & ((e.op[i] == CLEAR) | (e.op[i] == np.where(_delimited(kind[f]), SET_BYTES, SET)))
        np.maximum.at(over, f[sets], i[sets])
        over[e.op[over] == CLEAR] = -1
        i, f = i[~here], f[~here]
        inner, first, to = np.unique(f, return_index=True, return_inverse=True)
        was = np.where(over[inner] >= 0, e.seq[over[inner]], since[u.span[inner]])
        on = (e.seq[i] > was[to]) & _delimited(kind[f])  # earlier ones are lost with the payload that was replaced
        wanted = np.zeros(len(inner), bool)
        wanted[to[on]] = True
        nodes = np.flatnonzero(wanted)
        nodes = nodes[np.argsort(first[nodes])]
        rank, child = np.full(len(inner), -1), np.full(len(u.at), -1)
        rank[nodes], child[inner[nodes]] = np.arange(len(nodes)), np.arange(len(nodes))
        out.append(_Level(row, body, begin, base, path, of, edit, u, bad, over, dead, child))
        of, edit = rank[to[on]], i[on]
        order = np.lexsort((edit, of))
        of, edit, f = of[order], edit[order], inner[nodes]
        if not len(f):
            break
        c, own = u.span[f], over[f] < 0
        names = [x.cast(pa.string()) for x in (pa.array(u.tag[f] >> 3), pa.array(_nth(u.span, u.tag >> 3)[f]))]
        path = pc.binary_join_element_wise(path.take(pa.array(c)), "/", names[0], ":", names[1], "")
        base = np.where(own & (base[c] >= 0), base[c] + u.start[f] - begin[c], -1)
        data = np.concatenate([body, e.data])
        start, size = u.start[f], u.end[f] - u.start[f]
        start[~own], size[~own] = len(body) + e.begin[over[f][~own]], e.size[over[f][~own]]
        row, since = row[c], was[nodes]
    return e, out


def _scalars(kind: np.ndarray, value: np.ndarray) -> Cells:
    """Values as their wire types write them."""
    v, at = value.view(np.uint64)[:, None], np.arange(10)
    width = varint_sizes(value.view(np.uint64))
    size = np.where(kind == VARINT, width, np.where(kind == I32, 4, 8))
    varints = (v >> (7 * at).astype(np.uint64)).astype(np.uint8) & 0x7F | np.where(at < width[:, None] - 1, 0x80, 0).astype(np.uint8)
    plain = (v >> np.minimum(8 * at, 56).astype(np.uint64)).astype(np.uint8)
    return np.where((kind == VARINT)[:, None], varints, plain)[at < size[:, None]], size


def _where(on: np.ndarray, cells: Callable[[np.ndarray], Cells]) -> Cells:
    """The cells of some items; the others have none."""
    size = np.zeros(len(on), np.int64)
    data, size[on] = cells(np.flatnonzero(on))
    return data, size


def _new_fields(e: _Edits, i: np.ndarray) -> Cells:
    now, tag, kind = np.where(e.over[i] >= 0, e.over[i], i), e.tag[i].astype(np.uint64), e.tag[i] & 7
    return woven(
        varint_cells(tag), _where(kind == LEN, lambda x: varint_cells(e.size[now[x]].astype(np.uint64))), _where(_delimited(kind), lambda x: e.payloads(now[x])),
        _where(~_delimited(kind), lambda x: _scalars(kind[x], e.value[now[x]])), _where(kind == SGROUP, lambda x: varint_cells(tag[x] + np.uint64(1))),
    )


def _edit_batch(messages: pa.Array, logs: pa.Array, groups: bool) -> pa.Array:
    e, levels = _levels(messages, logs, groups)
    built, data, bounds, good = messages[:0], e.data, np.zeros(1, np.int64), np.zeros(1, bool)
    for depth in range(len(levels) - 1, -1, -1):
        v = levels[depth]
        u, kind, pieces = v.u, v.u.kind, Pieces()
        inner = (v.child >= 0) & good[v.child]
        whole = inner | (v.over >= 0) & _delimited(kind)
        start = np.where(inner, bounds[v.child], len(data) + np.append(e.begin, 0)[v.over])
        size = np.where(inner, bounds[v.child + 1 if len(bounds) > 1 else v.child] - bounds[v.child], np.append(e.size, 0)[v.over])
        both = np.concatenate([data, e.data])

        def body(f: np.ndarray, both=both, start=start, size=size) -> Cells:
            return both[_ranges(start[f], size[f])], size[f]

        f = np.flatnonzero(v.dead)
        pieces.put(u.at[f], u.after[f], (np.zeros(0, np.uint8), np.zeros(len(f), np.int64)))
        same = size == u.end - u.start
        f = np.flatnonzero(~v.dead & whole & (kind == LEN) & same)
        pieces.put(u.start[f], u.after[f], body(f))
        f = np.flatnonzero(~v.dead & whole & (kind == LEN) & ~same)
        pieces.put(u.tag_end[f], u.after[f], varint_cells(size[f].astype(np.uint64)), body(f))
        f = np.flatnonzero(~v.dead & whole & (kind == SGROUP))
        pieces.put(u.start[f], u.end[f], body(f))
        f = np.flatnonzero(~v.dead & ~_delimited(kind) & (v.over >= 0))
        pieces.put(u.tag_end[f], u.after[f], _scalars(kind[f], e.value[v.over[f]]))
        c, i = v.inserts(e, depth)
        lives = ~(e.dead[i] | e.clear[i])
        added, sizes = _new_fields(e, i[lives])
        stop = np.append(v.begin[1:], len(v.data)) - 1
        pieces.put(stop, stop + 1, (added, np.bincount(c[lives], sizes, len(stop)).astype(np.int64)))
        built = pieces.join(v.data, np.append(v.begin, len(v.data)))
        (data, bounds, _), good = buffers(built), ~v.bad
    at = np.arange(len(messages))
    if levels:
        at[levels[0].row[good]] = len(messages) + np.flatnonzero(good)
    return pa.concat_arrays([messages, built]).take(pa.array(at))


def _state_batch(messages: pa.Array, logs: pa.Array, groups: bool) -> pa.Array:
    """Of each message the fields of all messages that edits reach into, parsed ones first, then inserted ones."""
    e, levels = _levels(messages, logs, groups)
    found, keys = [], []
    for depth, v in enumerate(levels):
        u, (c, i) = v.u, v.inserts(e, depth)
        f = np.flatnonzero(~v.bad[u.span])
        n, new, now = len(f), np.repeat([False, True], [len(f), len(i)]), np.where(e.over[i] >= 0, e.over[i], i)
        c, tag, over, fixed_ = np.concatenate([u.span[f], c]), np.concatenate([u.tag[f], e.tag[i]]), v.over[f], (u.kind[f] == I32) | (u.kind[f] == I64)
        kind, set_ = tag & 7, (over >= 0) & ~_delimited(u.kind[f])
        raw = np.where(u.kind[f] == I32, _ints(fixed(v.data, u.start[f], u.kind[f] == I32, 4)), np.where(fixed_, _ints(fixed(v.data, u.start[f], u.kind[f] == I64, 8)), u.value[f].view(np.int64)))
        value = np.concatenate([np.where(set_, np.append(e.value, 0)[over], raw), e.value[now]])
        no = np.concatenate([np.zeros(n, bool), e.no_value[now]])
        inside = np.bincount(u.span[f], minlength=len(v.row))
        ord_ = np.concatenate([u.ord[f], inside[c[n:]] + _nth(c[n:], np.zeros(len(i), np.int64))])
        at = v.base[c[:n]] - v.begin[c[:n]]
        places = [pa.array(np.append(at + x[f], np.zeros(len(i), np.int64)).astype(np.int32), mask=new | (v.base[c] < 0)) for x in (u.at, u.after)]
        data = np.concatenate([v.data, e.data])
        own = over < 0
        start = np.concatenate([np.where(own, u.start[f], len(v.data) + np.append(e.begin, 0)[over]), len(v.data) + e.begin[now]])
        size = np.concatenate([np.where(own, u.end[f] - u.start[f], np.append(e.size, 0)[over]), e.size[now]])
        none = np.concatenate([np.zeros(n, bool), e.no_payload[now]])
        cells = [
            v.path.take(pa.array(c)), *(pa.array(x.astype(np.int32)) for x in (ord_, tag >> 3, _nth(c, tag >> 3), kind)), *places, pa.array(tag),
            *(pa.array(np.concatenate(x).astype(bool)) for x in ((v.dead[f], e.dead[i] | e.clear[i]), (new,), (over >= 0, e.over[i] >= 0), (v.child[f] >= 0, np.zeros(len(i), bool)))),
            pa.array(value, mask=no | (kind != VARINT)), pa.array(value, mask=no | (kind != I32) & (kind != I64)), gather(data, start, start + size, none | ~_delimited(kind), False),
        ]
        found.append(pa.StructArray.from_arrays(cells, fields=list(_STATES.value_type)))
        keys.append((v.row[c], np.full(len(c), depth), c, new, ord_))
    row, *by = (np.concatenate(x) for x in zip(*keys, strict=True)) if keys else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((*by[::-1], row))
    values = pa.concat_arrays(found).take(pa.array(order)) if found else pa.array([], _STATES.value_type)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(messages) + 1)).astype(np.int32)), values, mask=messages.is_null())


_STATES = pa.list_(pa.struct([(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in STATE]))


def _over(batch, groups: bool, kind: T.DataType):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for messages, logs in batches:
            for lo, hi in slices(messages):
                yield batch(messages.slice(lo, hi - lo), logs.slice(lo, hi - lo), groups)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def edited(msg: Column | str, log: Column | str, groups: bool = False) -> Column:
    """msg with the edits of an array (elements as in EDIT) applied by seq; without edits, msg itself.

    Edits whose field isn't there, or that don't fit its wire type, have no
    effect. A message, or payload on a path, that doesn't decode stays as it
    is. A payload that an edit replaced is decoded anew for edits below it that
    come later; those before it are lost with it.
    """
    m, e = (F.col(x) if isinstance(x, str) else x for x in (msg, log))
    some = F.size(e) > 0
    return F.coalesce(_over(_edit_batch, groups, T.BinaryType())(F.when(some, m), F.when(some, e)), m)


def states(msg: Column | str, log: Column | str, groups: bool = False) -> Column:
    """array of STATE: the fields of the message, and of those in it that edits reach into, deleted and inserted ones among them.

    Values are read through the edits. offset and end are places in the message
    as it was; inserted fields, and those in replaced payloads, have none.
    """
    m, e = (F.col(x) if isinstance(x, str) else x for x in (msg, log))
    return _over(_state_batch, groups, T.ArrayType(STATE))(m, F.coalesce(e, F.array().cast(T.ArrayType(T._parse_datatype_string(EDIT)))))


def _with_log(messages: DataFrame, edits: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """messages with the edits of their key as an array; null keys are equal."""
    name = fresh(messages, "_log")
    logs = edits.groupBy(*[F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys)]).agg(F.collect_list(F.struct(*EDIT_NAMES)).alias(name))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= messages[k].eqNullSafe(logs[f"{name}{i}"])
    return messages.join(logs, on, "left").drop(*[f"{name}{i}" for i in range(len(keys))]), name


def apply_edits(messages: DataFrame, edits: DataFrame, keys: list[str], msg: str = "msg", groups: bool = False) -> DataFrame:
    """keys and msg with the edits of each key applied, as edited does.

    edits has keys and the columns of EDIT; take committed() first. Null keys are
    equal to one another; messages of one key all get its edits. A key's edits
    meet in a task.
    """
    got, log = _with_log(messages, edits, keys)
    return got.select(*keys, edited(msg, log, groups).alias(msg))


def edited_fields(messages: DataFrame, edits: DataFrame, keys: list[str], msg: str = "msg", groups: bool = False) -> DataFrame:
    """keys and the columns of STATE, a row for each field, as states gives them."""
    got, log = _with_log(messages, edits, keys)
    return got.select(*keys, states(msg, log, groups).alias(log)).select(*keys, F.inline(log))


def edit_values(messages: DataFrame, path: Sequence[int], change, keys: list[str], msg: str = "msg", kind: str = "uint64", strict: bool = False, groups: bool = False) -> DataFrame:
    """Applies change (a function of a value Column) to all values of a kind on a tag path; keys and msg.

    Every message on the path is re-encoded: its tags become canonical, and the
    length prefixes on the path; other fields stay as they are. An empty path
    changes nothing; a message that doesn't decode on the path stays as it is. A
    change to null leaves that value.
    """
    if not path:
        return messages.select(*keys, msg)
    name = fresh(messages, "_values")
    got = messages.select(*keys, msg, values_at(msg, path, kind, strict, groups).alias(name))
    return got.select(*keys, with_values(msg, path, kind, F.transform(name, change), groups).alias(msg))
