"""One walk along many paths, and new values at the end of one path: kernels over a batch of messages.

All messages of a batch, and all payloads that lie on a path, are decoded in
step, a level of nesting at a time; payloads off the paths are never looked
into. So a walk is one pass over its table, at any depth and for any number of
paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from ..functions.tags import I32, I64, LEN, SGROUP, VARINT
from .fields import BAD_TAG, CUT, Units, _Bytes, buffers, decode_spans, fixed, gather

INT, LONG = T.IntegerType(), T.LongType()
MATCH = T.StructType(
    [T.StructField("path", T.ArrayType(LONG)), T.StructField("depth", INT), T.StructField("wire_type", INT), T.StructField("varint", LONG), T.StructField("fixed32", LONG), T.StructField("fixed64", LONG)]
    + [T.StructField("real", T.DoubleType()), T.StructField("payload", T.BinaryType()), T.StructField("length", INT), T.StructField("begin", INT), T.StructField("end", INT)]
)
ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("offset", INT)])
NOT_MESSAGE = 9


def walked(members: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField("matches", T.ArrayType(T.StructType([f for f in MATCH if f.name in members]))), T.StructField("error", ERROR), T.StructField("at", INT)])


@dataclass(frozen=True)
class Tree:
    """Edges of the tree that paths form, sorted by (node, tag) as one number, and for each node: where a path ends, and where one goes on."""

    keys: np.ndarray
    to: np.ndarray
    ends: np.ndarray
    more: np.ndarray
    paths: list[list[int]]

    @staticmethod
    def of(steps: list[tuple[int, int, int, bool, bool]]) -> Tree:
        steps = sorted(steps)
        paths: dict[int, list[int]] = {0: []}
        for node, tag, to, _, _ in sorted(steps, key=lambda s: s[2]):
            paths[to] = [*paths[node], tag]
        by_node = sorted((to, ends, more) for _, _, to, ends, more in steps)
        return Tree(
            np.array([node << 32 | tag for node, tag, *_ in steps], np.int64), np.array([s[2] for s in steps], np.int64), np.array([False, *(e for _, e, _ in by_node)]), np.array([True, *(m for _, _, m in by_node)]), [paths[n] for n in sorted(paths)]
        )

    def follow(self, node: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the fields lie on a path, and the nodes that these lead to."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = node << 32 | tag
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        on = np.flatnonzero(self.keys[at] == key)
        return on, self.to[at[on]]


def _first_errors(found: list[tuple[np.ndarray, ...]], bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The error of the walk of each message, and where the bad unit starts (or -1)."""
    n = len(bounds) - 1
    row, depth, start, at, bad, part = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 6
    order = np.lexsort((start, row))
    order = order[np.unique(row[order], return_index=True)[1]]
    row, depth, start, at, bad, part = (x[order] for x in (row, depth, start, at, bad, part))
    own = np.where((bad == CUT) | (part == 1), start, at)
    whole = (part == 5) & (depth == 0) & (bad == CUT)
    kind = np.where(bad == BAD_TAG, "InvalidTag", np.where(bad == NOT_MESSAGE, "WireTypeMismatch", np.where(whole, "Truncated", "Malformed")))
    kinds, offsets, starts = np.full(n, "", object), np.zeros(n, np.int32), np.full(n, -1)
    kinds[row], offsets[row], starts[row] = kind, own - bounds[row], start - bounds[row]
    none = np.ones(n, bool)
    none[row] = whole | (bad == BAD_TAG)
    ok = starts < 0
    error = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(offsets, mask=none)], names=ERROR.names, mask=pa.array(ok))
    return error, starts


def _inner(u: Units, on: np.ndarray) -> np.ndarray:
    kind = u.kind[on]
    return (kind == LEN) | (kind == SGROUP)


def walk_batch(column: pa.Array, tree: Tree, groups: bool, strict: bool, members: Sequence[str]) -> pa.Array:
    """The WALKED struct of each message: matches before the first error in the order of the walk, and the error.

    strict takes a message as a whole: on any error there are no matches, and a
    field on a path that leads on, but isn't a message, is an error.
    """
    data, bounds, null = buffers(column)
    b = _Bytes(data)
    row = np.flatnonzero((np.diff(bounds) > 0) & ~null)
    node, begin, stop, depth = np.zeros(len(row), np.int64), bounds[row], bounds[row + 1], 0
    found, wrong = [], []
    while len(row):
        u = decode_spans(b, begin, stop, groups)
        bad = np.flatnonzero(u.bad)
        wrong.append((row[bad], np.full(len(bad), depth), u.bad_start[bad], u.bad_at[bad], u.bad[bad], u.bad_part[bad]))
        on, to = tree.follow(node[u.span], u.tag)
        end = tree.ends[to]
        t = on[end]
        found.append((row[u.span[t]], to[end], np.full(len(t), depth + 1), u.kind[t], u.value[t], u.start[t], u.end[t], u.at[t], u.after[t]))
        go = tree.more[to]
        if strict:
            x = on[go & ~_inner(u, on)]
            wrong.append((row[u.span[x]], np.full(len(x), depth), u.at[x], u.at[x], np.full(len(x), NOT_MESSAGE), np.full(len(x), 1)))
        go &= _inner(u, on)
        on = on[go]
        row, node, begin, stop, depth = row[u.span[on]], to[go], u.start[on], u.end[on], depth + 1
    error, failed = _first_errors(wrong, bounds)
    row, node, depths, kind, value, start, end, at, after = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.uint64 if i == 4 else np.int64) for i in range(9)]
    take = (failed[row] < 0) | (not strict) & (after - bounds[row] <= failed[row])
    order = np.lexsort((-depths, after, row))
    order = order[take[order]]
    row, node, depths, kind, value, start, end, at, after = (x[order] for x in (row, node, depths, kind, value, start, end, at, after))
    base, delimited = bounds[row], (kind == LEN) | (kind == SGROUP)
    apart = bool((start[1:] >= end[:-1]).all())
    real = np.zeros(len(row))
    for k, width in ((I32, 4), (I64, 8)):
        on = np.flatnonzero(kind == k)
        if len(on):
            real[on] = data[start[on][:, None] + np.arange(width)].copy().view(f"<f{width}").ravel()
    build = {
        "path": lambda: pa.array(tree.paths, pa.list_(pa.int64())).take(pa.array(node)), "depth": lambda: pa.array(depths.astype(np.int32)), "wire_type": lambda: pa.array(kind.astype(np.int32)),
        "varint": lambda: pa.array(value.view(np.int64), mask=kind != VARINT), "fixed32": lambda: fixed(data, start, kind == I32, 4), "fixed64": lambda: fixed(data, start, kind == I64, 8), "real": lambda: pa.array(real, mask=(kind != I32) & (kind != I64)),
        "payload": lambda: gather(data, start, end, ~delimited, apart), "length": lambda: pa.array((end - start).astype(np.int32), mask=~delimited), "begin": lambda: pa.array((at - base).astype(np.int32)), "end": lambda: pa.array((after - base).astype(np.int32)),
    }
    matches = pa.StructArray.from_arrays([build[m]() for m in members], names=list(members))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(column) + 1)).astype(np.int32)), matches)
    return pa.StructArray.from_arrays([lists, error, pa.array(failed.astype(np.int32), mask=failed < 0)], names=["matches", "error", "at"], mask=pa.array(null))


def varint_sizes(values: np.ndarray) -> np.ndarray:
    size = np.ones(len(values), np.int64)
    for i in range(1, 10):
        size += values >> np.uint64(7 * i) > 0
    return size


def varint_cells(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Varints of unsigned longs behind one another, and their sizes."""
    size, at = varint_sizes(values), np.arange(10)
    cells = (values[:, None] >> (np.uint64(7) * at.astype(np.uint64))).astype(np.uint8) & 0x7F
    cells |= np.where(at < size[:, None] - 1, 0x80, 0).astype(np.uint8)
    return cells[at < size[:, None]], size


def woven(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Items of parts (bytes, sizes), the parts of each behind one another."""
    size = sum(s for _, s in parts)
    ends = np.cumsum(size)
    out, lead = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), ends - size
    for data, s in parts:
        out[np.arange(int(s.sum())) + np.repeat(lead - (np.cumsum(s) - s), s)] = data
        lead = lead + s
    return out, size


class Pieces:
    """New bytes for stretches of old ones."""

    def __init__(self) -> None:
        self.at: list[np.ndarray] = []
        self.stop: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.data: list[np.ndarray] = []

    def put(self, at: np.ndarray, stop: np.ndarray, *parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Puts the parts (bytes, sizes), of each stretch behind one another, in its place; by how much each grows."""
        out, size = woven(*parts)
        for mine, x in zip((self.at, self.stop, self.size, self.data), (at, stop, size, out), strict=True):
            mine.append(x)
        return size - (stop - at)

    def join(self, data: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The rows of data with all pieces in their places."""
        at, stop, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.at, self.stop, self.size))
        begin = np.cumsum(size) - size + len(data)
        everything = np.concatenate([data, *self.data])
        order = np.argsort(at, kind="stable")
        at, stop, size, begin = at[order], stop[order], size[order], begin[order]
        grown = np.zeros(len(data) + 1, np.int64)
        np.add.at(grown, at, size - (stop - at))
        offsets = bounds + np.concatenate([[0], np.cumsum(grown)])[bounds]
        starts = np.stack([np.append(np.concatenate([[0], stop]), 0)[: len(at) + 1], np.append(begin, 0)], 1).ravel()
        ends = np.stack([np.append(at, len(data)), np.append(begin + size, 0)], 1).ravel()
        n = np.maximum(ends - starts, 0)
        lead = np.cumsum(n) - n
        picked = everything[np.arange(int(n.sum())) + np.repeat(starts - lead, n)]
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(picked))])


def rewrite_batch(column: pa.Array, values: pa.Array, tags: Sequence[int], groups: bool) -> pa.Array:
    """Messages with new values (a list for each, in the order of the walk) of the fields at the end of a tag path.

    Of every message on the path the tags become canonical, and the length
    prefixes on the path; all else stays. A message that doesn't decode on the
    path, or has no list, stays as it is.
    """
    data, bounds, null = buffers(column)
    b = _Bytes(data)
    null |= np.asarray(values.is_null(), bool).reshape(len(column))
    row = np.flatnonzero((np.diff(bounds) > 0) & ~null)
    begin, stop, levels, owner, failed = bounds[row], bounds[row + 1], [], np.zeros(len(row), np.int64), null.copy()
    for t in tags:
        u = decode_spans(b, begin, stop, groups)
        failed[row[u.bad > 0]] = True
        on = np.flatnonzero(u.tag == t)
        levels.append((row, owner, u, on))
        go = on[_inner(u, on)]
        row, owner, begin, stop = row[u.span[go]], go, u.start[go], u.end[go]
    pieces, grew = Pieces(), None
    for depth in range(len(tags) - 1, -1, -1):
        row, owner, u, on = levels[depth]
        live = ~failed[row[u.span]]
        mine, total = np.zeros(len(u.at), np.int64), np.zeros(len(row), np.int64)
        tag = varint_cells(np.array([tags[depth]], np.uint64))[0]
        here = np.zeros(len(u.at), bool)
        here[on] = True
        head = lambda i: (np.tile(tag, len(i)), np.full(len(i), len(tag)))
        if depth + 1 == len(tags):
            i = on[live[on]]
            flat = _new_values(values, row[u.span[on]], live[on])
            given = np.asarray(flat.is_valid(), bool).reshape(len(flat))
            here[i[~given]] = False  # a null value changes nothing
            i, flat, kind = i[given], flat.drop_null(), tags[depth] & 7
            if kind == VARINT:
                mine[i] = pieces.put(u.at[i], u.after[i], head(i), varint_cells(flat.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            elif kind in (I32, I64):
                width = 4 if kind == I32 else 8
                x = flat.to_numpy(zero_copy_only=False)
                raw = x.astype(f"<f{width}") if x.dtype.kind == "f" else x.astype(np.int64).astype(f"<i{width}", casting="unsafe")
                mine[i] = pieces.put(u.at[i], u.after[i], head(i), (np.frombuffer(raw.tobytes(), np.uint8), np.full(len(i), width)))
            else:
                body, inner, _ = buffers(flat)
                body = (body, np.diff(inner))
                if kind == LEN:
                    mine[i] = pieces.put(u.at[i], u.after[i], head(i), varint_cells(body[1].astype(np.uint64)), body)
                else:
                    close = varint_cells(np.array([tags[depth] + 1], np.uint64))[0]
                    mine[i] = pieces.put(u.at[i], u.after[i], head(i), body, (np.tile(close, len(i)), np.full(len(i), len(close))))
        else:
            i = on[live[on] & _inner(u, on)]
            if tags[depth] & 7 == LEN:
                size = (u.end[i] - u.start[i] + grew[i]).astype(np.uint64)
                mine[i] = grew[i] + pieces.put(u.at[i], u.start[i], head(i), varint_cells(size))
            else:
                close = varint_cells(np.array([tags[depth] + 1], np.uint64))[0]
                mine[i] = grew[i] + pieces.put(u.at[i], u.start[i], head(i)) + pieces.put(u.end[i], u.after[i], (np.tile(close, len(i)), np.full(len(i), len(close))))
            here[on[~_inner(u, on)]] = False
        j = np.flatnonzero(~here & live & (u.tag_end - u.at != varint_sizes(u.tag.astype(np.uint64))))
        mine[j] = pieces.put(u.at[j], u.tag_end[j], varint_cells(u.tag[j].astype(np.uint64)))
        np.add.at(total, u.span, mine)
        if depth:
            grew = np.zeros(len(levels[depth - 1][2].at), np.int64)
            grew[owner] = total
    out = pieces.join(data, bounds)
    nulls = np.asarray(column.is_null(), bool).reshape(len(column))
    return out if not nulls.any() else pa.Array.from_buffers(pa.binary(), len(column), [pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes()), *out.buffers()[1:]])


def _new_values(values: pa.Array, row: np.ndarray, live: np.ndarray) -> pa.Array:
    """The values of the fields that are live, one for each, from the lists of their rows."""
    if not live.any():
        return values.values[:0]
    first = np.searchsorted(row, row)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return values.values.take(pa.array((offsets[:-1][row] + np.arange(len(row)) - first)[live]))
