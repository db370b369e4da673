"""Messages that arrive in chunks: matches and fields out as soon as they are whole, the open rest in state."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tags import EGROUP, I32, I64, LEN, SGROUP, VARINT
from ..operators.paths import Path, steps
from ..sources.fields import buffers, decode_batch, gather, slices
from ..sources.walk import Tree, walk_batch

OUT = T.StructType(
    [T.StructField("stream_id", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("path", T.ArrayType(T.LongType())), T.StructField("tag", T.LongType()), T.StructField("varint", T.LongType()), T.StructField("raw", T.BinaryType())]
    + [T.StructField("payload", T.BinaryType()), T.StructField("length", T.LongType()), T.StructField("is_last", T.BooleanType()), T.StructField("error", T.StringType())]
)
STATE = "tail binary, base long, pos long, frames string, failed boolean"
_ARROW = dict(zip(OUT.names, (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.string()), strict=True))
#: Chunks of a stream, seq after seq, and the first seq.
RUNS = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("seq", T.LongType()), *(T.StructField(n, T.ArrayType(k())) for n, k in (("seqs", T.LongType), ("chunks", T.BinaryType), ("lasts", T.BooleanType)))])
_TOP = ("offset", "tag", "varint", "fixed32", "fixed64", "end", "bytes")
_MATCH = ("path", "varint", "fixed32", "fixed64", "payload", "begin", "end")
CHUNK_NAMES = ["stream_id", "seq", "chunk", "last"]


def whole_messages(chunks: DataFrame) -> DataFrame:
    """stream_id and msg: the chunks (stream_id, seq, chunk) of each stream in the order of seq."""
    from ..functions.encode import concat_all

    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return chunks.groupBy("stream_id").agg(parts.alias("_p")).select("stream_id", concat_all(F.transform("_p", lambda p: p["chunk"])).alias("msg"))


class _Bad(Exception):
    """What is wrong, and where."""


class _More(Exception):
    """The unit isn't whole yet."""


class Walker:
    """A walk that stops wherever the bytes end, and goes on with the next ones.

    A frame is an open payload: [node, stop, tag, unit, start, ends, told]: the
    tree's node (-1: off the paths), where it stops (-1: a group), its tag, where
    its unit and its payload start, whether a path ends with it, and how much of
    it was told. Bytes are kept from the first open payload that is wanted.
    """

    def __init__(self, paths: Sequence[Path] | None, groups: bool, partial: bool):
        rows = steps(paths) if paths is not None else []
        self.edges = {(node, tag): (to, ends, more) for node, tag, to, ends, more in rows} if paths is not None else None
        self.groups, self.partial = groups, partial
        self.reset()

    def reset(self) -> None:
        self.data, self.base, self.pos, self.frames, self.failed = b"", 0, 0, [], False

    def _varint(self, at: int, end: int, most: int, top: int, unit: int) -> tuple[int, int]:
        value, i, shift = 0, at - self.base, 0
        limit = min(i + most, len(self.data), end - self.base)
        while i < limit:
            byte = self.data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                if shift == 7 * most and byte > top:
                    raise _Bad("InvalidVarint", at)
                return value, i + self.base
        if shift == 7 * most:
            raise _Bad("InvalidVarint", at)
        if i + self.base >= end:
            raise _Bad("Malformed", unit)
        raise _More

    def feed(self, chunk: bytes) -> list[tuple]:
        """Rows (offset, path, tag, varint, raw, payload, length, is_last, error) that the chunk makes whole."""
        rows: list[tuple] = []
        if self.failed or not chunk:
            return rows
        self.data += chunk
        try:
            while self._step(rows):
                pass
        except _More:
            pass
        except _Bad as e:
            kind, at = e.args
            kind = kind if kind == "InvalidTag" or self.edges is None else "Malformed"
            self.failed = True
            rows.append((at, None, None, None, None, None, None, None, f"{kind} at {at}"))
            self.data, self.base, self.frames = b"", self.base + len(self.data), []
            return rows
        fed = self.base + len(self.data)
        for k, frame in enumerate(self.frames if self.partial else []):
            _, stop, tag, unit, start, ends, told = frame
            upto = self.pos if stop < 0 else min(stop, fed)
            if ends and upto > max(told, start):
                frame[6] = upto
                rows.append((unit, self._path(k + 1), tag, None, None, self._cut(start, upto), None if stop < 0 else stop - start, False, None))
        first = min([self.pos, *(f[3] for f in self.frames if f[5])])
        self.data, self.base = self.data[first - self.base :], first
        return rows

    def finish(self) -> list[tuple]:
        open_ = not self.failed and (self.frames or self.base + len(self.data) > self.pos)
        return [(self.frames[0][3] if self.frames else self.pos, None, None, None, None, None, None, None, "Truncated")] if open_ else []

    def _cut(self, a: int, b: int) -> bytes:
        return self.data[a - self.base : b - self.base]

    def _path(self, depth: int) -> list[int]:
        return [f[2] for f in self.frames[:depth]]

    def _close(self, rows: list[tuple], end: int, after: int) -> None:
        _, stop, tag, unit, start, ends, _ = self.frames[-1]
        if ends:
            rows.append((unit, self._path(len(self.frames)), tag, None, self._cut(unit, after), self._cut(start, end), end - start, True, None))
        self.frames.pop()

    def _step(self, rows: list[tuple]) -> bool:
        """Takes one unit, or what there is of a payload that isn't looked into; false where bytes have run out."""
        fed = self.base + len(self.data)
        node, stop, *_ = frame = self.frames[-1] if self.frames else [0, 1 << 62, 0, 0, 0, False, 0]
        if self.frames and self.pos == stop:
            self._close(rows, stop, stop)
            return True
        if self.pos == fed:
            return False
        if node < 0 and stop >= 0:
            self.pos = min(stop, fed)
            return True
        # A group goes as far as the payload around it.
        limit = min([f[1] for f in self.frames if f[1] >= 0], default=1 << 62)
        unit = self.pos
        tag, at = self._varint(unit, limit, 5, 15, unit)
        kind, number = tag & 7, tag >> 3
        if not number or kind > I32 or kind in (SGROUP, EGROUP) and not self.groups:
            raise _Bad("InvalidTag", unit)
        if kind == EGROUP:
            if not self.frames or frame[1] >= 0 or frame[2] >> 3 != number:
                raise _Bad("MalformedGroup", unit)
            self._close(rows, unit, at)
            self.pos = at
            return True
        if self.edges is None:
            to, ends, more = -1, not self.frames, False
        else:
            to, ends, more = self.edges.get((node, tag), (-1, False, False))
        if kind == SGROUP:
            self.frames.append([to if more else -1, -1, tag, unit, at, ends, at])
            self.pos = at
            return True
        if kind == LEN:
            size, at = self._varint(at, limit, 5, 15, unit)
            if at + size > limit:
                raise _Bad("Malformed", unit)
            self.frames.append([to if more else -1, at + size, tag, unit, at, ends, at])
            self.pos = at
            return True
        value = None
        if kind == VARINT:
            value, at = self._varint(at, limit, 10, 1, unit)
        else:
            width = 8 if kind == I64 else 4
            if at + width > limit:
                raise _Bad("Malformed", unit)
            if at + width > fed:
                raise _More
            value, at = int.from_bytes(self._cut(at, at + width), "little"), at + width
        if ends:
            value = value - (1 << 64) if value >= 1 << 63 else value
            rows.append((unit, [*self._path(len(self.frames)), tag], tag, value, self._cut(unit, at), None, None, True, None))
        self.pos = at
        return True


#: Bytes of a stream's chunks that one row takes through a shuffle, about.
RUN_BYTES = 1 << 14


def _longs(x: pa.Array) -> np.ndarray:
    """seq, null before all others."""
    return pc.fill_null(x.cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)


def _changes(names: pa.Array) -> np.ndarray:
    """Where another stream begins."""
    code = pc.fill_null(names.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], code[1:] != code[:-1]])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that follow one another in a table, as in their stream, in one row; seq is the first one's."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names, seq, chunk, last = batch.columns
        at, part = _longs(seq), np.cumsum(_longs(pc.fill_null(pc.binary_length(chunk), 0))) // RUN_BYTES
        new = _changes(names)
        new[1:] |= (at[1:] - at[:-1] != 1) | (part[1:] != part[:-1]) | (at[:-1] == -(1 << 63))
        starts = np.flatnonzero(new)
        bounds, starts = pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(starts)
        yield pa.RecordBatch.from_arrays([names.take(starts), seq.take(starts), *(pa.ListArray.from_arrays(bounds, x) for x in (seq, chunk, last))], names=RUNS.names)


def _in_step(names: pa.Array, chunk: pa.Array, bounds: np.ndarray, tree: Tree | None, groups: bool, kinds: T.StructType) -> tuple[list[pa.RecordBatch], list[int]]:
    """Rows of streams (bounds: their chunks) whose bytes are whole messages, and the places of those that aren't."""
    data, at, _ = buffers(chunk)
    at, found, odd = at[bounds], [], []
    column = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at[0] : at[-1]]))])
    for lo, hi in slices(column):
        part, own = column.slice(lo, hi - lo), names.slice(lo, hi - lo)
        got = decode_batch(part, groups, _TOP) if tree is None else walk_batch(part, tree, groups, False, _MATCH)
        fields, error = got.flatten()[:2]
        fine = np.asarray(error.is_null(), bool)
        odd += (lo + np.flatnonzero(~fine)).tolist()
        row = np.repeat(np.arange(hi - lo), pc.list_value_length(fields).to_numpy(zero_copy_only=False))
        cells = dict(zip(_TOP if tree is None else _MATCH, fields.flatten().flatten(), strict=True))
        begin, end = (cells[n] for n in (("offset", "end") if tree is None else ("begin", "end")))
        keep = pa.array(np.flatnonzero(fine[row]))
        raw, base, _ = buffers(part)
        build = {
            "stream_id": lambda: own.take(pa.array(row)), "offset": lambda: begin.cast(pa.int64()),
            "path": lambda: pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32)), cells["tag"]) if tree is None else cells["path"],
            "tag": lambda: cells["tag"] if tree is None else _last(cells["path"]),
            "varint": lambda: pc.coalesce(cells["varint"], cells["fixed32"], cells["fixed64"]), "raw": lambda: gather(raw, base[row] + _longs(begin), base[row] + _longs(end), apart=False),
            "payload": lambda: cells["bytes" if tree is None else "payload"], "length": lambda: pc.binary_length(cells["bytes" if tree is None else "payload"]).cast(pa.int64()),
            "is_last": lambda: pa.array(np.ones(len(row), bool)), "error": lambda: pa.nulls(len(row), pa.string()),
        }
        found.append(pa.RecordBatch.from_arrays([build[n]().take(keep).cast(_ARROW[n]) for n in kinds.names], names=kinds.names))
    return found, odd


def _last(lists: pa.Array) -> pa.Array:
    """The last elements of lists that have some."""
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return lists.flatten().take(pa.array(ends - 1))


def _of_chunks(chunks: DataFrame, paths: Sequence[Path] | None, partial: bool, groups: bool, members: Sequence[str] | None) -> DataFrame:
    def take(walker: Walker, name: str, got: pd.DataFrame) -> tuple[list[tuple], bool]:
        got = got.sort_values("seq", kind="stable")
        rows = [(name, *r) for c in got["chunk"] if c is not None for r in walker.feed(bytes(c))]
        ended = bool(got["last"].fillna(False).any())
        return rows + [(name, *r) for r in (walker.finish() if ended else [])], ended

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=OUT.names).astype({"offset": "Int64", "tag": "Int64", "varint": "Int64", "length": "Int64", "is_last": "boolean"})

    def feed(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        walker = Walker(paths, groups, partial)
        if state.exists:
            tail, walker.base, walker.pos, frames, walker.failed = state.get
            walker.data, walker.frames = bytes(tail), json.loads(frames)
        rows, ended = take(walker, key[0], pd.concat(list(batches)))
        if ended:
            state.remove()
        else:
            state.update((walker.data, walker.base, walker.pos, json.dumps(walker.frames), walker.failed))
        yield frame(rows)

    def loop(walker: Walker, name: str | None, got: list[tuple[int, bytes | None, bool | None]]) -> list[tuple]:
        return [(name, *r) for _, chunk, _ in got for r in walker.feed(chunk or b"")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams one behind another, each in the order of seq: those that end in a batch in step, what goes on in the next one by a walker."""
        walker, name, ended, rest = Walker(paths, groups, partial), None, False, None

        def finished() -> list[tuple]:
            return loop(walker, name, rest) + [(name, *r) for r in (walker.finish() if ended or any(x[2] for x in rest) else [])]

        for batch in batches:
            if not batch.num_rows:
                continue
            names, first, seqs, chunk, last = batch.columns
            new = _changes(names)
            starts = np.flatnonzero(new)
            run = np.repeat(np.cumsum(new) - 1, pc.list_value_length(seqs).to_numpy(zero_copy_only=False))
            seq = _longs(seqs.flatten())
            order = np.lexsort((seq, run))
            seq, run, chunk, last = seq[order], run[order], chunk.flatten().take(pa.array(order)), last.flatten().take(pa.array(order))
            names, bounds = names.take(pa.array(starts)), np.searchsorted(run, np.arange(len(starts) + 1))

            def chunks_of(r: int, seq=seq, chunk=chunk, last=last, bounds=bounds) -> list[tuple[int, bytes | None, bool | None]]:
                lo, n = bounds[r], bounds[r + 1] - bounds[r]
                return list(zip(seq[lo : lo + n].tolist(), chunk.slice(lo, n).to_pylist(), last.slice(lo, n).to_pylist(), strict=True))

            rows: list[tuple] = []
            lo, hi = 0, len(starts) - 1
            if rest is not None and names[0].as_py() == name:
                rest = sorted(rest + chunks_of(0), key=lambda x: x[0])
                lo = 1
            if rest is not None and (hi > 0 or lo == 0):
                rows += finished()
                rest = None
            if not partial and lo < hi:
                found, odd = _in_step(names.slice(lo, hi - lo), chunk, bounds[lo : hi + 1], tree, groups, kinds)
                yield from found
                odd = [lo + r for r in odd]
            else:
                odd = list(range(lo, hi))
            for r in odd:
                walker.reset()
                name, ended, rest = names[r].as_py(), False, chunks_of(r)
                rows += finished()
                rest = None
            if rest is None:
                walker.reset()
                name, ended, rest = names[hi].as_py(), False, chunks_of(hi)
            # Chunks of the last stream that are still to come are none before the last row's first.
            upto = _longs(first)[-1]
            ready, rest = [x for x in rest if x[0] < upto], [x for x in rest if x[0] >= upto]
            ended |= any(x[2] for x in ready)
            rows += loop(walker, name, ready)
            yield arrow(rows)
        yield arrow(finished() if rest is not None else [])

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[n]) for i, n in enumerate(OUT.names) if n in kinds.names], names=kinds.names)

    kinds = T.StructType([f for f in OUT if f.name == "stream_id" or members is None or f.name in members])
    tree = None if paths is None else Tree.of(steps(paths))
    named = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), *CHUNK_NAMES[1:])
    if chunks.isStreaming:
        return named.groupBy("stream_id").applyInPandasWithState(feed, OUT, STATE, "append", "NoTimeout").select(*kinds.names)
    runs = named.withColumn("seq", F.col("seq").cast("long")).mapInArrow(_runs, RUNS)
    return runs.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(whole, kinds)


def fields_of_chunks(chunks: DataFrame, partial: bool = False, groups: bool = False, members: Sequence[str] | None = None) -> DataFrame:
    """Rows of OUT, one for each top-level field, from stream_id, seq, chunk, last (a stream, append mode, or a table).

    A whole field comes with is_last; with partial, a delimited field or a group
    that a chunk leaves open comes with its payload so far, is_last false, and
    its full length if that is known. last ends a stream: an unfinished field is
    then an error row, Truncated, and the state is dropped. After a bad field a
    stream gives one error row and nothing more until its last. Chunks of one
    micro-batch are taken by seq; a stream's micro-batches must come in order.
    Null chunks have no bytes. State is the open field, so at most one message
    limit per stream; what was parsed isn't parsed again. members names the columns
    of OUT that are wanted besides stream_id (all, unless given).
    """
    return _of_chunks(chunks, None, partial, groups, members)


def paths_of_chunks(chunks: DataFrame, paths: Sequence[Path], partial: bool = False, groups: bool = False, members: Sequence[str] | None = None) -> DataFrame:
    """Rows of OUT, one for each match of a path, as fields_of_chunks; matches inside a payload come while it is open.

    Payloads off the paths are skipped as they come, and not kept. An error
    inside a payload is Malformed, where its unit starts.
    """
    return _of_chunks(chunks, list(paths), partial, groups, members)


def cut(messages: DataFrame, size: Column | int, msg: str = "msg", key: str = "stream_id") -> DataFrame:
    """Messages as chunks of a size: stream_id, seq, chunk, last."""
    step = F.lit(size) if isinstance(size, int) else size
    n = F.greatest(F.ceil(F.length(msg) / step).cast("int"), F.lit(1))
    rows = messages.select(F.col(key).alias("stream_id"), F.col(msg).alias("_m"), step.alias("_s"), n.alias("_n")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select("stream_id", F.col("seq").cast("long").alias("seq"), F.substring("_m", F.col("seq") * F.col("_s") + 1, F.col("_s")).alias("chunk"), (F.col("seq") == F.col("_n") - 1).alias("last"))
