"""Columnar helpers on UTF-8 bytes, shared by the text operators.

A batch of texts is one byte array plus row offsets. Words are runs of bytes of
a class: every class used here holds whole code points (all bytes >= 0x80 fall
on the same side), so byte work gives the same words as code point work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
CHUNK_BYTES = 1 << 19


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
STARTS = ~byte_class((0x80, 0xBF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about limit bytes: first row, end row, bytes, offsets.

    A longer text is a run of its own, so that memory follows the longest text
    and not the batch.
    """
    data, offsets = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a row's border."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the \\n-split lines; every row has one at least."""
    cut = np.flatnonzero(data == 0x0A)
    row = np.searchsorted(offsets, cut, "right") - 1
    n_rows = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], cut + 1])
    ends = np.concatenate([cut, offsets[1:]])
    rows = np.concatenate([np.arange(n_rows), row])
    order = np.lexsort((starts, rows))
    ends_rows = np.concatenate([row, np.arange(n_rows)])
    ends = ends[np.lexsort((ends, ends_rows))]
    return starts[order], ends, rows[order]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche (splitmix64's)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def combine(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A hash of an ordered pair of hashes."""
    b = U(b & (2**64 - 1)) if isinstance(b, int) else b.astype(U, copy=False)
    return mix(a.astype(U, copy=False) * U(BASE) + b + U(0x632BE59BD9B4E019))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers the bytes before i."""
    out = np.zeros(len(data) + 1, U)
    up, _ = _power(len(data) + 1)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix_hash of the array they lie in."""
    if len(starts) == 0:
        return np.zeros(0, U)
    _, down = _power(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags over the rows' byte ranges."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted starts: the row of each, and where each row's own begin."""
    first = np.searchsorted(starts, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def seen_twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice) == 0:
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position on; positions near the end are cut off."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = mix(words[:m] + U(n))
    for i in range(1, n):
        out = combine(out, words[i : m + i])
    return out
