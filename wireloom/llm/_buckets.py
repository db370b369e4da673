"""Nodes that share a key become edges: local stars, and one shuffle of packed arrays.

Each task joins what shares a key among its own nodes, and hands on one node for
each key, packed by shard. A key that very many nodes share so comes to its
shard once for each GATHER keys of a task, not once for each node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _bytes as B
from ._graph import EDGE
from ._shared import released, struct_of

PARTS = struct_of(shard="long", kind="int", a="binary", b="binary")
KEYS, EDGES = 0, 1
#: Key entries that a task of the key grouping should hold, about.
SHARD_KEYS = 500_000
#: Keys that a task gathers before it hands them on.
GATHER = 300_000

Keyed = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least node, and distinct edges from there to the keys' other nodes."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(nodes, first) if len(keys) else nodes
    hub = np.repeat(least, np.diff(np.append(first, len(keys))))
    other = hub != nodes
    return keys[first], least, *distinct(hub[other], nodes[other])


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def shard_bits(n_keys: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n_keys / SHARD_KEYS)))))


def _pack(found: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    keys, nodes, a, b = stars(*(np.concatenate(x) for x in zip(*found, strict=True)))
    shard = (keys >> B.U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    home = [int(B.mix(nodes[:1])[0]) >> (64 - bits) if bits else 0] if len(a) else []  # any shard will do for edges
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard[cut[:-1]].tolist() + home, pa.int64()),
            pa.array([KEYS] * len(spans) + [EDGES] * len(home), pa.int32()),
            pa.array([keys[i:j].tobytes() for i, j in spans] + [a.tobytes()] * len(home), pa.binary()),
            pa.array([nodes[i:j].tobytes() for i, j in spans] + [b.tobytes()] * len(home), pa.binary()),
        ],
        names=PARTS.names,
    )


def _parts(keyed: Keyed, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for keys, nodes in keyed(batch):
                found.append((keys, nodes))
                n += keys.size
                if n >= GATHER:
                    yield _pack(found, bits)
                    found, n = [], 0
        if n:
            yield _pack(found, bits)

    return run


def _meet(table: pa.Table) -> pa.Table:
    parts: dict[int, list] = {KEYS: [], EDGES: []}
    for kind, a, b in zip(*(table[c].combine_chunks() for c in ("kind", "a", "b")), strict=True):
        parts[kind.as_py()].append((np.frombuffer(a.as_py(), B.U), np.frombuffer(b.as_py(), B.U)))
    edges = parts[EDGES]
    if parts[KEYS]:
        edges = [*edges, stars(*(np.concatenate(x) for x in zip(*parts[KEYS], strict=True)))[2:]]
    a, b = distinct(*(np.concatenate(x) for x in zip(*edges, strict=True)))
    return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def edges(rows: DataFrame, keyed: Keyed, n_keys: int) -> DataFrame:
    """Edges (a, b) that join all nodes with a common key.

    keyed gives keys and their nodes (unsigned longs) of a batch of rows; n_keys is about how many there are.
    """
    return rows.mapInArrow(released(_parts(keyed, shard_bits(n_keys))), PARTS).groupBy("shard").applyInArrow(_meet, EDGE)
