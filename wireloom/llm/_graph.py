"""Connected components of a table of edges, by union-find and stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import hold, join_hot, keep, struct_of

EDGE = struct_of(a="long", b="long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over what a partition holds: each node and the least node it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


#: Edges of a partition when partitions are contracted: some 50 MB in a worker.
EDGES_AT_ONCE = 250_000


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b longs) but the roots themselves.

    root is the least node of the component. Each round counts the edges and
    contracts partitions of a bounded number of them by union-find; if that is
    one partition, it is done. Else each node is joined to the least node around
    it (large and small stars), until every node hangs on a root; the number of
    rounds grows with the logarithm of the longest chain.
    """
    e = edges.filter("a <> b").select("a", "b")
    while True:
        held = hold(e)
        parts = max(1, -(-held.count() // EDGES_AT_ONCE))
        e = keep(held.repartition(parts).mapInArrow(_forest, EDGE), "forest")
        held.unpersist()
        found = e.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
        if parts == 1:
            return found
        # Done when no root hangs on another node and none has two.
        again = e.join(e.select(F.col("b").alias("x")).distinct(), e["a"] == F.col("x"), "left_semi").limit(1).count()
        if not again and not e.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter("lo <> hi").limit(1).count():
            return found
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_hot(both, least, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large.filter("a <> b"), "stars")
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = join_hot(large, least, ["a"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = small.union(least).distinct()
