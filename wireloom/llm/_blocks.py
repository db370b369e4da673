"""Exact comparison inside families of candidates, a bounded block at a time."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import EDGE, components
from ._shared import hinted, hold, join_hot, keep, released

#: Nodes of a block; a task compares two blocks at a time.
BLOCK = 256
#: Nodes of a family, and under a key, up to which all meet at once where keys are given.
FEW = 16
Linked = Callable[[list[list[bytes]]], list[tuple[np.ndarray, np.ndarray]]]


def keyed_blocks(nodes: DataFrame) -> DataFrame:
    """Rows (node, root, level, rest, items) to rows (key, node, items): every two that may link meet under some key.

    Only nodes of a family (root) on the same or neighbouring levels may link,
    and of two nodes one at least must be marked rest. A family's levels are
    cut into blocks by hash, rest and others apart; each two blocks that may
    have links share a key.
    """
    parts = F.struct(*(F.ceil(F.count_if(F.col("rest") == flag) / BLOCK).cast("int").alias(side) for side, flag in (("rest", True), ("main", False))))
    levels = nodes.groupBy("root", "level").agg(parts.alias("parts"))
    above = levels.select("root", (F.col("level") - 1).alias("level"), F.col("parts").alias("above"))
    below = levels.select("root", (F.col("level") + 1).alias("level"), F.col("parts").alias("below"))
    around = levels.join(above, ["root", "level"], "left").join(below, ["root", "level"], "left")
    own = join_hot(nodes, around, ["root", "level"])
    mine = F.struct(F.col("level").alias("l"), F.col("rest").cast("int").alias("r"), F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("parts.rest")).otherwise(F.col("parts.main"))).cast("int").alias("p"))

    def keys(step: int, parts: str, side: str) -> Column:
        n, may = F.col(f"{parts}.{side}"), F.col("rest") if side == "main" else F.lit(True)
        others = F.when(may & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def key(other: Column) -> Column:
            its = F.struct((F.col("level") + step).alias("l"), F.lit(int(side == "rest")).alias("r"), other.alias("p"))
            lo, hi = F.least(F.col("mine"), its), F.greatest(F.col("mine"), its)
            return F.concat_ws(":", F.col("root"), *(x[c] for x in (lo, hi) for c in "lrp"))

        return F.transform(others, key)

    met = [keys(step, parts, side) for step, parts in ((0, "parts"), (1, "above"), (-1, "below")) for side in ("rest", "main")]
    return own.withColumn("mine", mine).select(F.explode(F.array_distinct(F.concat(*met))).alias("key"), "node", "items")


def _own_blocks(nodes: DataFrame, salt: int) -> DataFrame:
    """Rows (key, node, items): each level of each family in blocks that don't meet."""
    parts = nodes.groupBy("root", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("parts"))
    return join_hot(nodes, parts, ["root", "level"]).select(F.concat_ws(":", "root", "level", part).alias("key"), "node", "items")


def family_components(nodes: DataFrame, linked: Linked, split: Callable[[DataFrame], DataFrame] | None = None, keys: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (node, root, level, items) to the components of all links inside families, as components gives them.

    nodes are read several times. A family of at most BLOCK nodes is compared
    whole. The nodes of larger ones are first split into finer families, if split
    is given: it gets their rows and gives edges between those that may link. If
    keys is given, it gets the rows of families of over FEW nodes and gives rows
    (key, node), where every two nodes that may link have a key in common: up to
    FEW nodes meet under their key only, so that many that are merely near one
    text don't all meet; of a family only those with a more common key go on. In
    one that is still larger each node first meets its own block only, then one
    node of each component does, as long as that halves them: copies of one text,
    however many, become one component in passes that read each node once. Then
    all blocks meet but those of the family's largest component among themselves,
    whose nodes are connected already. So what is read grows with the product of
    a finer family's nodes and those outside its largest component.
    """

    def meet(keyed: DataFrame) -> DataFrame:
        return spanning_links(keyed, linked)

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("root").cast("string").alias("key"), "node", "items")

    def joined(found: DataFrame, edges: DataFrame) -> DataFrame:
        return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges))

    def apart(rows: DataFrame, most: int = BLOCK) -> tuple[DataFrame, DataFrame, bool]:
        """Families of up to so many nodes, the larger ones, and whether there are any."""
        big = hinted(keep(rows.groupBy("root").count().filter(F.col("count") > most).select("root"), "big"))
        return rows.join(big, "root", "left_anti"), rows.join(big, "root", "left_semi"), not big.isEmpty()

    small, large, any_ = apart(nodes, FEW if keys else BLOCK)
    at_once, freed = whole(small), []
    if any_ and split:
        finer = components(split(large))
        finer = finer.union(finer.select(F.col("root").alias("node"), "root").distinct())
        large = hold(large.drop("root").join(finer, "node"))
        freed.append(large)
        small, large, any_ = apart(large)
        at_once = at_once.union(whole(small))
    if any_ and keys:
        large = hold(large.dropDuplicates(["node"]))
        keyed = hold(keys(large))
        freed += [large, keyed]
        shared = keep(keyed.groupBy("key").count().filter("count > 1"), "shared")
        few = join_hot(keyed, shared.filter(F.col("count") <= FEW).select("key"), ["key"])
        at_once = at_once.union(few.join(large.select("node", "items"), "node").select(F.concat(F.lit("key "), "key").alias("key"), "node", "items"))
        common = join_hot(keyed, shared.filter(F.col("count") > FEW).select("key"), ["key"]).select("node").distinct()
        small, large, any_ = apart(large.join(hinted(keep(common, "common")), "node", "left_semi"))
        at_once = at_once.union(whole(small))
    edges = meet(at_once)
    if not any_:
        found = components(edges)
        for x in freed:
            x.unpersist()
        return found
    large = hold(large.select("node", "root", "level", "items"))
    freed.append(large)
    n = large.count()
    found = components(edges.union(meet(_own_blocks(large, 0))))
    for salt in itertools.count(1):
        firsts = large.join(found, "node", "left_anti")
        sizes = firsts.groupBy("root", "level").count().agg(F.sum("count"), F.max("count")).first()
        before, n = n, sizes[0] or 0
        if (sizes[1] or 0) <= BLOCK:
            found = joined(found, meet(keyed_blocks(firsts.withColumn("rest", F.lit(True)))))
            break
        if 2 * n > before:
            break
        found = joined(found, meet(_own_blocks(firsts, salt)))
    of = large.select("node", "root", "level").join(found.withColumnRenamed("root", "of"), "node", "left").withColumn("of", F.coalesce("of", "node"))
    of = hold(of)
    freed.append(of)
    most = of.groupBy("root", "of").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max(F.struct("n", "of")).alias("most"))
    rest = keep(join_hot(of, most, ["root"]).filter(F.col("of") != F.col("most.of")).select("node", F.lit(True).alias("rest")), "rest")
    if not rest.isEmpty():
        marked = large.join(rest, "node", "left").withColumn("rest", F.coalesce("rest", F.lit(False)))
        found = joined(found, meet(keyed_blocks(marked)))
    for x in freed:
        x.unpersist()
    return found


#: Nodes whose keys a task compares in one go, about.
AT_ONCE = 4096


def _forest(nodes: list[int], pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs, as nodes, that join what earlier pairs haven't."""
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((nodes[a], nodes[b]))
    return out


def spanning_links(keyed: DataFrame, linked: Linked) -> DataFrame:
    """Rows (key, node, items) to edges (a, b): a spanning forest of each key's links.

    linked gets the items of many keys and gives all linking pairs of each, by
    position. A node that comes several times under a key counts once.
    """

    def decide(groups: list[dict[int, bytes]]) -> pa.RecordBatch:
        groups = [g for g in groups if len(g) > 1]
        found = linked([list(g.values()) for g in groups]) if groups else []
        out = [e for g, (a, b) in zip(groups, found, strict=True) for e in _forest(list(g), zip(a.tolist(), b.tolist(), strict=True))]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=EDGE.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, groups, held = None, [], 0  # rows come sorted by key
        for batch in batches:
            for k, node, item in zip(*(batch.column(c) for c in ("key", "node", "items")), strict=True):
                k = k.as_py()
                if k != key:
                    if held >= AT_ONCE:
                        yield decide(groups)
                        groups, held = [], 0
                    key = k
                    groups.append({})
                groups[-1].setdefault(node.as_py(), item.as_py())
                held += 1
        yield decide(groups)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(released(run), EDGE)
