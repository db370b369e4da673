"""Benchmark decontamination by winnowing.

Of every 6 consecutive hashes of 5-word grams, the least is kept (the last one
on ties). A shared span of 10 words holds 6 such grams, so both sides keep the
same one of them: joining the kept grams misses no shared window. Each joined
pair is then extended word by word to both sides, and counts where the common
run has 10 words. Items of fewer words are looked for as whole grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes as B
from . import _filter
from ._shared import few_files, fresh, hinted, keep, released, struct_of, without

MARK = T.ArrayType(struct_of(fp="long", pos="int", size="int", around="[long]"))
MARKED = struct_of(n_words="long", marks=MARK)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, their rows, and each row's first word."""
    lower = B.LOWER[data]
    starts, ends = B.runs(B.ALNUM[lower], offsets)
    row, first = B.rows_of(starts, offsets)
    return B.span_hash(B.prefix_hash(lower), starts, ends), row, first


def winnow(words: np.ndarray, row: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of the kept k-grams."""
    span = window - k + 1
    g = B.grams(words, k)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[span - 1 : span - 1 + n].copy(), np.arange(span - 1, span - 1 + n)
    for i in range(span - 2, -1, -1):
        less = g[i : i + n] < best
        best[less] = g[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at[row[:n] == row[window - 1 :]])


def _marks(column: pa.Array, window: int, k: int, sizes: list[int], wanted: np.ndarray | None) -> pa.Array:
    """The grams of each text that may join: wanted is the filter, None for the benchmark itself.

    sizes: lengths of items below the window; of a text they take all grams of
    that many words, of an item only the one that is the whole item.
    """
    n_words = np.zeros(len(column), np.int64)
    parts: list[tuple[np.ndarray, ...]] = []
    side = window - k
    for lo, hi, data, offsets in B.chunks(column):
        words, row, first = _words(data, offsets)
        n_words[lo:hi] = np.diff(first)
        at = winnow(words, row, window, k)
        found = [(at, B.grams(words, k)[at] if len(at) else np.zeros(0, B.U), np.full(len(at), k))]
        for n in range(1, window) if wanted is None else sizes:
            grams = B.grams(words, n)
            if wanted is None:
                at = first[:-1][np.diff(first) == n]
            else:
                at = np.flatnonzero(row[: len(grams)] == row[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
            found.append((at, B.combine(grams[at], n) if len(at) else np.zeros(0, B.U), np.full(len(at), -n)))
        at, fp, size = (np.concatenate(x) for x in zip(*found, strict=True))
        if wanted is not None:
            ok = _filter.passes(wanted, fp)
            at, fp, size = at[ok], fp[ok], size[ok]
        order = np.argsort(at, kind="stable")
        at, fp, size = at[order], fp[order], size[order]
        r = row[at] if len(at) else np.zeros(0, np.int64)
        # Words around the gram; 0 stands for what lies outside the text.
        idx = at[:, None] + np.concatenate([np.arange(-side, 0), np.arange(k, k + side)])[None, :]
        inside = (idx >= first[r][:, None]) & (idx < first[r + 1][:, None]) & (size > 0)[:, None]
        around = np.where(inside, words[np.clip(idx, 0, max(len(words) - 1, 0))] | B.U(1), B.U(0)) if len(at) else np.zeros((0, 2 * side), B.U)
        parts.append((r + lo, fp.view(np.int64), at - first[r], size, around))
    row, fp, pos, size, around = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4 + (np.zeros((0, 2 * side)),)
    flat = pa.array(np.ascontiguousarray(around).view(np.int64).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * (2 * side)), flat)
    marks = pa.StructArray.from_arrays([pa.array(fp.astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32)), lists], names=["fp", "pos", "size", "around"])
    bounds = np.searchsorted(row, np.arange(len(column) + 1)).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(n_words), pa.ListArray.from_arrays(pa.array(bounds), marks)], names=["n_words", "marks"])


def _marker(window: int, k: int, sizes: list[int], wanted: bytes | None):
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = None if wanted is None else np.frombuffer(wanted, np.uint8)
        for column in batches:
            for i in range(0, len(column), 2000):
                # marks of one slice at a time; the pieces make one array again
                if i == 0:
                    made = []
                made.append(_marks(column[i : i + 2000], window, k, sizes, bits))
            yield pa.concat_arrays(made) if len(column) else _marks(column, window, k, sizes, bits)

    mark.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    mark = released(mark)
    return F.arrow_udf(mark, MARKED).asNondeterministic()


@F.arrow_udf(struct_of(left="int", right="int"))
def _extend(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many words in a row agree on each side of a joined gram."""
    n = len(a)
    x, y = (np.asarray(v.flatten(), np.int64).reshape(n, -1) for v in (a, b))
    side = x.shape[1] // 2 if n else 0
    same = (x == y) & (x != 0)
    left = np.minimum.accumulate(same[:, :side][:, ::-1], axis=1).sum(axis=1) if n else np.zeros(0)
    right = np.minimum.accumulate(same[:, side:], axis=1).sum(axis=1) if n else np.zeros(0)
    return pa.StructArray.from_arrays([pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], names=["left", "right"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per row of docs: the id, n_words, n_hit, item_ids (sorted strings) and contaminated.

    Null and empty texts have no words and are clean; items without words hit
    nothing. Items with one id count once; a null item id hits words but is not
    listed. Repeated rows and null ids keep a row each. An empty benchmark
    leaves all clean. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), _marker(window, k, [], None)(F.col(text_col)).alias("m"))
    items = items.select("item", F.explode("m.marks").alias("m")).select("item", "m.fp", "m.size", "m.around").distinct()
    # A gram with what lies around it is one class, whatever items have it.
    items = keep(items.groupBy("fp", "size", "around").agg(F.collect_set("item").alias("ids")).withColumn("class", F.monotonically_increasing_id()), "items")
    sizes = sorted(-r["size"] for r in items.select("size").filter("size < 0").distinct().collect())  # below the window
    marked = docs.select(F.col(id_col), _marker(window, k, sizes, _filter.make(items, "fp"))(F.col(text_col)).alias("m"))
    marked = keep(marked.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), "m.n_words", "m.marks"), "marks")

    marks = marked.select("row", F.explode("marks").alias("m")).select("row", "m.fp", "m.pos", "m.size", F.col("m.around").alias("mine"))
    met = marks.join(hinted(items.drop("ids")), ["fp", "size"]).select("row", "pos", "size", "class", _extend("mine", "around").alias("e"))
    short = F.col("size") < 0
    run = F.when(short, -F.col("size")).otherwise(F.lit(k) + F.col("e.left") + F.col("e.right"))
    met = met.filter(short | (run >= window)).select(
        "row", "pos", "class",
        F.when(short, F.col("pos")).otherwise(F.col("pos") - F.col("e.left")).alias("a"),
        F.when(short, F.col("pos") - F.col("size")).otherwise(F.col("pos") + k + F.col("e.right")).alias("b"),
    )
    # Runs of one gram overlap in it, so their union is one run.
    hits = met.groupBy("row", "pos").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.collect_set("class").alias("classes"))
    before = Window.partitionBy("row").orderBy("a", "b", "pos").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce(F.max("b").over(before), F.lit(0))))
    found = keep(hits.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("classes"))).alias("classes")), "found")
    ids = found.select("row", F.explode("classes").alias("class")).join(hinted(items.select("class", "ids")), "class")
    ids = ids.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"))
    out = marked.select("row", "id", "n_words").join(found.select("row", "n_hit").join(ids, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.array_sort(F.coalesce("items", none)).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 10, k: int = 5) -> DataFrame:
    """The rows of docs, all columns, that share no window with the benchmark.

    Null, empty and wordless texts share none and stay; repeated rows stay or go
    together. docs is written with a number for each row, so it need not give the
    same rows again.
    """
    name = fresh(docs, "_row")
    rows = keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    got = decontaminate(rows, benchmark, window, k, name, text_col, item_col)
    return few_files(without(rows, keep(got.filter("contaminated").select(name), "hits"), name).select(*docs.columns), docs)
