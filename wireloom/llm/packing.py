"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest sequence are cut; full pieces fill a sequence
each. All other pieces go, longest first, to the open sequence that they fill
best, whatever its length. Where none has room, the length is opened that costs
least per token, given what the pieces that are still to come can fill up. In
the end every sequence shrinks to the shortest length that holds its contents.
Documents are dealt by hash to groups of a fixed mean size, packed one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes as B
from ._shared import keep, released, struct_of

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Pieces of a group, on average: enough for a tight packing, some MB in a task.
GROUP = 50_000


def cost(length: int) -> float:
    """Of computing one sequence: a fixed part, one per token, and attention's square."""
    return 64 + length + length * length / 16384


def best_fit(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs sizes, sorted from large to small: each piece's bin and offset, and each bin's final length.

    Greedy choices don't see far, so the packing is also made without the longest
    lengths, as far as all pieces fit, and the one that costs least in all is taken.
    """
    lengths = sorted(lengths)
    ways = [lengths[:k] for k in range(len(lengths), 0, -1) if not len(sizes) or lengths[k - 1] >= sizes[0]]
    return min((_fit(sizes, way, cost) for way in ways), key=lambda got: sum(n * cost(int(c)) for c, n in zip(*np.unique(got[2], return_counts=True), strict=True)))


def _fit(sizes: np.ndarray, lengths: list[int], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top = lengths[-1]
    price = [cost(c) for c in lengths]
    size = sizes.tolist()
    n = len(size)
    behind = np.append(np.cumsum(sizes[::-1])[::-1], 0).tolist()  # tokens from a piece on
    fits = np.searchsorted(-sizes, -np.arange(top + 1), "left").tolist()  # first piece of at most x tokens
    room: list[list[int]] = [[] for _ in range(top + 1)]  # open bins by free tokens
    some = 0  # bit x: room[x] isn't empty
    free = 0
    used: list[int] = []
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, s in enumerate(size):
        at = some >> s
        if at:
            left = s + (at & -at).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
            free -= left
        else:
            best, left = None, 0
            for c, p in zip(lengths, price, strict=True):
                if c >= s:
                    coming = max(0, behind[max(i + 1, fits[c - s])] - free)
                    each = p / (s + min(c - s, coming))
                    if best is None or each < best:
                        best, left = each, c
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += s
        left -= s
        room[left].append(b)
        some |= 1 << left
        free += left
    final = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, final


@F.arrow_udf(T.LongType())
@released
def _word_tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        out = np.ones(len(column), np.int64)
        for lo, hi, data, offsets in B.chunks(column):
            starts, _ = B.runs(B.NOT_SPACE[data], offsets)
            out[lo:hi] += np.diff(np.searchsorted(starts, offsets))
        yield pa.array(out)


def word_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens of each row: its words and one end; a null text has the end only."""
    return docs.select(F.col(id_col), _word_tokens(F.col(text_col)).alias("n_tokens"))


def pack(items: DataFrame, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", tokens_col: str = "n_tokens", group: int = GROUP) -> DataFrame:
    """One row per piece: the id, piece, start and n_tokens, sequence, place in it and its length.

    sequence is a string, unique in the result. Rows with null or no tokens
    aren't packed. Repeated rows and null ids are items of their own. The order
    of equal pieces is by id, so the packing doesn't depend on how rows lie in
    files.
    """
    top = max(lengths)
    # Equal rows are numbered, so that they spread over the groups as others do.
    rows = items.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("long").alias("n")).filter("n > 0")
    rows = keep(rows.groupBy("id", "n").agg(F.count(F.lit(1)).alias("copies")), "items")
    count = rows.agg(F.sum(F.ceil(F.col("n") / top) * F.col("copies"))).first()[0] or 0
    n_groups = max(1, -(-int(count) // group))
    rows = rows.select("id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    pieces = rows.select("id", "n", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))).alias("piece"))
    start = F.col("piece") * top
    pieces = pieces.select("id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(top)).alias("n"), F.pmod(F.xxhash64("id", "n", "copy", "piece", F.lit("packing")), F.lit(n_groups)).alias("part"))
    id_type = rows.schema["id"].dataType

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("id", "ascending"), ("piece", "ascending")])
        bins, offsets, final = best_fit(table["n"].to_numpy(), lengths)
        part = table["part"][0].as_py()
        names = pa.array([f"{part}-{b}" for b in range(len(final))])
        return table.select(["id", "piece", "start", "n"]).append_column("sequence", names.take(pa.array(bins))).append_column("place", pa.array(offsets)).append_column("length", pa.array(final[bins]))

    out = struct_of(id=id_type, piece="long", start="long", n="long", sequence="string", place="long", length="long")
    return pieces.groupBy("part").applyInArrow(run, out).withColumnsRenamed({"id": id_col, "n": tokens_col})


def contents(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_col: str = "n_tokens") -> DataFrame:
    """sequence, length and texts: the words of each piece (packed by word_tokens), in their places.

    ids must be unique in docs. A document's end token has no text.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    texts = docs.select(F.col(id_col).alias("id"), words.alias("words"))
    pieces = packed.select(F.col(id_col).alias("id"), "sequence", "length", "place", (F.col("start") + 1).cast("int").alias("start"), F.col(tokens_col).cast("int").alias("n"))
    got = pieces.join(texts, "id").select("sequence", "length", F.struct("place", "id", F.array_join(F.slice("words", F.col("start"), F.col("n")), " ").alias("text")).alias("p"))
    return got.groupBy("sequence", "length").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]).alias("texts"))
