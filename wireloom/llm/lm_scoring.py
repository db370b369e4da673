"""Interpolated modified Kneser-Ney bigram model over the whole corpus.

Counting is two rounds of Spark grouping by shards of hashes: pairs by the
shard of their context, then words by their own. Contexts that are common enough
to weigh on a shard are counted first; their pairs go by the pair's own hash
instead, and their totals are summed over shards. Tasks combine what they have
read before anything is shuffled, so a common word costs a row per task. Each
shard of the model is a file of sorted hashes and their counts in the shared
folder; scoring tasks map the files and look up each batch's distinct words and
pairs in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._files import map_arrays, write_arrays
from ._shared import keep, new_dir, struct_of

BEGIN, END = B.U(0x51A7_0000_0000_0B01), B.U(0xE4D0_0000_0000_0E02)
#: Pairs of a shard, about; a task that makes or reads a shard holds 20 bytes of each.
SHARD_PAIRS = 1_000_000
#: Pairs that a counting task gathers before it hands them on.
GATHER = 1_500_000
CHUNK = B.CHUNK_BYTES
PARTS = struct_of(shard="long", first="binary", second="binary", count="binary")
WORD_PARTS = struct_of(kind="int", shard="long", word="binary", conts="binary", count="binary", stats="[long]")
HOT = struct_of(context="long", n="long")
TOTALS = struct_of(context="long", n="long", ones="long", twos="long", more="long")
NO_HOT = np.zeros(0, B.U)
SCORED = struct_of(n_tokens="long", n_known="long", base_score="double", score="double")


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end behind each; the token before each; each text's first."""
    lower = B.LOWER[data]
    starts, ends = B.runs(B.NOT_SPACE[lower], offsets)
    row, first = B.rows_of(starts, offsets)
    n_rows = len(offsets) - 1
    first = first + np.arange(n_rows + 1)
    words = np.full(len(starts) + n_rows, END, B.U)
    words[np.arange(len(starts)) + row] = B.span_hash(B.prefix_hash(lower), starts, ends)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1]] = BEGIN
    return words, before, first


def _shard(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> B.U(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _place(x: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x would lie in sorted_, and whether it does."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def _pair_key(before: np.ndarray, words: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """A hash of the pair whose first bits are its shard: the context's, and of hot contexts its own."""
    key = B.combine(before, words)
    if not bits:
        return key
    return np.where(_place(before, hot)[1], key, ((before >> B.U(64 - bits)) << B.U(64 - bits)) | (key >> B.U(bits)))


def _gathered(before: np.ndarray, words: np.ndarray, count: np.ndarray, bits: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs in the order of their keys, with summed counts."""
    key = _pair_key(before, words, bits, hot)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(count[order], first) if len(key) else count
    at = order[first]
    return key[first], before[at], words[at], total


def _common_contexts(share: float):
    """Contexts that make up that share of a chunk, with their counts there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in B.chunks(batch.column(0), CHUNK):
                before = _tokens(data, offsets)[1]
                context, n = np.unique(before, return_counts=True)
                often = n >= share * len(before)
                yield pa.RecordBatch.from_arrays([pa.array(context[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=HOT.names)

    return count


def _hot_contexts(text: DataFrame, n_tokens: int, most: int) -> np.ndarray:
    """All contexts seen more than `most` times, and none seen less than most / 2; sorted.

    n_tokens is at least the number of tokens; what chunks leave out of a
    context is less than most / 2 in all.
    """
    counts = text.mapInArrow(_common_contexts(most / 2 / n_tokens), HOT).groupBy("context").agg(F.sum("n").alias("n"))
    got = counts.filter(F.col("n") >= most / 2).select("context").toArrow()["context"].to_numpy()
    return np.sort(got.astype(np.int64).view(B.U))


def _count_pairs(bits: int, hot: np.ndarray):
    def emit(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, before, words, count = _gathered(*(np.concatenate(x) for x in zip(*held, strict=True)), bits, hot)
        shard = _shard(key, bits)
        order = np.lexsort((before, shard))  # equal contexts side by side compress well
        shard, before, words, count = shard[order], before[order], words[order], count[order].astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        cut = [(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shard[at[:-1]]), *(pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (before, words, count))], names=PARTS.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, data, offsets in B.chunks(batch.column(0), CHUNK):
                words, before, _ = _tokens(data, offsets)
                held.append(_gathered(before, words, np.ones(len(words), np.int64), bits, hot)[1:])
                n += len(held[-1][0])
                if n >= GATHER:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return count


def _tallies(counts: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3, 4, and 3 or more."""
    return np.array([*[(counts == i).sum() for i in range(1, 5)], (counts >= 3).sum()], np.int64)


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[column].combine_chunks()])


def _make_pairs(folder: str, bits: int, hot: np.ndarray):
    def make(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        key, before, words, count = _gathered(_joined(table, "first", B.U), _joined(table, "second", B.U), _joined(table, "count", np.uint32).astype(np.int64), bits, hot)
        write_arrays(f"{folder}/pairs-{shard}", [key, count.astype(np.uint32)])
        order = np.argsort(before)
        h, c = before[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ones = [np.add.reduceat(x, at) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))]
        # Contexts of this shard are whole here; of hot ones this is a share.
        h, shared = h[at], _place(h[at], hot)[1]
        write_arrays(f"{folder}/contexts-{shard}", [h[~shared], ones[0][~shared].astype(np.int64), *(x[~shared].astype(np.uint32) for x in ones[1:])])
        shares = np.stack([h.view(np.int64), *ones], axis=1)[shared].ravel()
        # To the words: in how many pairs of this shard they are second, and how often.
        order = np.argsort(words)
        w, c = words[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        conts, total, w = np.diff(np.append(at, len(w))), np.add.reduceat(c, at), w[at]
        goal = _shard(w, bits)
        cut = np.flatnonzero(np.concatenate([[True], goal[1:] != goal[:-1], [True]]))
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        none = [None, None]
        return pa.table(
            {
                "kind": pa.array([0] * len(spans) + [1, 2], pa.int32()),
                "shard": pa.array(goal[cut[:-1]].tolist() + [shard] * 2, pa.int64()),
                "word": pa.array([w[a:b].tobytes() for a, b in spans] + none, pa.binary()),
                "conts": pa.array([conts[a:b].astype(np.uint32).tobytes() for a, b in spans] + none, pa.binary()),
                "count": pa.array([total[a:b].astype(np.int64).tobytes() for a, b in spans] + none, pa.binary()),
                "stats": pa.array([None] * len(spans) + [_tallies(count).tolist(), shares.tolist()], pa.list_(pa.int64())),
            }
        )

    return make


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(TOTALS))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T.copy()], names=TOTALS.names)


def _make_words(folder: str):
    def make(table: pa.Table) -> pa.Table:
        word, conts, count = _joined(table, "word", B.U), _joined(table, "conts", np.uint32).astype(np.int64), _joined(table, "count", np.int64)
        order = np.argsort(word)
        word = word[order]
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        word, conts, count = word[at], np.add.reduceat(conts[order], at), np.add.reduceat(count[order], at)
        write_arrays(f"{folder}/words-{table['shard'][0].as_py()}", [word, count, conts])
        return pa.table({"stats": pa.array([[int(count.sum()), len(word), int(conts.sum()), *_tallies(conts).tolist()]], pa.list_(pa.int64()))})

    return make


def discounts(n: list[int]) -> tuple[float, float, float, float]:
    """Modified Kneser-Ney's, for counts of 0, 1, 2 and more, from how many counts are 1 to 4.

    Where a count of counts is 0, as in tiny corpora, they are 0.5, 1 and 1.5.
    """
    n1, n2, n3, n4 = n[:4]
    if not (n1 and n2 and n3 and n4):
        return 0.0, 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    got = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return (0.0, *(min(max(d, 0.0), float(i)) for i, d in enumerate(got, 1)))


@dataclass
class Model:
    folder: str
    bits: int  # 2**bits shards
    n_tokens: int
    n_words: int
    n_pairs: int
    word_tallies: list[int]
    pair_tallies: list[int]
    hot: np.ndarray  # sorted hashes of contexts whose pairs lie in all shards
    hot_totals: np.ndarray  # (4, hot): how many tokens follow; how many pairs are seen once, twice, more often


def fit(docs: DataFrame, text_col: str = "text", shard_pairs: int = SHARD_PAIRS) -> Model:
    """Counts all of docs; a null text is an empty one. The model lies in the shared folder."""
    spark = docs.sparkSession
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, n_rows = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, size / 6 / shard_pairs)))))
    folder = new_dir(spark, "lm")
    # A context that stays whole brings a quarter of a shard at most.
    hot = _hot_contexts(text, size // 2 + 2 * n_rows, max(1, shard_pairs // 4)) if bits else NO_HOT
    parts = text.mapInArrow(_count_pairs(bits, hot), PARTS)
    by_word = keep(parts.groupBy("shard").applyInArrow(_make_pairs(folder, bits, hot), WORD_PARTS), "lm-words")
    stats = by_word.filter("kind = 0").select("shard", "word", "conts", "count").groupBy("shard").applyInArrow(_make_words(folder), struct_of(stats="[long]"))

    def summed(df: DataFrame, n: int) -> list[int]:
        row = df.agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(str(i)) for i in range(n)]).first()
        return list(row)

    words = summed(stats, 8)
    totals = np.zeros((4, len(hot)), np.int64)
    if len(hot):
        shares = by_word.filter("kind = 2").select("stats").mapInArrow(_shares, TOTALS)
        got = shares.groupBy("context").agg(*[F.sum(c).alias(c) for c in TOTALS.names[1:]]).toArrow()
        at, _ = _place(got["context"].to_numpy().astype(np.int64).view(B.U), hot)
        for i, c in enumerate(TOTALS.names[1:]):
            totals[i, at] = got[c].to_numpy()
    return Model(folder, bits, words[0], words[1], words[2], words[3:], summed(by_word.filter("kind = 1"), 5), hot, totals)


class Reader:
    """Look-ups in the model's mapped files; lives in a worker."""

    TYPES = {"words": [B.U, np.int64, np.int64], "contexts": [B.U, np.int64, np.uint32, np.uint32, np.uint32], "pairs": [B.U, np.uint32]}

    def __init__(self, model: Model):
        self.model, self.open = model, {}
        self.d_pair, self.d_word = discounts(model.pair_tallies), discounts(model.word_tallies)

    def _arrays(self, name: str, shard: int) -> list[np.ndarray]:
        if (name, shard) not in self.open:
            try:
                got = map_arrays(f"{self.model.folder}/{name}-{shard}", self.TYPES[name])
            except FileNotFoundError:  # a shard that nothing fell into
                got = [np.zeros(0, t) for t in self.TYPES[name]]
            self.open[name, shard] = got
        return self.open[name, shard]

    def find(self, name: str, keys: np.ndarray) -> list[np.ndarray]:
        """The values of sorted keys, 0 for those that the table lacks."""
        out = [np.zeros(len(keys), np.int64) for _ in self.TYPES[name][1:]]
        shard = _shard(keys, self.model.bits)
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            table, *values = self._arrays(name, int(shard[a]))
            if len(table):
                at = np.minimum(np.searchsorted(table, keys[a:b]), len(table) - 1)
                hit = np.flatnonzero(table[at] == keys[a:b])
                for o, v in zip(out, values, strict=True):
                    o[a + hit] = v[at[hit]]
        return out

    def scores(self, column: pa.Array) -> dict[str, np.ndarray]:
        m, n = self.model, len(column)
        out = {"n_tokens": np.zeros(n, np.int64), "n_known": np.zeros(n, np.int64), "base_score": np.zeros(n), "score": np.zeros(n)}
        d2, d1 = np.array(self.d_pair), np.array(self.d_word)
        types = max(m.n_pairs, 1)
        mass = (d1[1] * m.word_tallies[0] + d1[2] * m.word_tallies[1] + d1[3] * m.word_tallies[4]) / types if m.n_pairs else 1.0
        for lo, hi, data, offsets in B.chunks(column, CHUNK):
            words, before, first = _tokens(data, offsets)
            distinct, back = np.unique(words, return_inverse=True)
            count, conts = self.find("words", distinct)
            base = np.log10((count + 1) / (m.n_tokens + m.n_words + 1))
            lower = (conts - d1[np.minimum(conts, 3)]) / types + mass / (m.n_words + 1)
            contexts, at = np.unique(before, return_inverse=True)
            total, *n_of = self.find("contexts", contexts)
            place, hot = _place(contexts, m.hot)
            for x, y in zip((total, *n_of), m.hot_totals, strict=True):
                x[hot] = y[place[hot]]
            rest = np.where(total > 0, (d2[1] * n_of[0] + d2[2] * n_of[1] + d2[3] * n_of[2]) / np.maximum(total, 1), 1.0)
            key = _pair_key(before, words, m.bits, m.hot)
            order = np.argsort(key)
            (pairs,) = self.find("pairs", key[order])
            seen = np.empty(len(key), np.int64)
            seen[order] = pairs
            p = (seen - d2[np.minimum(seen, 3)]) / np.maximum(total, 1)[at] + rest[at] * lower[back]
            out["n_tokens"][lo:hi] = np.diff(first)
            for name, x in (("n_known", (count > 0)[back].astype(np.int64)), ("base_score", base[back]), ("score", np.log10(p))):
                out[name][lo:hi] = np.add.reduceat(x, first[:-1])  # every text has its end
        return out


#: The reader that a worker keeps from task to task, by its model's folder.
_KEPT: dict[str, Reader] = {}


def _reader(model: Model) -> Reader:
    """This worker's reader: files are mapped (or copied, where they can't be) once a worker, not once a task."""
    if model.folder not in _KEPT:
        _KEPT.clear()
        _KEPT[model.folder] = Reader(model)
    return _KEPT[model.folder]


def score(model: Model, text: Column) -> Column:
    """A struct of n_tokens, n_known, base_score and score (log10) of each text.

    A null text scores as an empty one: one token, the end. With nothing
    learned, every token has the same probability.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = _reader(model)
        for column in batches:
            got = reader.scores(column)
            yield pa.StructArray.from_arrays([pa.array(got[f]) for f in SCORED.names], names=SCORED.names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, SCORED).asNondeterministic()(text)
