"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, of toxic and of ordinary labelled
texts: counts of pairs at the top, numbers of distinct words before a word below,
and an even share below these. At both levels what an expression counts in a
class is drawn, the more the rarer it is, towards its count in both classes
together, split as the level below would split it, and modified Kneser-Ney
discounts go by the shared counts too; so a rare expression says little more
than the words in it, and none is left out. A text's evidence is its log-likelihood ratio, length-normalised over the
whole text and over its most toxic window; a logistic fit on labelled texts that
the models haven't seen turns both into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes as B
from ._shared import keep, struct_of

#: Words of the windows over whose whole run through a text the most toxic is sought.
WINDOWS = (1, 2, 4, 8, 16, 48)
#: Shorter texts count as if so long.
LEAST_WORDS = 24
START = 0x5EED
SCORED = struct_of(score="double", llr="double", peak="double")


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2, and 3 or more."""
    n = [max(int((counts == i).sum()), 1) for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0, 0.1, 0.1, 0.1], [0, 0.98, 1.9, 2.8])


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values (a row each, or one column each)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first, axis=0) if len(keys) else values


@dataclass
class Model:
    """Sorted hash arrays; the columns of two-column arrays are ordinary and toxic."""

    words: np.ndarray
    word_p: np.ndarray  # log P(w) of both classes
    contexts: np.ndarray  # positions of context words follow words
    back: np.ndarray  # backoff weights of both classes by context word
    pairs: np.ndarray
    pair_p: np.ndarray  # discounted P(w | h) of both classes, without the backed-off part
    unseen: np.ndarray  # log P of a word that no text has
    weights: np.ndarray  # of 1 and of each kind of evidence in the score


def _shared(counts: np.ndarray, prior: float, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of both classes, drawn towards their sum split by odds as if prior more were seen in both together, and the part of each to discount."""
    both = counts.sum(axis=1)
    own = both / (both + prior)
    out = odds * (both * (1 - own) / np.maximum(odds.sum(axis=1), 1e-300))[:, None]
    out += own[:, None] * counts
    return out, _discounts(both)[np.minimum(both, 3).astype(np.int64)] / np.maximum(both, 1)


def fit_models(first: np.ndarray, second: np.ndarray, counts: np.ndarray, word_prior: float, pair_prior: float) -> Model:
    """From distinct (first, second) word pairs and their counts in both classes; every pair and word stays."""
    words, cont = _sums(second, (counts > 0).astype(np.float64))
    none = 1 / (len(words) + 1)
    cont, part = _shared(cont, word_prior, np.broadcast_to(cont.sum(axis=0), cont.shape))
    total = np.maximum(cont.sum(axis=0), 1e-300)
    rest = (cont * part[:, None]).sum(axis=0) / total
    rest[cont.sum(axis=0) == 0] = 1  # a class without words
    word_p = cont * (1 - part)[:, None] / total + rest * none
    contexts = np.unique(first)
    where = np.searchsorted(contexts, first)
    c, part = _shared(counts, pair_prior, counts.sum(axis=0) * word_p[np.searchsorted(words, second)])
    total = np.column_stack([np.bincount(where, weights=c[:, k], minlength=len(contexts)) for k in range(2)])
    given = np.column_stack([np.bincount(where, weights=c[:, k] * part, minlength=len(contexts)) for k in range(2)])
    back = np.where(total > 0, given / np.maximum(total, 1e-300), 1)
    pair_p = c * (1 - part)[:, None] / np.maximum(total, 1e-300)[where]
    pairs = B.combine(first, second)
    order = np.argsort(pairs)
    return Model(words, word_p, contexts, back.astype(np.float32), pairs[order], pair_p[order].astype(np.float32), rest * none, np.zeros(1))


def _look_up(table: np.ndarray, values: np.ndarray, keys: np.ndarray, default: np.ndarray | float) -> np.ndarray:
    """The row of values for each key, or the default for keys that the table lacks."""
    out = np.empty((len(keys), 2))
    out[:] = default
    if len(table):
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        hit = table[at] == keys
        out[hit] = values[at[hit]]
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = B.LOWER[data]
    starts, ends = B.runs(B.ALNUM[lower], offsets)
    row, first = B.rows_of(starts, offsets)
    return B.span_hash(B.prefix_hash(lower), starts, ends), row, first


def _before(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word; a fixed one before a text's first."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1][np.diff(first) > 0]] = B.U(START)
    return before


def evidence(model: Model, column: pa.Array) -> np.ndarray:
    """Length-normalised log-likelihood ratios of each text and of its peak windows.

    All 0 without words. A window that a text's end cuts short counts in full length.
    """
    out = np.zeros((len(column), 1 + len(WINDOWS)))
    for lo, hi, data, offsets in B.chunks(column):
        words, row, first = _tokens(data, offsets)
        if not len(words):
            continue
        # Words and pairs repeat: each distinct one is looked up once, in sorted order.
        distinct, back = np.unique(words, return_inverse=True)
        p_word = _look_up(model.words, model.word_p, distinct, model.unseen)
        weight = _look_up(model.contexts, model.back, np.append(distinct, B.U(START)), 1)
        h = np.empty(len(words), np.int64)
        h[1:] = back[:-1]
        h[first[:-1][np.diff(first) > 0]] = len(distinct)
        pairs = B.combine(_before(words, first), words)
        order = np.argsort(pairs)
        p = weight[h] * p_word[back]
        p[order] += _look_up(model.pairs, model.pair_p, pairs[order], 0)
        llr = np.log(p[:, 1]) - np.log(p[:, 0])
        total = np.zeros(len(llr) + 1)
        np.cumsum(llr, out=total[1:])
        n = np.diff(first)
        out[lo:hi, 0] = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, LEAST_WORDS)
        rows = np.flatnonzero(n > 0)
        for i, size in enumerate(WINDOWS, 1):
            stop = np.minimum(np.arange(len(llr)) + size, first[row + 1])
            out[lo + rows, i] = np.maximum.reduceat((total[stop] - total[:-1]) / size, first[rows])
    return out


def fit_score(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a small ridge; weights of 1 and of x.

    More evidence never lowers a score: kinds whose weight would be negative are left out.
    """
    scale = np.maximum(x.std(axis=0), 1e-9)
    used = np.arange(x.shape[1])
    while True:
        a = np.column_stack([np.ones(len(x)), (x / scale)[:, used]])
        ridge, w = np.full(a.shape[1], 1e-2), np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + np.diag(ridge), a.T @ (weight * (toxic - p)) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            out = np.zeros(1 + x.shape[1])
            out[0], out[1 + used] = w[0], w[1:] / scale[used]
            return out
        used = np.delete(used, np.argmin(w[1:]))


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, second, toxic) of the texts, with their numbers in each chunk."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in B.chunks(batch.column("text")):
            words, row, first = _tokens(data, offsets)
            h = _before(words, first)
            kind = toxic[lo:hi][row] if len(words) else np.zeros(0, np.int64)
            _, at, n = np.unique(B.combine(B.combine(h, words), kind), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(words[at].view(np.int64)), pa.array(kind[at].astype(np.int32)), pa.array(n)], names=["first", "second", "toxic", "n"])


@F.arrow_udf(T.LongType())
def _n_words(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        out = np.zeros(len(column), np.int64)
        for lo, hi, data, offsets in B.chunks(column):
            out[lo:hi] = np.diff(_tokens(data, offsets)[2])
        yield pa.array(out)


def _evidence_udf(spark: SparkSession, model: Model):
    shipped = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = evidence(shipped.value, column)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    measure.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(measure, T.ArrayType(T.DoubleType())).asNondeterministic()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 6000, per_class_words: int = 1_500_000, word_prior: float = 1, pair_prior: float = 200) -> Model | None:
    """Fits the models on at most per_class labelled documents, of per_class_words words in all, of each class.

    The sample, by hash of the id, bounds what comes to the driver: no more pairs
    than words, 24 bytes each, so 48 MB. Both limits are documented ones and
    don't depend on the corpus; documents behind the word limit are left out
    whole. Two thirds of the sample make the models, one third the score. An id
    with both labels is toxic; null ids, labels and texts teach nothing. None if
    a class has no text. The priors say how often an expression must be seen,
    in both classes together, to count for as much as what the classes share.
    """
    spark = docs.sparkSession
    by_id = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic")).filter("id is not null")
    tally = {r["toxic"]: r["n"] for r in by_id.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(tally) < 2:
        return None
    rank = F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))
    sample = [by_id.filter(F.col("toxic") == c).withColumn("rank", rank).orderBy("rank", "id").limit(per_class) for c in (0, 1)]
    sample = sample[0].union(sample[1])  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(sample), "id")
    texts = keep(texts.select("text", "toxic", "rank", "id", (F.pmod("rank", F.lit(3)) == 0).alias("check"), _n_words("text").alias("n")), "toxicity")
    upto = F.sum("n").over(Window.partitionBy("toxic").orderBy("rank", "id", "n").rowsBetween(Window.unboundedPreceding, 0))  # at most per_class rows a class
    over = texts.select("toxic", "rank", "id", upto.alias("upto")).filter(F.col("upto") > per_class_words).groupBy("toxic").agg(F.min("rank").alias("end"))
    ends = {r["toxic"]: r["end"] for r in over.collect()}
    for c, end in ends.items():
        texts = texts.filter((F.col("toxic") != c) | (F.col("rank") < end))
    learn = texts.filter(~F.col("check")).select("text", "toxic").mapInArrow(_expressions, struct_of(first="long", second="long", toxic="int", n="long"))
    kinds = learn.groupBy("first", "second").agg(*(F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).cast("int").alias(name) for c, name in enumerate(("ordinary", "toxic")))).toArrow()
    if kinds.num_rows == 0:
        return None
    model = fit_models(*(kinds[c].to_numpy().view(B.U) for c in ("first", "second")), np.column_stack([kinds[c].to_numpy() for c in ("ordinary", "toxic")]), word_prior, pair_prior)
    seen = texts.filter("check").select("toxic", _evidence_udf(spark, model)("text").alias("x")).toArrow()
    toxic = seen["toxic"].to_numpy()
    if len(set(toxic.tolist())) < 2:
        return None
    x = np.array(seen["x"].to_pylist())
    weight = np.where(toxic == 1, tally[1] / (toxic == 1).sum(), tally[0] / (toxic == 0).sum())
    model.weights = fit_score(x, toxic, weight / weight.mean())
    return model


def score(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """A struct of score (0 to 1), llr and peak of each text; equal texts get equal scores, in any order of rows.

    A null or empty text, or one without words, has no evidence: its score is
    the fitted base rate. Without a model all scores are 0.
    """
    if model is None:
        return F.struct(*[F.lit(0.0).alias(f.name) for f in SCORED.fields])
    shipped = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = evidence(shipped.value, column)
            z = shipped.value.weights[0] + x @ shipped.value.weights[1:]
            yield pa.StructArray.from_arrays([pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700)))), pa.array(x[:, 0]), pa.array(x[:, 1:].max(axis=1))], names=["score", "llr", "peak"])

    measure.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(measure, SCORED).asNondeterministic()(text)
