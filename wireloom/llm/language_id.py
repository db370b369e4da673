"""Language identification with a byte convolutional network.

Windows of WINDOW bytes go through filters of several widths over byte classes,
a maximum over the window, and a softmax. A filter on one-hot bytes is a sum of
table rows, so tables of byte pairs give all widths in two look-ups a byte.
Trained in numpy on a bounded sample; a text's windows are averaged over its
whole length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import keep, struct_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
NONE = "und"
PREDICTED = struct_of(lang="string", score="double")

#: Classes of bytes: 0 what is no letter, 1-26 letters without case, the rest one by one.
CLASS = np.zeros(256, np.int64)
CLASS[0x61:0x7B] = CLASS[0x41:0x5B] = np.arange(1, 27)
CLASS[0x80:] = np.arange(27, 155)
N_CLASSES = 155
PAD = max(WIDTHS) - 1


@dataclass
class Net:
    langs: list[str]
    filters: list[np.ndarray]  # by width: (width, N_CLASSES, FILTERS)
    dense: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of filter rows for the byte pair at an offset of 0, and of 2."""
        two, three, four = self.filters
        n = N_CLASSES

        def pair(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
            out = a[:, None, :] + (b[None, :, :] if b is not None else np.zeros((1, n, 1), np.float32))
            return out.reshape(n * n, FILTERS)

        near = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1)
        far = np.concatenate([pair(three[2], None), pair(four[2], four[3])], axis=1)
        return np.ascontiguousarray(near, np.float32), np.ascontiguousarray(far, np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, lang: np.ndarray, langs: list[str], epochs: int = 6, seed: int = 7) -> Net:
    """Adam on batches of (WINDOW + PAD) byte classes; the gradient goes to each filter's maximum."""
    rng = np.random.default_rng(seed)
    n_lang, f = len(langs), FILTERS
    params = [rng.normal(0, 0.3, (w, N_CLASSES, f)).astype(np.float32) for w in WIDTHS] + [rng.normal(0, 0.1, (len(WIDTHS) * f, n_lang)).astype(np.float32), np.zeros(n_lang, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size = 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), size):
            x, y = windows[order[lo : lo + size]], lang[order[lo : lo + size]]
            b = np.arange(len(x))[:, None]
            tops, places = [], []
            for w, p in zip(WIDTHS, params, strict=False):
                act = sum(p[i][x[:, i : i + WINDOW]] for i in range(w))
                place = act.argmax(axis=1)  # (batch, f)
                places.append(place)
                tops.append(np.take_along_axis(act, place[:, None, :], axis=1)[:, 0])
            pooled = np.concatenate(tops, axis=1)
            on = pooled > 0
            hidden = pooled * on
            out = _softmax(hidden @ params[3] + params[4])
            out[np.arange(len(x)), y] -= 1
            out /= len(x)
            back = (out @ params[3].T) * on
            grads = []
            for k, (w, p) in enumerate(zip(WIDTHS, params, strict=False)):
                g = np.zeros_like(p)
                for i in range(w):
                    np.add.at(g[i], (x[b, places[k] + i], np.arange(f)[None, :]), back[:, k * f : (k + 1) * f])
                grads.append(g)
            grads += [hidden.T @ out, out.sum(axis=0)]
            step += 1
            for p, g, m_, v_ in zip(params, grads, m, v, strict=True):
                m_ += 0.1 * (g - m_)
                v_ += 0.001 * (g * g - v_)
                p -= 0.01 * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.999**step)) + 1e-8)
    return Net(langs, params[:3], params[3], params[4])


def _has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letters = B.per_row((CLASS[data] > 0) & (CLASS[data] <= 26), offsets) > 0
    unsure = ~ascii_letters & (B.per_row(data >= 0x80, offsets) > 0)
    for r in np.flatnonzero(unsure):
        ascii_letters[r] = any(ch.isalpha() for ch in column[int(r)].as_py())
    return ascii_letters


def predict(net: Net, tables: tuple[np.ndarray, np.ndarray], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language index (-1: no letter) and score of each text."""
    best, score = np.full(len(column), -1), np.zeros(len(column))
    near, far = tables
    f2 = FILTERS
    for lo, hi, data, offsets in B.chunks(column, 1 << 19):
        n_rows = hi - lo
        letter = _has_letter(column.slice(lo, n_rows), data, offsets)
        # PAD class-0 bytes lie behind every text; filters that begin there could see the next.
        size = np.diff(offsets)
        at = offsets[:-1] + PAD * np.arange(n_rows)
        x = np.zeros(len(data) + PAD * (n_rows + 1), np.int64)
        x[np.arange(len(data)) + PAD * np.repeat(np.arange(n_rows), size)] = CLASS[data]
        code = x[:-1] * N_CLASSES + x[1:]
        n = len(x) - PAD
        act = near[code[:n]]
        act[:, f2:] += far[code[2 : n + 2]]
        act[((at + size)[:, None] + np.arange(PAD)).ravel()] = 0
        count = np.maximum(1, -(-size // WINDOW))
        first = np.concatenate([[0], np.cumsum(count)])
        begin = np.repeat(at, count) + WINDOW * (np.arange(first[-1]) - np.repeat(first[:-1], count))
        top = np.maximum(np.maximum.reduceat(act, np.minimum(begin, n - 1), axis=0), 0)
        p = np.log(_softmax(top @ net.dense + net.bias) + 1e-6)
        mean = np.add.reduceat(p, first[:-1], axis=0) / count[:, None]
        p = _softmax(mean)
        winner = p.argmax(axis=1)
        best[lo:hi] = np.where(letter, winner, -1)
        score[lo:hi] = np.where(letter, p[np.arange(n_rows), winner], 0)
    return best, score


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 1000, total: int = 64_000, seed: str = "langid") -> Net | None:
    """Trains on distinct labelled texts of every language: per_lang of each, less where all would be more than total.

    That limit bounds what comes to the driver (a language has one text at
    least): from each text one stretch of 4 windows, at a place drawn by hash. Rows with null text or language, or
    without a letter, teach nothing. None if no row is left.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    tally = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()
    if not tally:
        return None
    langs = sorted(r["lang"] for r in tally)
    per_lang = max(1, min(per_lang, total // len(langs)))
    # Some twice the share that is wanted passes by hash; the rest is cut off by rank.
    share = spark.createDataFrame([(r["lang"], min(1.0, max(2 * per_lang, per_lang + 32) / r["n"])) for r in tally], "lang string, share double")
    rank = F.xxhash64("text", F.lit(seed))
    length = 4 * WINDOW
    start = 1 + F.pmod(F.xxhash64(F.lit(seed), "text"), F.greatest(F.lit(1), F.char_length("text") - length + 1))
    pick = rows.join(F.broadcast(share), "lang").filter(F.pmod(rank, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    pick = pick.select("lang", rank.alias("rank"), F.substring("text", start.cast("int"), F.lit(length)).alias("text"))
    # Copies of a text pass together; they count as one.
    pick = keep(pick.groupBy("lang", "rank").agg(F.min("text").alias("text")), "langid")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))
    got = pick.withColumn("place", place).filter(F.col("place") <= per_lang).orderBy("lang", "place").toArrow()
    number = {name: k for k, name in enumerate(langs)}
    rng = np.random.default_rng(11)
    windows, lang = [], []
    for text, name in zip(got["text"].to_pylist(), got["lang"].to_pylist(), strict=True):
        raw = CLASS[np.frombuffer(text.encode(), np.uint8)]
        if not raw.any():
            continue
        for _ in range(3):
            size = int(rng.choice([24, 80, WINDOW]))
            lo = int(rng.integers(0, max(1, len(raw) - size + 1)))
            piece = raw[lo : lo + size]
            if piece.any():
                row = np.zeros(WINDOW + PAD, np.int64)
                row[: len(piece)] = piece
                windows.append(row)
                lang.append(number[name])
    if not windows:
        return None
    return train(np.array(windows), np.array(lang), langs)


def identify(spark: SparkSession, net: Net | None, text: Column) -> Column:
    """A struct of lang and score (0 to 1) of each text.

    lang is `und` and score 0 where the text is null or has no letter, and for
    every text if there is no net.
    """
    if net is None:
        return F.struct(F.lit(NONE).alias("lang"), F.lit(0.0).alias("score"))
    shipped = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net_ = shipped.value
        tables, names = net_.tables(), pa.array([NONE, *net_.langs])
        for column in batches:
            best, score = predict(net_, tables, pc.fill_null(column, ""))
            yield pa.StructArray.from_arrays([names.take(pa.array(best + 1)), pa.array(score)], names=["lang", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, PREDICTED).asNondeterministic()(text)
