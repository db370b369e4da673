"""Quality rules as a ledger of bit masks.

Every rule is evaluated once per document. The ledger keeps the measurements
and one integer whose bit i says that rule i failed. Policies are versioned
masks over these bits: a new policy, or the question what a rule costs, reads
the ledger and never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import fresh, released, struct_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words")
LEDGER = struct_of(**dict.fromkeys(MEASURES, "long"))

#: Rule i sets bit i. SQL over the measurements, in integers, so that any engine agrees.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 16 * n_words",
    "few_letter_words": "100 * n_letter_words < 70 * n_words",
}
BITS = {rule: 1 << i for i, rule in enumerate(RULES)}

#: Published policies are never changed; a new rule set gets a new name.
POLICIES = {
    "base": BITS["few_words"] | BITS["repeated_windows"],
    "v1": sum(BITS.values()),
}

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def measure_texts(column: pa.Array) -> dict[str, np.ndarray]:
    out = {m: np.zeros(len(column), np.int64) for m in MEASURES}
    for lo, hi, data, offsets in B.chunks(column):
        if len(data) == 0:
            continue
        word = B.NOT_SPACE[data]
        starts, ends = B.runs(word, offsets)
        row, first = B.rows_of(starts, offsets)
        out["n_words"][lo:hi] = np.diff(first)
        out["word_chars"][lo:hi] = B.per_row(word & B.STARTS[data], offsets)
        out["n_symbols"][lo:hi] = B.per_row(SYMBOLS[data], offsets)
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(B.LETTER[data], out=letters[1:])
        out["n_letter_words"][lo:hi] = np.bincount(row[letters[ends] > letters[starts]], minlength=hi - lo)

        prefix = B.prefix_hash(data)
        windows = B.grams(B.span_hash(prefix, starts, ends), 3)
        covered = np.zeros(len(starts), bool)
        if len(windows):
            whole = row[:-2] == row[2:]
            keys = B.combine(windows, row[:-2])
            at = np.flatnonzero(whole)[B.seen_twice(keys[whole])]
            for i in range(3):
                covered[at + i] = True
        out["n_repeat_words"][lo:hi] = np.bincount(row[covered], minlength=hi - lo)

        starts, ends, row = B.lines(data, offsets)
        words = np.zeros(len(data) + 1, np.int64)
        np.cumsum(word, out=words[1:])
        full = words[ends] > words[starts]
        starts, ends, row = starts[full], ends[full], row[full]
        _, new = np.unique(B.combine(B.span_hash(prefix, starts, ends), row), return_index=True)
        out["n_lines"][lo:hi] = np.bincount(row, minlength=hi - lo)
        out["n_dup_lines"][lo:hi] = out["n_lines"][lo:hi] - np.bincount(row[new], minlength=hi - lo)
    return out


@F.arrow_udf(LEDGER)
@released
def _measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        got = measure_texts(column)
        yield pa.StructArray.from_arrays([pa.array(got[m]) for m in MEASURES], names=list(MEASURES))


_measure = _measure.asNondeterministic()  # else a later filter makes Spark run it twice


def fail_bits(measures: str | None = None) -> Column:
    """The failure mask, from the columns (or the struct column) of measurements."""
    bits = F.lit(0).cast("long")
    for rule, sql in RULES.items():
        if measures:
            for m in MEASURES:
                sql = sql.replace(m, f"`{measures}`.{m}")
        bits = bits + F.when(F.expr(sql), F.lit(BITS[rule])).otherwise(0).cast("long")
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, the measurements and fail_bits.

    A null or empty text has no words: all measurements are 0 and few_words
    fails. Repeated rows and null ids get a row each. Other columns are not read.
    """
    got = docs.select(F.col(id_col), _measure(F.col(text_col)).alias("m")).select(id_col, "m.*")
    return got.withColumn("fail_bits", fail_bits())


def passing(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text passes the policy.

    A null or empty text has no words and passes only a policy without few_words;
    repeated rows and null ids are judged each by their own text.
    """
    name = fresh(docs, "_ledger")
    got = docs.select("*", _measure(F.col(text_col)).alias(name))
    return got.filter(fail_bits(name).bitwiseAND(F.lit(POLICIES[policy])) == 0).drop(name)


def apply_policy(ledger_: DataFrame, policy: str | int) -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return ledger_.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def ablation(ledger_: DataFrame, policy: str | int) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects.

    One aggregation over the distinct masks (at most 2**rules rows leave the
    map side), whatever the number of documents.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask))
    masks = ledger_.select(failed.alias("failed")).groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = [(rule, bit) for rule, bit in BITS.items() if bit & mask]
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in rules]))
    return (
        masks.select("failed", "n", rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )
