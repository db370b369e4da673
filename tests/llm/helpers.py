"""Small tables with all that may be odd about documents."""

import numpy as np

WORDS = "the and of over under river stone light cloud winter summer garden window paper silver engine harbor mountain silent yellow".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + ("" if rng.random() < 0.6 else str(rng.integers(0, 60))) for _ in range(n))


def paragraphs(rng, n_lines, n_words):
    return "\n".join(sentence(rng, n_words).capitalize() + "." for _ in range(n_lines))


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, one id twice, a long text."""
    rng = np.random.default_rng(3)
    plain = paragraphs(rng, 4, 20)
    return [
        (1, plain, "en", "a", 1), (1, plain, "en", "a", 1), (2, plain, "en", "b", 1), (2, paragraphs(rng, 3, 20), "en", "b", 1), (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t\n ", "en", "a", 5),
        (None, paragraphs(rng, 4, 25), "en", None, 3), (None, None, None, None, None), (6, "one", "de", "c", 3), (7, "é日本語 😀 ▁x\u0000y <s>", "fr", "c", 9), (8, paragraphs(rng, 3000, 12), "en", "a", 1), (9, "x" * 300_000, "en", "a", 1),
        (10, plain.replace("the", "The"), "en", "z", 1), (11, "\n".join([plain] * 3), "en", "z", 1),
    ]


def odd(spark):
    """The rows, with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in ("row", "_row", "m", "score", "fail_bits", "node", "n", "key", "_ledger", "id", "items", "bands", "lines", "s"):
        df = df.withColumn(name, F.lit(name))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
