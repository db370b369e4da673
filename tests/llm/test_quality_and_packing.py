import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from wireloom.llm import packing, quality_rules


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit), sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words)


def test_measurements_of_odd_rows(spark):
    df = H.odd(spark)
    got = quality_rules.ledger(df)
    assert got.columns == ["doc_id", *quality_rules.MEASURES, "fail_bits"]
    rows = sorted(tuple(r[1:8]) for r in got.collect())
    assert rows == sorted(measured(r[1]) for r in H.odd_rows())
    assert quality_rules.ledger(H.empty(spark)).count() == 0


def test_policies_and_ablations(spark):
    rng = np.random.default_rng(1)
    good = [H.paragraphs(rng, 5, 20) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate([*good, "too short", None, " ".join(["$$$ a"] * 60), " ".join(f"w{i} #" for i in range(80))])]
    led = quality_rules.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.doc_id: r.kept for r in quality_rules.apply_policy(led, "v1").collect()}
    assert [kept[i] for i in range(24)] == [True] * 20 + [False] * 4
    base = {r.doc_id: r.kept for r in quality_rules.apply_policy(led, "base").collect()}
    assert base[23] and not base[22]
    cost = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(led, "v1").collect()}
    bits = [r.fail_bits for r in led.collect()]
    for rule, bit in quality_rules.BITS.items():
        assert cost.get(rule, (0, 0)) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))


def test_passing_keeps_columns_and_rows(spark):
    df = H.odd(spark)
    got = quality_rules.passing(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    want = quality_rules.apply_policy(quality_rules.ledger(df), "v1").filter("kept").collect()
    assert kept == sorted((r.doc_id is None, r.doc_id or 0) for r in want)


def check_packing(rows, lengths):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.sequence, []).append(r)
    for pieces in by_bin.values():
        pieces.sort(key=lambda r: r.place)
        length = pieces[0].length
        assert all(r.length == length for r in pieces)
        used = 0
        for r in pieces:
            assert r.place == used
            used += r.n_tokens
        # shrunk to the least length that holds it
        assert used <= length and not any(used <= c < length for c in lengths)


def test_packing_holds_every_token_once(spark):
    df = H.odd(spark)
    tokens = packing.word_tokens(df)
    lengths = (64, 256, 1024)
    rows = packing.pack(tokens, lengths, group=10).collect()
    check_packing(rows, lengths)
    want = Counter((r[0], len((r[1] or "").split()) + 1) for r in H.odd_rows())
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    total = Counter()
    for (i, n), k in want.items():
        total[i] += n * k
    assert got == total
    starts = sorted((r.start, r.n_tokens) for r in rows if r.doc_id == 8)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert packing.pack(packing.word_tokens(H.empty(spark))).count() == 0
    assert packing.pack(spark.createDataFrame([(1, None), (2, 0)], "doc_id long, n_tokens long")).count() == 0


def total_cost(final, cost):
    return sum(cost(int(c)) for c in final)


def test_several_lengths_cost_less_than_any_one():
    rng = np.random.default_rng(2)
    sizes = np.sort(np.minimum(rng.lognormal(5.5, 1.3, 20000).astype(int) + 1, 8192))[::-1]
    _, _, final = packing.best_fit(sizes)
    joint = total_cost(final, packing.cost)
    assert sizes.sum() / final.sum() > 0.99
    for few in ((8192,), (512, 8192), (4096, 8192)):
        assert joint < total_cost(packing.best_fit(sizes, few)[2], packing.cost)


@pytest.mark.parametrize("seed", range(6))
def test_small_packings_are_near_the_best(seed):
    rng = np.random.default_rng(seed)
    lengths, sizes = (4, 8, 16), np.sort(rng.integers(1, 17, 7))[::-1]

    def best(i, bins):
        if i == len(sizes):
            return sum(packing.cost(next(c for c in lengths if c >= b)) for b in bins)
        options = [best(i + 1, [*bins, int(sizes[i])])]
        options += [best(i + 1, [*bins[:k], b + int(sizes[i]), *bins[k + 1 :]]) for k, b in enumerate(bins) if b + sizes[i] <= 16]
        return min(options)

    got = total_cost(packing.best_fit(sizes, lengths)[2], packing.cost)
    assert got <= 1.2 * best(0, [])


def test_packing_does_not_depend_on_partitions(spark):
    df = packing.word_tokens(H.odd(spark).filter("doc_id is not null"))
    one, two = (sorted(map(str, packing.pack(df.repartition(n), (64, 256), group=5).collect())) for n in (1, 7))
    assert one == two
    assert F is not None


def test_equal_rows_spread_over_groups(spark):
    df = spark.createDataFrame([(None, 5)] * 400 + [(7, 5)] * 400, "doc_id long, n_tokens long")
    rows = packing.pack(df, (16, 64), group=100).collect()
    check_packing(rows, (16, 64))
    parts = Counter(r.sequence.split("-")[0] for r in rows)
    assert len(rows) == 800 and len(parts) == 8 and max(parts.values()) < 150


def test_contents_of_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, None), (3, "x y")], "doc_id long, text string")
    rows = packing.contents(packing.pack(packing.word_tokens(docs), (4, 8)), docs).collect()
    assert sorted(w for r in rows for t in r.texts for w in t.split()) == list("abcdefghixy")
    assert all(sum(len(t.split()) for t in r.texts) <= r.length for r in rows)
    assert any(r.texts[0] == "a b c d e f g h" for r in rows)
