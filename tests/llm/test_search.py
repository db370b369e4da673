"""Line dedup, near dedup and decontamination against brute force, with groups and odd rows."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from wireloom.llm import _bytes as B
from wireloom.llm import _graph, decontamination, line_dedup, near_dedup


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def edits(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= most


def change(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = int(rng.integers(0, len(out)))
        kind = rng.integers(0, 3)
        if kind == 0:
            out[i] = "q"
        elif kind == 1:
            out.insert(i, "é")
        else:
            del out[i]
    return "".join(out)


@pytest.mark.parametrize("at_once", [20, 10**6])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(_graph, "EDGES_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    rand = [(int(a) + 200, int(b) + 200) for a, b in rng.integers(0, 60, (50, 2))]
    links = [*chain, *star, *rand]
    got = {r.node: r.root for r in _graph.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    want = roots(300, links)
    assert got == {x: want[x] for x in range(300) if want[x] != x}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Lines


def test_edit_distance_within_a_band():
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice(list("abc"), int(rng.integers(3, 70))))
        pairs.append((a, change(rng, a, int(rng.integers(0, 5)))))
    codes = [[np.array([ord(c) for c in x], np.uint32) for x in side] for side in zip(*pairs)]
    assert line_dedup.edit_within(*codes).tolist() == [edits(a, b, 2) for a, b in pairs]


def test_repeated_lines_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    bases = [H.sentence(rng, int(rng.integers(5, 14))) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = [change(rng, bases[int(rng.integers(0, 12))], int(rng.integers(0, 4))) for _ in range(int(rng.integers(1, 6)))]
        rows.append((i, "\n".join([*lines, "short", "short"])))
    # a hot family: one line in a third of all texts, with small changes
    rows += [(100 + i, change(rng, bases[0], int(rng.integers(0, 3)))) for i in range(30)]
    got = {r.doc_id: (r.removed, r.n_near) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    lines = [(i, no, x) for i, t in rows for no, x in enumerate(t.split("\n")) if len(x) >= line_dedup.MIN_CHARS]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if abs(len(lines[a][2]) - len(lines[b][2])) <= 2 and edits(lines[a][2], lines[b][2], 2)]
    root = roots(len(lines), links)
    want = {i: ([], 0) for i, _ in rows}
    for k, (i, no, x) in enumerate(lines):
        if root[k] != k:
            removed, near = want[i]
            want[i] = ([*removed, no], near + (x != lines[root[k]][2]))
    assert got == want


def test_lines_near_one_line_do_not_all_meet(spark, monkeypatch):
    """many lines near one, far from each other, are compared by rare grams and not each with each."""
    rng = np.random.default_rng(9)
    base = H.sentence(rng, 24)
    lines = {base}
    while len(lines) < 700:  # a word of six letters somewhere
        at, word = int(rng.integers(0, len(base))), "".join(rng.choice(list("bcfghjkmpqvwxz"), 6))
        lines.add(base[:at] + word + base[at:])
    lines = sorted(lines)
    lines += [change(rng, lines[int(rng.integers(0, 700))], 2) for _ in range(60)]
    met, alike = spark.sparkContext.accumulator(0), line_dedup._alike

    def counted(groups):
        met.add(sum(len(g) * (len(g) - 1) // 2 for g in groups))
        return alike(groups)

    monkeypatch.setattr(line_dedup, "_alike", counted)
    rows = spark.createDataFrame([(x,) for x in lines], "text string").repartition(3)
    found = {(r.node, r.root) for r in line_dedup.near_lines(rows, len(lines)).collect()}
    codes = sorted({tuple(map(ord, x)) for x in lines})
    codes = [np.array(x, np.uint32) for x in codes]
    node = B.span_hash(B.prefix_hash(np.concatenate(codes)), *(np.cumsum([len(x) for x in codes]) - part for part in (np.array([len(x) for x in codes]), 0))).view(np.int64)
    pairs = [(a, b) for a in range(len(codes)) for b in range(a) if abs(len(codes[a]) - len(codes[b])) <= 2]
    ok = line_dedup.edit_within(*([codes[p[i]] for p in pairs] for i in range(2)))
    order = np.argsort(node)  # the root is the least node
    place = np.argsort(order)
    root = roots(len(codes), [(place[a], place[b]) for (a, b), x in zip(pairs, ok, strict=True) if x])
    assert found == {(node[order[k]], node[order[r]]) for k, r in enumerate(root) if r != k} and len(found) > 50
    assert met.value < 30 * len(lines)


def test_rare_grams_miss_no_pair():
    rng = np.random.default_rng(10)
    bases = ["".join(rng.choice(list("ab"), int(rng.integers(3, 30)))) for _ in range(150)]
    lines = [x for b in bases for x in (b, change(rng, b, 1), change(rng, b, 2)) if len(x) >= 3]
    items = [np.array(list(map(ord, x)), np.uint32) for x in lines]
    n = len(lines)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([7] * n, pa.int64()), pa.array([x.tobytes() for x in items], pa.binary())], names=["node", "root", "items"])
    counts = rng.integers(0, 256, 2 * line_dedup.COUNTERS).astype(np.uint8).tobytes()  # any order will do
    keys = {}
    for out in line_dedup.rare_grams(counts)(iter([batch])):
        for key, node in zip(out["key"].to_pylist(), out["node"].to_pylist(), strict=True):
            keys.setdefault(node, set()).add(key)
    pairs = [(a, b) for a in range(n) for b in range(a) if abs(len(items[a]) - len(items[b])) <= 2]
    ok = line_dedup.edit_within([items[a] for a, _ in pairs], [items[b] for _, b in pairs])
    assert ok.sum() > 300 and all(keys[a] & keys[b] for (a, b), x in zip(pairs, ok, strict=True) if x)


def test_short_lines_that_repeat_exactly(spark):
    long_ = "a line of more than thirty-two characters"
    texts = ["Menu\n \n我们今天去北京。\nMenu", "我们今天去北京。\n \nMenus\n" + long_, "}\n}\n" + long_ + "!", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: (r.n_long, r.removed, r.n_near) for r in line_dedup.repeated_lines(df, exact_chars=1).collect()}
    # "Menus" is one edit from "Menu", but edits connect only long lines
    assert got == {0: (3, [3], 0), 1: (3, [0], 0), 2: (3, [1, 2], 1), 3: (0, [], 0), 4: (0, [], 0)}
    left = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(df, exact_chars=1).collect()}
    assert left == {0: "Menu\n \n我们今天去北京。", 1: " \nMenus\n" + long_, 2: "}", 3: None, 4: ""}
    assert [r.removed for r in line_dedup.repeated_lines(df, exact_chars=5).orderBy("doc_id").collect()] == [[], [0], [2], [], []]
    near = {r.doc_id: r.removed for r in line_dedup.repeated_lines(df, exact_chars=1, near_chars=4).collect()}
    assert near[0] == [3] and near[1] == [0, 2] and near[2] == [1, 2]
    with pytest.raises(ValueError, match="near_chars"):
        line_dedup.repeated_lines(df, exact_chars=1, near_chars=2)


def test_lines_of_odd_rows(spark):
    df = H.odd(spark)
    got = line_dedup.repeated_lines(df)
    assert got.count() == len(H.odd_rows()) and line_dedup.repeated_lines(H.empty(spark)).count() == 0
    left = line_dedup.without_repeated_lines(df)
    assert left.columns == df.columns
    texts = [r.text for r in left.collect()]
    # copies of a whole text go, blank and null ones stay as they were
    assert texts.count(None) == 2 and "" in texts and " \n\t\n " in texts
    long_ = [x for t in texts for x in (t or "").split("\n") if len(x) >= line_dedup.MIN_CHARS]
    assert len(long_) == len(set(long_))
    assert line_dedup.without_repeated_lines(H.empty(spark)).count() == 0


# Near duplicates


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_rows():
    rng = np.random.default_rng(9)
    rows = []
    for g in range(12):
        words = H.sentence(rng, int(rng.integers(6, 160))).split()
        for _ in range(int(rng.integers(1, 9))):
            w = list(words)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"new{rng.integers(0, 9)}"
            rows.append((len(rows) * 3 + g % 2, " ".join(w)))
    # a hot group: a third of the rows, alike to various degrees, and exact copies
    words = H.sentence(rng, 120).split()
    for k in range(40):
        w = list(words)
        for _ in range(k % 7):
            w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 999)}"
        rows.append((1000 + k, " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, "one two"), (2003, "One  two\n")]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    import wireloom.llm._blocks as blocks
    from wireloom.llm import _shared

    monkeypatch.setattr(_shared, "BROADCAST_KEYS", 5)  # the shuffled way
    monkeypatch.setattr(blocks, "BLOCK", 8)  # families of several blocks
    rows = near_rows()
    for percent, exact in ((85, False), (80, False), (85, True), (60, True)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent, exact=exact).collect()}
        order = sorted(rows)
        sets = [shingle_set(t) for _, t in order]
        links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        root = roots(len(sets), links)
        want = {i: (len(s), order[root[k]][0], root[k] == k) for k, ((i, _), s) in enumerate(zip(order, sets))}
        assert got == want


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    common, errors = rng.integers(1, 2**63, 300).astype(np.uint64), []
    for k in range(20):
        a, b = (np.concatenate([common[: 200 + k], rng.integers(1, 2**63, 60).astype(np.uint64)]) for _ in range(2))
        sig = near_dedup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 200)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04
    # components are a permutation of ranks for a set of one item
    one = near_dedup.superminhash(common[:1], np.zeros(1, int), 1, 50)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(50))


def tens(large):
    """Edges between the points of a family that lie in one stretch of ten, the stretches overlapping by five."""
    at = F.conv(F.concat(*[F.substring(F.hex("items"), i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    cells = large.select("node", "root", F.explode(F.array(F.floor(at / 10), F.floor((at + 5) / 10) + 100_000)).alias("cell"))
    hubs = cells.groupBy("root", "cell").agg(F.min("node").alias("a"))
    return cells.join(hubs, ["root", "cell"]).filter("node <> a").select("a", F.col("node").alias("b"))


def test_family_components_equal_brute_force(spark, monkeypatch):
    import wireloom.llm._blocks as blocks

    monkeypatch.setattr(blocks, "BLOCK", 6)
    rng = np.random.default_rng(12)
    # points of families; those at most 3 apart link, and lie on the same or neighbouring levels
    spread = {1: 40, 2: 900, 3: 5, 4: 4000, 5: 30}
    points = [(node, family, int(rng.integers(0, spread[family]))) for node, family in enumerate(rng.choice([1, 2, 3, 4, 5], 300, p=[0.4, 0.2, 0.2, 0.18, 0.02]).tolist())]
    read = spark.sparkContext.accumulator(0)

    def linked(groups):
        out = []
        for items in groups:
            read.add(len(items))
            at = np.array([int.from_bytes(x, "little") for x in items])
            out.append(np.nonzero(np.triu(np.abs(at[:, None] - at[None, :]) <= 3, 1)))
        return out

    nodes = spark.createDataFrame([(n, f, x // 4, x.to_bytes(4, "little")) for n, f, x in points], "node long, root long, level int, items binary").repartition(5)
    got = {r.node: r.root for r in blocks.family_components(nodes, linked).collect()}
    want = roots(len(points), [(a[0], b[0]) for a in points for b in points if a[0] > b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 3])
    assert got == {n: r for n, r in enumerate(want) if n != r}
    # finer families: by tens, and by tens that begin at five
    finer = {r.node: r.root for r in blocks.family_components(nodes, linked, lambda large: tens(large)).collect()}
    assert finer == got
    # copies without number: what is read grows with the nodes, not with their square
    read.value = 0
    nodes = spark.range(2000).selectExpr("id AS node", "0L AS root", "0 AS level", "X'00' AS items")
    assert blocks.family_components(nodes, linked).filter("root = 0").count() == 1999
    assert read.value < 3 * 2000


def test_near_dedup_of_odd_rows(spark):
    df = H.odd(spark)
    got = near_dedup.near_duplicates(df)
    assert got.count() == len(H.odd_rows()) and near_dedup.near_duplicates(H.empty(spark)).count() == 0
    by = {(r.doc_id, r.n_shingles): r for r in got.collect()}
    n = len(shingle_set(H.odd_rows()[0][1]))
    assert by[2, n].component_id == 1 and not by[2, n].kept and by[10, n].component_id == 1 and by[1, n].kept
    left = near_dedup.one_of_each(df)
    assert left.columns == df.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect())
    # one of the two equal rows and none of their copies; null and blank texts stay
    assert ids.count((False, 1)) == 1 and ids.count((False, 2)) == 1 and (False, 10) not in ids and ids.count((True, 0)) == 2
    assert near_dedup.one_of_each(H.empty(spark)).count() == 0


# Decontamination


def brute_hits(text, items, window=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for item, other in items:
        b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(other))
        n = min(window, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    items = [(k, H.sentence(rng, int(rng.integers(10, 40)))) for k in range(8)]
    items += [(50, "Tiny one"), (51, "alpha beta gamma delta"), (52, ""), (53, None), (54, "!!"), (7, items[0][1]), (55, items[1][1] + " " + items[2][1])]
    rows = []
    for i in range(60):
        w = H.sentence(rng, int(rng.integers(0, 80))).split()
        if i % 3 == 0:
            b = items[int(rng.integers(0, 8))][1].split()
            lo = int(rng.integers(0, max(1, len(b) - 8)))
            w[5:5] = b[lo : lo + int(rng.integers(8, 20))]
        if i % 7 == 0:
            w += ["Alpha,", "beta", "GAMMA", "delta", "tiny-one"]
        rows.append((i, " ".join(w)))
    # a hot passage in very many texts
    rows += [(100 + i, f"start {i} " + items[3][1].upper() + f" end {i}") for i in range(40)]
    rows += [(300, None), (301, ""), (302, " ".join([items[4][1]] * 3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in rows}
    kept = {r.doc_id for r in decontamination.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert kept == {i for i, t in rows if not brute_hits(t, items)[1]}


def test_decontamination_of_odd_rows(spark):
    df = H.odd(spark)
    bench = spark.createDataFrame([(None, H.odd_rows()[0][1]), (1, None)], "item_id long, text string")
    rows = decontamination.decontaminate(df, bench).collect()
    assert len(rows) == len(H.odd_rows())
    # an item without an id hits, but can't be listed
    assert all(r.item_ids == [] for r in rows) and sum(r.contaminated for r in rows) == 5
    none = bench.filter("false")
    assert decontamination.decontaminate(df, none).filter("contaminated").count() == 0
    assert decontamination.clean(df, none).columns == df.columns and decontamination.clean(df, none).count() == len(rows)
    assert decontamination.decontaminate(H.empty(spark), bench).count() == 0


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442") and F is not None
