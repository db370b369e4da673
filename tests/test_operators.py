"""Edits, walks, streams and the catalog, against worked cases and random edits."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_wire import messages, naive_decode
from wireloom.functions import encode as E
from wireloom.functions import tags as T
from wireloom.operators import catalog, document, patch, paths
from wireloom.sources import envelope, fields
from wireloom.streaming import chunks

EDIT = "i int, " + patch.EDIT
NAMES = ["i", "path", "seq", "txn", "op", "target", "tag", "value", "payload"]


def edited(spark, text, *edits, **options):
    df = messages(spark, text)
    log = spark.createDataFrame([tuple({"i": 0, "seq": n, **e}.get(c) for c in NAMES) for n, e in enumerate(edits)], EDIT)
    return bytes(patch.apply_edits(df, log, ["i"], **options).first().msg).hex().upper()


def at(*steps):
    return {"path": list(steps)}


@pytest.mark.parametrize(
    ("text", "edits", "want"),
    [
        ("0807 1008", [{"op": "delete", **at((1, 0))}, {"op": "insert", **at(), "tag": 24, "value": 999}], "1008 18E707"),
        ("5202 1001 5202 1003", [{"op": "set", **at((10, 0), (2, 0)), "value": 101}, {"op": "set", **at((10, 1), (2, 0)), "value": 103}], "5202 1065 5202 1067"),
        ("5202 1001", [{"op": "delete", **at((10, 0), (2, 0))}], "5200"),
        # an untouched field keeps its odd bytes; an edited one keeps its tag's
        ("88008100 90008100", [{"op": "set", **at((2, 0)), "value": 5}], "88008100 900005"),
        # a payload of the same size keeps its odd prefix, another one doesn't
        ("128300616263", [{"op": "set_bytes", **at((2, 0)), "payload": b"xyz"}], "12830078797A"),
        ("128300616263", [{"op": "set_bytes", **at((2, 0)), "payload": b"x"}], "120178"),
        # setting a deleted field doesn't bring it back, and clearing doesn't either
        ("0807", [{"op": "delete", **at((1, 0))}, {"op": "set", **at((1, 0)), "value": 9}, {"op": "clear", **at((1, 0))}], ""),
        ("0807", [{"op": "set", **at((1, 0)), "value": 9}, {"op": "clear", **at((1, 0))}], "0807"),
        ("0807", [{"op": "insert", **at(), "tag": 16, "value": 1}, {"op": "clear", "target": 0}], "0807"),
        ("0807", [{"op": "insert", **at(), "tag": 16, "value": 1}, {"op": "set", "target": 0, "value": 2}, {"op": "insert", **at(), "tag": 24, "value": 3}], "0807 1002 1803"),
        # occurrences count over all wire types, and stay what they were before the edits
        ("0807 0D2A000000 1009", [{"op": "delete", **at((1, 0))}, {"op": "set", **at((1, 1)), "value": 1}], "0D01000000 1009"),
        # below a replaced payload, edits speak of the new one; earlier ones are lost with the old
        ("5202 1001", [{"op": "set", **at((10, 0), (2, 0)), "value": 3}, {"op": "set_bytes", **at((10, 0)), "payload": b"\x10\x05\x18\x06"}, {"op": "set", **at((10, 0), (3, 0)), "value": 7}], "5204 1005 1807"),
        ("0807", [{"op": "set", **at((2, 0)), "value": 9}], "0807"),
        ("", [{"op": "insert", **at(), "tag": 8, "value": 1}], "0801"),
        ("0896", [{"op": "set", **at((1, 0)), "value": 1}], "0896"),
    ],
)
def test_edits(spark, text, edits, want):
    assert edited(spark, text, *edits) == want.replace(" ", "")


def test_edits_in_groups_keep_their_end(spark):
    assert edited(spark, "0B 1005 8C00 1001", {"op": "set", **at((1, 0), (2, 0)), "value": 300}, groups=True) == "0B10AC028C001001"


def test_transactions(spark):
    df = messages(spark, "0801")
    log = spark.createDataFrame([(0, [(1, 0)], 1, t, "set", None, None, v, None) for t, v in (("a", 20), ("b", 30), (None, 10))], EDIT)
    states = spark.createDataFrame([("a", "committed"), ("b", "open")], "txn string, state string")
    got = patch.committed(log, states)
    assert sorted(r.value for r in got.collect()) == [10, 20]
    assert patch.apply_edits(df, log.filter("false"), ["i"]).first().msg == b"\x08\x01"


def test_random_edits_equal_a_straight_rewrite(spark):
    rnd = random.Random(7)
    v = E._varint_bytes
    rows, log, want = [], [], []
    for i in range(12):
        parts = [(n, rnd.randrange(1 << rnd.randrange(1, 40))) for n in (rnd.randint(1, 3) for _ in range(rnd.randint(1, 5)))]
        rows.append((i, b"".join(v(n << 3) + v(x) for n, x in parts)))
        dead, over, added = set(), {}, []
        for seq in range(8):
            k = rnd.randrange(len(parts))
            path = [(parts[k][0], sum(n == parts[k][0] for n, _ in parts[:k]))]
            op, x = rnd.choice(["set", "set", "delete", "clear", "insert"]), rnd.randrange(1 << 20)
            log.append((i, [] if op == "insert" else path, seq, None, op, None, 40 if op == "insert" else None, x, None))
            if op == "set":
                over[k] = x
            elif op == "delete":
                dead.add(k)
            elif op == "clear":
                over.pop(k, None)
            else:
                added.append(x)
        want.append(b"".join(v(n << 3) + v(over.get(k, x)) for k, (n, x) in enumerate(parts) if k not in dead) + b"".join(v(40) + v(x) for x in added))
    df = spark.createDataFrame(rows, "i int, msg binary")
    got = patch.apply_edits(df, spark.createDataFrame(log, EDIT), ["i"]).orderBy("i").collect()
    assert [bytes(r.msg) for r in got] == want


def test_edit_values(spark):
    df = messages(spark, "F00101 F00102 F80109", "5202 1001 5202 1003", "5203 100180")
    flat = patch.edit_values(df, [T.tag(30, 0)], lambda v: v + 10, ["i"]).orderBy("i").first()
    assert bytes(flat.msg).hex() == "f0010bf0010cf80109"
    rows = patch.edit_values(df, [T.tag(10, 2), T.tag(2, 0)], lambda v: v + 100, ["i"]).orderBy("i").collect()
    assert [bytes(r.msg).hex() for r in rows] == ["f00101f00102f80109", "520210655202 1067".replace(" ", ""), "5203100180"]
    assert bytes(patch.edit_values(df, [], None, ["i"]).filter("i = 0").first().msg).hex() == "f00101f00102f80109"


def walk(spark, text, *tag_paths):
    df = messages(spark, text)
    rows = sorted(paths.scan_paths(df, tag_paths, ["i"]).collect(), key=lambda r: (r.end, -r.depth))
    return [(r.path, r.varint if r.varint is not None else r.fixed32 if r.fixed32 is not None else r.fixed64 if r.fixed64 is not None else bytes(r.payload)) for r in rows]


def test_walks(spark):
    p1, p12 = T.path((1, 2)), T.path((1, 2), (2, 0))
    assert walk(spark, "0A02 1009", p1, p12) == [(list(p12), 9), (list(p1), b"\x10\x09")]
    deep = T.path((3, 2), (28, 2), (79, 2), (1, 2))
    inner = "0A06" + b"target".hex()
    inner = "FA0408" + inner
    inner = "E2010B" + inner
    assert walk(spark, "1A0E" + inner, deep) == [(list(deep), b"target")]
    # what no path leads to isn't looked at, so it may be anything
    assert walk(spark, "4A0180 0807", T.path((1, 0))) == [([8], 7)]
    assert walk(spark, "2200", T.path((4, 2))) == [([34], b"")]
    # what came before an error is given, and the error
    bad = messages(spark, "0807 0A0180 0808")
    tags = [T.path((1, 0)), T.path((1, 2), (2, 0))]
    assert [r.varint for r in paths.scan_paths(bad, tags, ["i"]).collect()] == [7]
    assert [tuple(r.error) for r in paths.scan_errors(bad, ["i"], tags).collect()] == [("Malformed", 4)]
    ok = paths.well_formed(messages(spark, "0A0180", "0880", "0A02"), ["i"]).orderBy("i").collect()
    assert [r.ok for r in ok] == [True, False, False]
    with pytest.raises(ValueError):
        paths.steps([()])
    assert len(paths.steps([p1, p12, p12])) == 2


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_chunked_messages_walk_the_same(spark, size):
    df = messages(spark, "08AC02 1D01020304 1A0378797A", "0A02 1009 2200").withColumnRenamed("i", "stream_id")
    whole = chunks.whole_messages(chunks.cut(df, size)).orderBy("stream_id").collect()
    assert [r.msg for r in whole] == [r.msg for r in df.orderBy("stream_id").collect()]


def run_stream(spark, tmp_path, batches, **options):
    """Feeds batches one by one; rows as (offset, raw or payload in hex, is_last, error)."""
    src, name = tmp_path / "in", f"out{abs(hash(str(tmp_path)))}"
    schema = "stream_id string, seq long, chunk binary, last boolean"
    src.mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "b*"))
    q = chunks.fields_of_chunks(stream, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return [(r.stream_id, r.offset, (r.raw if r.raw is not None else r.payload or b"").hex(), r.is_last, r.error) for r in spark.table(name).collect()]


def test_stream_byte_by_byte(spark, tmp_path):
    data = bytes.fromhex("08AC021D010203041A0378797A")
    rows = [("s", i, data[i : i + 1], i == len(data) - 1) for i in range(len(data))]
    got = run_stream(spark, tmp_path, [rows[:1], rows[1:6], rows[6:]])
    assert [(r[1], r[2], r[3]) for r in got] == [(0, "08ac02", True), (3, "1d01020304", True), (8, "1a0378797a", True)]


def test_stream_partial_payloads_errors_and_ends(spark, tmp_path):
    body = b"\x4a\x06abcdef"
    got = run_stream(spark, tmp_path, [[("p", 0, body[:3], False), ("bad", 0, b"\x08\x01\x00", False), ("cut", 0, b"\x08\x80", True)], [("p", 1, body[3:5], False), ("bad", 1, b"\x08\x01", False)], [("p", 2, body[5:], True)]], partial=True)
    assert [(r[2], r[3]) for r in got if r[0] == "p"] == [(b"a".hex(), False), (b"abc".hex(), False), (body.hex(), True)]
    assert [(r[1], r[4]) for r in got if r[0] == "bad"] == [(0, None), (2, "InvalidTag at 2")]
    assert [r[4] for r in got if r[0] == "cut"] == ["Truncated"]


def test_tree_and_bytes(spark):
    rows = fields.scan(messages(spark, "1A03089601 2007"))
    tree = document.tree(rows, ["i"], [T.tag(3, 2)])
    places = spark.createDataFrame([(0, b) for b in range(7)], "i int, byte int")
    got = {r.byte: (r.depth, r.field_number) for r in document.at_byte(tree, places, ["i"]).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (0, 4), 6: (0, 4)}
    back = document.assemble(rows, ["i"]).first()
    assert bytes(back.msg).hex() == "1a030896012007" and naive_decode(bytes(back.msg))[1] is None
    below = fields.descend(rows, T.tag(3, 2), ["i"]).collect()
    assert [(r.parent, r.varint, r.offset) for r in below] == [(0, 150, 0)]


def test_catalog(spark):
    m = spark.createDataFrame([(1, 7, "a", 10, b"x"), (2, 8, "b", 30, b"yy"), (3, None, "c", 30, b"")], "id long, class_id int, name string, modified_ms long, msg binary")
    c = spark.createDataFrame([(7, "seven"), (8, "eight"), (9, "nine")], "class_id int, class_name string")
    assert [(r.id, r.class_name, r.bytes_len) for r in catalog.listing(m, c).collect()] == [(3, "default", 0), (2, "eight", 2), (1, "seven", 1)]
    assert [r.class_id for r in catalog.orphaned(c, m).collect()] == [9]
    left, classes = catalog.delete(m, c, spark.createDataFrame([(1,)], "id long"))
    assert sorted(r.id for r in left.collect()) == [2, 3] and sorted(r.class_id for r in classes.collect()) == [8, 9]
    new = catalog.update_bytes(m, spark.createDataFrame([(1, b"new")], "id long, msg binary"), F.lit(99).cast("long"))
    assert {r.id: (bytes(r.msg), r.modified_ms) for r in new.collect()}[1] == (b"new", 99)
    assert catalog.rename(c, "class_id", 9, "class_name", "neun").filter("class_name = 'neun'").count() == 1
    assert catalog.existing(spark.createDataFrame([(1,), (5,)], "id long"), m).count() == 1
    assert spark.range(1).select(catalog.expand_paths(F.lit(" .2 \n.1\n\n.2"))).first()[0] == [".1", ".2"]
    refs = spark.createDataFrame([(1, 2, 30, 1, 1), (2, 2, 31, 0, 1)], "ref_id long, source_id long, modified_ms long, start int, size int")
    assert {r.ref_id: r.payload and bytes(r.payload) for r in envelope.from_references(refs, m).collect()} == {1: b"y", 2: None}
    kinds = messages(spark, "0801", "0000000002 0801", "FF").select("i", envelope.classify("msg", fields.cursor("msg")).alias("k")).orderBy("i").collect()
    assert [r.k for r in kinds] == ["protobuf", "envelope", "raw"]


def test_user_paths_see_through_text(spark):
    inner = b"089601".hex()  # a payload that is hex of a message
    df = messages(spark, "1A06" + inner + "1A02 0805", "0801")
    got = {r.i: (r.varint, r.root_base) for r in paths.by_user_path(df, [(3, 0), (1, 0)], ["i"]).collect()}
    assert got == {0: (150, None)}
    got = {r.i: (r.varint, r.root_base) for r in paths.by_user_path(df, [(3, 1), (1, 0)], ["i"]).collect()}
    assert got == {0: (5, 10)}


def test_spans_cells_and_selection_paths(spark):
    from wireloom.functions import spans as S
    from wireloom.functions import text as X

    d = messages(spark, "1203616263").select("msg", F.element_at(fields.cursor("msg")["fields"], 1).alias("f")).select("msg", S.of_field(F.col("f")).alias("s"))
    s = F.col("s")
    r = d.select(s["tag"], s["prefix"], s["payload"], S.cut("msg", s["payload"]), S.length(s["field"]), S.contains(s["field"], s["tag"]), S.intersects(s["tag"], s["prefix"]), S.shifted(s["tag"], 3), S.is_empty(S.span(2, 2)), S.span(3, 2)).first()
    assert [tuple(x) if isinstance(x, tuple) else x for x in r] == [(0, 1), (1, 2), (2, 5), b"abc", 5, True, False, (3, 4), True, None]
    step = X.parse_selection_path(F.lit("3:2:0/1:0:4"))
    got = spark.range(1).select(X.selection_path(step), X.parse_selection_path(F.lit("3:9:0")), X.byte_cells(F.lit(b"A\x00"))).first()
    assert got[0] == "3:2:0/1:0:4" and got[1] is None and [tuple(c) for c in got[2]] == [(0, "41", "A"), (1, "00", ".")]


# Walks, edits and chunks as one pass


def odd_keys(spark):
    """Null and repeated keys, and columns whose names operators use themselves."""
    rows = [(1, "1A0108 0801"), (None, "1A0108 0801"), (None, "0805"), (7, "0807"), (7, "0808"), (8, None)]
    df = spark.createDataFrame([(k, t and bytes.fromhex(t.replace(" ", ""))) for k, t in rows], "k int, msg binary")
    for name in ("tag", "offset", "ord", "bytes", "path", "node", "base", "_walk", "_decoded", "_log", "end", "_values", "root_base", "_body"):
        df = df.withColumn(name, F.lit(name))
    return df


def test_null_and_repeated_keys_and_clashing_names(spark):
    df = odd_keys(spark)
    tags = [T.path((3, 2), (1, 0)), T.path((1, 0))]
    # the error in the payload of 3 stops the walk before the field 1 behind it
    got = sorted((r.k or 0, r.varint) for r in paths.scan_paths(df, tags, ["k", "path"]).collect())
    assert got == [(0, 5), (7, 7), (7, 8)]
    assert sorted((r.k or 0, r.error.kind, r.at) for r in paths.scan_errors(df, ["k", "tag"], tags).collect()) == [(0, "Malformed", 2), (1, "Malformed", 2)]
    rows = fields.scan(df)
    assert rows.filter("tag_ = 8").count() == 5 and rows.filter("tag = 'tag'").count() == 7
    assert sorted((r.k or 0, r.varint) for r in paths.by_user_path(df, [(1, 0)], ["k", "root_base"]).collect()) == [(0, 1), (0, 5), (1, 1), (7, 7), (7, 8)]
    log = spark.createDataFrame([(None, [(1, 0)], 1, None, "set", None, None, 9, None), (7, [(1, 0)], 1, None, "set", None, None, 3, None)], EDIT.replace("i int", "k int"))
    out = sorted((r.k or 0, bytes(r.msg).hex() if r.msg is not None else None) for r in patch.apply_edits(df, log, ["k"]).collect())
    assert out == [(0, "0809"), (0, "1a01080809"), (1, "1a01080801"), (7, "0803"), (7, "0803"), (8, None)]
    out = sorted((r.k or 0, bytes(r.msg).hex() if r.msg is not None else None) for r in patch.edit_values(df, [8], lambda v: v + 1, ["k"]).collect())
    assert out == [(0, "0806"), (0, "1a01080802"), (1, "1a01080802"), (7, "0808"), (7, "0809"), (8, None)]


def test_one_python_pass_at_any_depth(spark):
    df = messages(spark, "0801")
    deep = [T.path(*[(3, 2)] * n, (1, 0)) for n in range(12)]
    plan = paths.scan_paths(df, deep, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan
    with pytest.raises(ValueError, match="100"):
        paths.steps([T.path(*[(3, 2)] * 101)])


def nested(rnd, depth):
    out = b""
    for _ in range(rnd.randint(0, 4)):
        kind = rnd.choice([0, 0, 1, 5, 2, 2, 3] if depth else [0, 1, 5])
        head = E._varint_bytes(rnd.randint(1, 3) << 3 | kind)
        if kind == 0:
            out += head + E._varint_bytes(rnd.randrange(1 << rnd.choice([3, 20, 64])))
        elif kind in (1, 5):
            out += head + rnd.randbytes(8 if kind == 1 else 4)
        elif kind == 2:
            body = nested(rnd, depth - 1)
            out += head + E._varint_bytes(len(body)) + body
        else:
            out += head + nested(rnd, depth - 1) + bytes([head[0] + 1])
    return out


def naive_walk(b, tags, groups=True, base=0, path=()):
    """Matches of a good message in the order of the walk."""
    out = []
    for at, tag, value, end in naive_decode(b, groups)[0]:
        here = (*path, tag)
        if tag & 7 in (2, 3) and any(t[: len(here)] == here and len(t) > len(here) for t in tags):
            out += naive_walk(value, tags, groups, 0, here)
        if here in tags:
            out.append((here, value))
    return out


def test_walks_and_chunks_equal_a_straight_walk(spark):
    rnd = random.Random(3)
    texts = [nested(rnd, 3) for _ in range(60)]
    tags = [tuple(T.tag(n, k) for n, k in p) for p in ([(1, 0)], [(2, 2)], [(2, 2), (1, 0)], [(1, 2), (2, 3), (1, 0)], [(3, 3)], [(3, 3), (2, 2)], [(2, 2), (2, 2), (3, 5)], [(1, 2), (1, 1)])]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, msg binary").repartition(3)
    want = {i: [(list(p), v) for p, v in naive_walk(t, tags)] for i, t in enumerate(texts)}

    def value(r):
        return signed_free(r)

    def signed_free(r):
        if r.varint is not None:
            return r.varint & (1 << 64) - 1
        raw = r.fixed32 if r.fixed32 is not None else r.fixed64
        return raw & (1 << (32 if r.fixed32 is not None else 64)) - 1 if raw is not None else bytes(r.payload)

    got = {r.i: [(list(m.path), value(m)) for m in r.w.matches] for r in df.select("i", paths.walk("msg", tags, groups=True).alias("w")).collect()}
    assert got == want
    for size in (1, 7, 64):
        pieces = chunks.cut(df.withColumn("stream_id", F.col("i").cast("string")), size)
        rows = chunks.paths_of_chunks(pieces, tags, groups=True).collect()
        assert all(r.error is None for r in rows)
        by = {i: [] for i in want}
        for r in rows:
            by[int(r.stream_id)].append((list(r.path), r.varint & (1 << (32 if r.tag & 7 == 5 else 64)) - 1 if r.varint is not None else bytes(r.payload)))
        assert by == want


def test_strict_reads_and_kinds(spark):
    df = messages(spark, "0A02 1009", "0A02 1009 0807", "0A02 1009 80", "0A02 1080")
    path = T.path((1, 2), (2, 0))
    got = df.select("i", paths.values_at("msg", path, "uint64", strict=True).alias("s"), paths.values_at("msg", path, "uint64").alias("l")).orderBy("i").collect()
    assert [(r.s, r.l) for r in got] == [([9], [9]), ([9], [9]), (None, [9]), (None, [])]
    # a step that leads on but is no message
    w = messages(spark, "0807").select(paths.walk("msg", [T.path((1, 0), (2, 0))], strict=True).alias("w")).first().w
    assert w.matches == [] and w.error.kind == "WireTypeMismatch"
    with pytest.raises(ValueError, match="double"):
        paths.values_at("msg", path, "double")
    # tags on the path become canonical, a null changes nothing, other fields keep their bytes
    odd = messages(spark, "8A0006 900009 188500")
    out = patch.edit_values(odd, list(path), lambda v: F.when(v > 100, v), ["i"]).first()
    assert bytes(out.msg).hex() == "0a051009188500"
    text = messages(spark, "1203616263 1D01000000 21000000000000F03F 2B0801 2C".replace(" ", ""))
    for p, kind, change, want in (
        ((2, 2), "bytes", lambda v: F.concat(v, F.lit(b"!")), "12046162632 11d0100000021000000000000f03f2b08012c"), ((3, 5), "sfixed32", lambda v: -v, "12036162631dffffffff21000000000000f03f2b08012c"),
        ((4, 1), "double", lambda v: v / 2, "12036162631d0100000021000000000000e03f2b08012c"), ((5, 3), "group", lambda v: F.lit(b""), "12036162631d0100000021000000000000f03f2b2c"),
    ):
        got = patch.edit_values(text, list(T.path(p)), change, ["i"], kind=kind, groups=True).first()
        assert bytes(got.msg).hex() == want.replace(" ", "")


def test_group_payloads_grow_in_a_stream(spark, tmp_path):
    body = bytes.fromhex("0B10070C")
    got = run_stream(spark, tmp_path, [[("g", 0, body[:3], False)], [("g", 1, body[3:], True)]], partial=True, groups=True)
    assert [(r[2], r[3]) for r in got] == [("1007", False), (body.hex(), True)]


def test_states_of_fields_under_edits(spark):
    df = messages(spark, "1A03 089601 2007")
    log = patch.Log()
    log.set([(3, 0), (1, 0)], 5)
    log.delete([(4, 0)])
    gone = log.insert(T.tag(9, "len"), b"x")
    log.clear(gone)
    rows = df.select(F.inline(patch.states("msg", log.column()))).collect()
    assert [(r.parent, r.field_number, r.deleted, r.inserted, r.edited, r.child, r.varint, r.offset) for r in rows] == [
        ("", 3, False, False, False, True, None, 0), ("", 4, True, False, False, False, 7, 5), ("", 9, True, True, False, False, None, None), ("/3:0", 1, False, False, True, False, 5, 2),
    ]
    assert bytes(df.select(patch.edited("msg", log.column())).first()[0]).hex() == "1a020805"
    assert bytes(df.select(patch.edited("msg", patch.Log().column())).first()[0]).hex() == "1a030896012007"


def test_encoding_guards(spark):
    big = E.Field(F.lit(b""), F.lit(1 << 30), 0)
    assert spark.range(1).select(E.encoded_len([big])).first()[0] == 1 << 30
    for c in (E.encoded_len([big, big]), E.encode_message([big, big], guard=True)):
        with pytest.raises(Exception, match="LengthOverflow"):
            spark.range(1).select(c).collect()


def test_edits_and_states_are_made_a_batch_at_once():
    """Many messages with a log each: what an edit costs is array work (20,000 took over 5 s one by one)."""
    import time

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, _parse_datatype_string

    log = patch.Log()
    log.set([(3, 0), (1, 0)], 300)
    log.delete([(2, 0)])
    log.set(log.insert(T.tag(7, "varint"), 42), 43)
    none = dict.fromkeys(patch.EDIT_NAMES)
    edits = [none | e | {"path": [{"number": a, "occurrence": b} for a, b in e["path"]] if "path" in e else None} for e in log.rows]
    n = 20_000
    logs = pa.array([edits, edits[:1], [], None] * (n // 4), to_arrow_type(ArrayType(_parse_datatype_string(patch.EDIT))))
    messages = pa.array([bytes.fromhex("1a0208051001")] * n, pa.binary())
    began = time.process_time()
    edited, states = patch._edit_batch(messages, logs, False), patch._state_batch(messages, logs, False)
    assert time.process_time() - began < 3
    assert [x.hex() for x in edited.to_pylist()] == ["1a0308ac02382b", "1a0308ac021001", "1a0208051001", "1a0208051001"] * (n // 4)
    assert [(r["parent"], r["field_number"], r["varint"], r["deleted"], r["child"]) for r in states[0].as_py()] == [
        ("", 3, None, False, True), ("", 2, 1, True, False), ("", 7, 43, False, False), ("/3:0", 1, 300, False, False)]
    assert len(states) == n and [len(x) for x in states.to_pylist()[-4:]] == [4, 3, 2, 0]


def test_chunks_of_a_table_travel_and_are_walked_in_runs(spark):
    """Chunks in a row are one row of the shuffle; gaps, null numbers and other streams begin new ones. Whole streams are walked in step."""
    import pyarrow as pa

    rows = [("a", 0, b"\x08", False), ("a", 1, b"\x05", True), ("a", 3, b"", None), (None, 4, None, True), (None, None, b"", False), (None, None, b"", False)]
    batch = pa.RecordBatch.from_pylist([dict(zip(chunks.CHUNK_NAMES, r)) for r in rows], pa.schema([("stream_id", pa.string()), ("seq", pa.int64()), ("chunk", pa.binary()), ("last", pa.bool_())]))
    assert [r["seqs"] for b in chunks._runs(iter([batch])) for r in b.to_pylist()] == [[0, 1], [3], [4], [None], [None]]
    df = spark.range(50).selectExpr("cast(id as string) as stream_id", "case when id = 7 then X'0805FF' when id = 8 then X'1A0208' else X'1A020805080108029D0100000080' end as msg")
    cut = chunks.cut(df, 3).repartition(3, "seq")
    inner = chunks.paths_of_chunks(cut, [[26, 8], [157]], members=["varint", "error"])
    assert inner.columns == ["stream_id", "varint", "error"]
    got = sorted((int(r.stream_id), r.varint or 0, r.error) for r in inner.collect())
    assert got == sorted([(i, v, None) for i in range(50) if i not in (7, 8) for v in (5, 1 << 31)] + [(7, 0, "Truncated"), (8, 0, "Truncated")])
    top = [(r.offset, r.path, r.tag, r.varint, bytes(r.raw).hex(), r.payload, r.length, r.is_last) for r in chunks.fields_of_chunks(cut).filter("stream_id = '9'").orderBy("offset").collect()]
    assert top == [(0, [26], 26, None, "1a020805", b"\x08\x05", 2, True), (4, [8], 8, 1, "0801", None, None, True), (6, [8], 8, 2, "0802", None, None, True), (8, [157], 157, 1 << 31, "9d0100000080", None, None, True)]


def test_drilldown_costs_array_work_a_place():
    """80,000 places in 20,000 messages; paths were lists of Python numbers, one by one (three times the time)."""
    import time

    import pyarrow as pa

    line = bytes.fromhex("520608011007180952040801100a")
    column, places = pa.array([line, None, b"", line] * 5000, pa.binary()), pa.array([[0, 2, 12, 99, None, -1], [1], [0], None] * 5000, pa.list_(pa.int32()))
    began = time.process_time()
    got = document._deepest(column, places, [82], False)
    assert time.process_time() - began < 2
    want = [(0, 0, 10, 0, 8, [0]), (2, 1, 1, 2, 4, [0, 0]), (12, 1, 2, 12, 14, [1, 1])]
    assert [(r["byte"], r["depth"], r["field_number"], r["begin"], r["end"], r["path"]) for r in got[0].as_py()] == want
    assert [len(x) for x in got.to_pylist()] == [3, 0, 0, 0] * 5000
