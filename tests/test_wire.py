"""Codecs, scans and encoders against golden bytes and a straight-line decoder."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wireloom.functions import encode as E
from wireloom.functions import tags as T
from wireloom.functions import text as X
from wireloom.functions import varint as V
from wireloom.functions.bits import reading
from wireloom.operators import document, packed
from wireloom.sources import envelope, fields

U64 = 2**64


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def binary(text):
    return F.lit(bytes.fromhex(text.replace(" ", "")))


def messages(spark, *texts):
    return spark.createDataFrame([(i, bytes.fromhex(t.replace(" ", ""))) for i, t in enumerate(texts)], "i int, msg binary")


def signed(x):
    return x - U64 if x >= U64 // 2 else x


def naive_varint(b, at, most, top):
    value = 0
    for i in range(most):
        if at + i >= len(b):
            return "Truncated"
        value |= (b[at + i] & 127) << 7 * i
        if b[at + i] < 128:
            return "InvalidVarint" if i == most - 1 and b[at + i] > top else (value, at + i + 1)
    return "InvalidVarint"


def naive_decode(b, groups=False):
    """One byte after another: fields as (offset, tag, value or bytes, end), and the error."""

    def field(at):
        got = naive_varint(b, at, 5, 0x0F)
        if isinstance(got, str):
            return got, at
        tag, pos = got
        kind = tag & 7
        if not tag >> 3 or kind not in (0, 1, 2, 5, *((3, 4) if groups else ())):
            return "InvalidTag", at
        if kind == 0:
            got = naive_varint(b, pos, 10, 1)
            return (got, pos) if isinstance(got, str) else (tag, got[0], got[1])
        if kind in (1, 5):
            n = 8 if kind == 1 else 4
            return ("Truncated", pos) if len(b) - pos < n else (tag, int.from_bytes(b[pos : pos + n], "little"), pos + n)
        if kind == 2:
            got = naive_varint(b, pos, 5, 0x0F)
            if isinstance(got, str):
                return got, pos
            n, start = got
            return ("Truncated", start) if len(b) - start < n else (tag, b[start : start + n], start + n)
        if kind == 4:
            return "MalformedGroup", at
        end = pos
        while True:
            got = naive_varint(b, end, 5, 0x0F)
            if isinstance(got, str) or not got[0] >> 3 or got[0] & 7 > 5:
                return "MalformedGroup", pos
            if got[0] & 7 == 4:
                return (tag, b[pos:end], got[1]) if got[0] >> 3 == tag >> 3 else ("MalformedGroup", pos)
            inner = field(end)
            if len(inner) == 2:
                return "MalformedGroup", pos
            end = inner[2]

    out, at = [], 0
    while at < len(b):
        got = field(at)
        if len(got) == 2:
            return out, got
        out.append((at, got[0], got[1], got[2]))
        at = got[2]
    return out, None


def seen(row):
    out = []
    for f in row["fields"]:
        value = next(f[c] for c in ("varint", "fixed32", "fixed64", "bytes") if f[c] is not None)
        out.append((f["offset"], f["tag"], value % U64 if isinstance(value, int) else value, f["end"]))
    error = row["error"]
    return out, error and (error["kind"], error["offset"])


@pytest.mark.parametrize(
    ("text", "groups", "n", "error"),
    [
        ("", False, 0, None), ("089601 1203616263 1D01020304 211122334455667788", False, 4, None), ("0001", False, 0, ("InvalidTag", 0)),
        ("0E", False, 0, ("InvalidTag", 0)), ("0F", False, 0, ("InvalidTag", 0)), ("0B", False, 0, ("InvalidTag", 0)), ("800101", False, 1, None),
        ("FDFFFFFF0F 01020304", False, 1, None), ("08FFFFFFFFFFFFFFFFFF01", False, 1, None), ("08FFFFFFFFFFFFFFFFFF02", False, 0, ("InvalidVarint", 1)),
        ("08" + "FF" * 11, False, 0, ("InvalidVarint", 1)), ("FFFFFFFF1000", False, 0, ("InvalidVarint", 0)), ("0896", False, 0, ("Truncated", 1)),
        ("1280", False, 0, ("Truncated", 1)), ("80", False, 0, ("Truncated", 0)), ("0D010203", False, 0, ("Truncated", 1)), ("0901020304050607", False, 0, ("Truncated", 1)),
        ("88008100", False, 1, None), ("128300616263", False, 1, None), ("1200", False, 1, None), ("08960100", False, 1, ("InvalidTag", 3)),
        ("1A030896012007", False, 2, None), ("0B10050C", True, 1, None), ("0C", True, 0, ("MalformedGroup", 0)), ("0B1005", True, 0, ("MalformedGroup", 1)),
        ("0A03AA", False, 0, ("Truncated", 2)), ("0B0B0C0C", True, 1, None), ("0B1314 0C", True, 1, None),
    ],
)
def test_golden_messages(text, groups, n, error):
    b = bytes.fromhex(text.replace(" ", ""))
    got = seen(fields.decode_batch(pa.array([b], pa.binary()), groups)[0].as_py())
    assert (len(got[0]), got[1]) == (n, error)
    assert got == naive_decode(b, groups)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=24), max_size=6), st.booleans())
def test_random_bytes_decode_as_one_by_one(batch, groups):
    got = fields.decode_batch(pa.array(batch, pa.binary()), groups)
    for row, b in zip(got, batch, strict=True):
        assert seen(row.as_py()) == naive_decode(b, groups)


FIELD = st.one_of(
    st.tuples(st.just(0), st.integers(0, U64 - 1)), st.tuples(st.just(1), st.binary(min_size=8, max_size=8)), st.tuples(st.just(5), st.binary(min_size=4, max_size=4)), st.tuples(st.just(2), st.binary(max_size=200))
)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, T.MAX_FIELD_NUMBER), FIELD), max_size=5), max_size=4), st.data())
def test_well_made_messages_and_their_stumps(batch, data):
    raw = []
    for message in batch:
        b = b""
        for number, (kind, value) in message:
            b += E._varint_bytes(T.tag(number, kind)) + (E._varint_bytes(value) if kind == 0 else value if kind != 2 else E._varint_bytes(len(value)) + value)
        raw.append(b[: data.draw(st.integers(0, len(b)))] if data.draw(st.booleans()) else b)
    for row, b in zip(fields.decode_batch(pa.array(raw, pa.binary())), raw, strict=True):
        assert seen(row.as_py()) == naive_decode(b)


def test_null_messages_and_rows(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, bytes.fromhex("089601"))], "i int, msg binary")
    assert [(r.i, r.varint) for r in fields.scan(df).collect()] == [(3, 150)]
    assert [r.n_fields for r in fields.errors(df).orderBy("i").collect()] == [None, 0, 1]


def test_modes(spark):
    df = messages(spark, "08960100", "0801")
    assert fields.scan(df, mode="cursor").count() == 2
    assert [r.i for r in fields.scan(df).collect()] == [1]
    with pytest.raises(Exception, match="bad message: InvalidTag at 3"):
        fields.scan(df, mode="strict").collect()


def test_error_taxonomies(spark):
    rows = fields.errors(messages(spark, "0896", "08FFFFFFFFFFFFFFFFFF02", "0A03AA", "0E")).orderBy("i").collect()
    assert [tuple(r.document) for r in rows] == [("Malformed", 1), ("Malformed", 1), ("Malformed", 2), ("Malformed", 0)]
    assert [tuple(r.walk) for r in rows] == [("Malformed", 0), ("Malformed", 1), ("Truncated", None), ("InvalidTag", None)]


@pytest.mark.parametrize(("text", "width", "want"), [("808001FF", 64, (16384, 3)), ("8001FF", 32, (128, 2)), ("80", 64, None), ("", 64, None), ("80" * 10, 64, None), ("80" * 9 + "02", 64, None), ("80" * 4 + "10", 32, None), ("8100", 64, (1, 2)), ("FF" * 9 + "01", 64, (-1, 10))])
def test_varint_decode(spark, text, width, want):
    (got,) = values(spark, V.varint_decode(F.lit(bytes.fromhex(text)), width))
    assert got == want or tuple(got) == want


def test_varint_and_zigzag_edges(spark):
    numbers = [0, 1, 127, 128, 16383, 16384, 2**35, 2**63 - 1, -1, -(2**63)]
    df = spark.createDataFrame([(n,) for n in numbers], "v long")
    rows = df.select("v", V.varint_encode("v").alias("b"), V.varint_len("v").alias("n"), V.zigzag_decode(V.zigzag_encode("v")).alias("z"), V.unsigned("v").alias("u"), V.varint_decode(V.varint_encode("v"))["value"].alias("back")).collect()
    for r in rows:
        assert bytes(r.b) == E._varint_bytes(r.v % U64)
        assert (r.n, r.z, int(r.u), r.back) == (len(r.b), r.v, r.v % U64, r.v)
    pairs = {0: 0, -1: 1, 1: 2, -2: 3, 2**31 - 1: 4294967294, -(2**31): 4294967295}
    df = spark.createDataFrame([(n,) for n in pairs], "v long")
    assert {r.v: r.z for r in df.select("v", V.zigzag_encode("v", 32).alias("z")).collect()} == pairs


def test_tags(spark):
    assert T.tag(1, "len") == 10 and T.path((3, "len"), (1, 0)) == (26, 8)
    for bad in (0, T.MAX_FIELD_NUMBER + 1):
        with pytest.raises(ValueError):
            T.field_number(bad)
    with pytest.raises(ValueError):
        T.tag(1, 7)
    got = values(spark, T.valid_tag(F.lit(8)), T.valid_tag(F.lit(7)), T.valid_tag(F.lit(11)), T.valid_tag(F.lit(11), True), T.decode_tag(binary("800101"))["tag"], T.decode_tag(binary("0E"))["tag"])
    assert got == [8, None, None, 11, 128, None]


def test_golden_encodings(spark):
    one, inner = E.varint(1, F.lit(150)), [E.message(2, [E.varint(3, F.lit(1))]), E.string(4, F.lit("xy"))]
    flat = [E.varint(1, F.lit(1)), E.fixed32(2, F.lit(0x11223344)), E.fixed64(3, F.lit(0x1122334455667788)), E.string(4, F.lit("abc"))]
    cases = {
        "089601": [one], "08011544332211198877665544332211" + "2203616263": flat, "1A03089601": [E.message(3, [one])], "0A001200": [E.message(1, []), E.string(2, F.lit(""))],
        "800101": [E.varint(16, F.lit(1))], "0A081202180122027879": [E.message(1, inner)], "0B10050C": [E.group(1, [E.varint(2, F.lit(5))])], "": [E.varint(1, F.lit(None))],
    }
    got = values(spark, *[x for f in cases.values() for x in (F.hex(E.encode_message(f)), E.encoded_len(f))])
    assert got[::2] == list(cases) and got[1::2] == [len(c) // 2 for c in cases]
    assert values(spark, F.hex(E.encode_into(binary("FFFE"), [one]))) == ["FFFE089601"]
    deep = E.varint(1, F.lit(1))
    for _ in range(100):
        deep = E.Field(deep.data, deep.size, deep.depth + 1)
    with pytest.raises(E.DepthLimitExceeded):
        E.message(1, [deep])


def test_scalar_matrix(spark):
    minus = "FFFFFFFFFFFFFFFFFF01"
    df = messages(spark, f"08{minus} 15 0000C0BF 19 000000000000F83F 2205C3A9616263").select(fields.cursor("msg").alias("d"))
    f = F.col("d.fields")
    v, a, b, s = (document.nth(f, i) for i in range(4))
    got = df.select(*[reading(k, x).alias(f"c{i}") for i, (k, x) in enumerate([("uint32", v), ("int32", v), ("int64", v), ("sint32", v), ("sint64", v), ("bool", v), ("fixed32", a), ("sfixed32", a), ("float", a), ("double", b), ("string", s), ("uint64", s), ("bytes", v)])]).first()
    assert list(got) == [4294967295, -1, -1, -(2**31), -(2**63), True, 0xBFC00000, -0x40400000, -1.5, 1.5, "éabc", None, None]


def test_lookups_by_tag_and_number(spark):
    df = messages(spark, "0807 0D2A000000 1009 0808").select(fields.cursor("msg").alias("d"))
    f = F.col("d.fields")
    b = document.bucket(f, 8)
    got = df.select(document.first(f, 8)["varint"], document.last(f, 8)["varint"], F.size(document.all_by_number(f, 1)), b["head"], b["tail"], b["n"], document.first(f, 99).isNull(), F.hex(document.to_bytes(document.without(f, F.array(F.lit(0), F.lit(1)))))).first()
    assert list(got) == [7, 8, 3, 0, 3, 2, True, "10090808"]
    # Tags become canonical, values and prefixes stay.
    again = messages(spark, "88008100 128300616263").select(F.hex(document.to_bytes(fields.cursor("msg")["fields"]))).first()[0]
    assert again == "08810012830061626 3".replace(" ", "")


@pytest.mark.parametrize(
    ("text", "kind", "want", "error"),
    [
        ("019601", "uint32", [1, 150], None), ("0205", "sint32", [1, -3], None), ("00027F", "bool", [0, 1, 1], None), ("FFFFFFFFFFFFFFFFFF01", "int32", [], 0), ("FFFFFFFF0F", "int32", [-1], None),
        ("0180", "uint64", [1], 1), ("", "uint64", [], None), ("0100000002000000", "fixed32", [1, 2], None), ("01000000FF", "fixed32", None, 4), ("000000000000F83F", "double", [1.5], None), ("FEFFFFFF", "sfixed32", [-2], None),
    ],
)
def test_packed(spark, text, kind, want, error):
    (got,) = values(spark, packed.packed(F.coalesce(binary(text)), kind))
    assert (got["values"], got["error"]) == (want, error)


def test_packed_batches_and_push(spark):
    df = spark.createDataFrame([(b"\x01\x80",), (None,), (b"\x05",), (b"",)], "b binary")
    assert [(r.p and r.p["values"], r.p and r.p["error"]) for r in df.select(packed.packed("b", "uint64").alias("p")).collect()] == [([1], 1), (None, None), ([5], None), ([], None)]
    assert values(spark, F.hex(packed.push(binary("01"), F.lit(-1), "int32")), F.hex(packed.push(binary(""), F.lit(-3), "sint64"))) == ["01FFFFFFFF0F", "05"]


def test_envelopes(spark):
    df = messages(spark, "00 00000003 089601 01 00000005 1203616263", "00000000", "00 00000003 AABB", "")
    got = df.orderBy("i").select(envelope.frames("msg").alias("e")).collect()
    assert [(f.idx, f.flags, f.header_offset, f.payload_offset, f.payload_len) for f in got[0].e.frames] == [(0, 0, 0, 5, 3), (1, 1, 8, 13, 5)]
    assert [r.e.error is not None for r in got] == [False, True, True, True] and "declares 3 byte(s)" in got[2].e.error
    rows = envelope.frame_rows(df)
    assert [(r.i, r.idx) for r in envelope.preferred(rows, ["i"]).collect()] == [(0, 0)]
    plain, zipped = binary("0102"), envelope.gzip(binary("0102"))
    got = values(spark, envelope.decompress(F.coalesce(zipped)), envelope.decompress(F.coalesce(plain)))
    assert [(bytes(g.payload), g.format) for g in got] == [(b"\1\2", "gzip"), (b"\1\2", None)]


def test_text_forms(spark):
    cases = {"0x08 96\n01": "089601", "CJYB": "089601", "-_8=": "FBFF", "-_8": "FBFF", "": None, "zz!": None, "abc": "69B7", "0801": "0801"}
    df = spark.createDataFrame(list(cases.items()), "t string, h string")
    assert {r.t: r.got for r in df.select("t", F.hex(X.from_text("t")).alias("got")).collect()} == cases
    ab, jo = F.lit(b"AB"), F.lit(b"Jo")
    got = values(spark, X.hex_spaced(ab), X.hex_compact(ab), X.c_array(F.lit(b"\x00\xff")), X.c_escape(jo), X.bracket_array(jo), F.base64(F.lit(b"John")), X.len_summary(ab), X.readable(F.lit(b"a\x01")), X.hex_dump(F.lit(b"Hello, World!")))
    assert got[:8] == ["41 42", "4142", "{ 0x00, 0xFF }", r"\x4A\x6F", "[0x4A, 0x6F]", "Sm9obg==", '2B "AB"', False]
    assert got[8].startswith("00000000  48 65 6C 6C 6F 2C 20 57  6F 72 6C 64 21") and got[8].endswith("|Hello, World!|")
    got = values(spark, X.number(F.lit("0xff")), X.number(F.lit("18446744073709551615")), X.number(F.lit("18446744073709551616")), X.number(F.lit("x")), X.user_path(X.parse_user_path(F.lit(".3.1:2"))), X.parse_user_path(F.lit("3..1")), X.frame_name(F.lit("{source}#{idx1}/{idx} {len}"), F.lit("m"), F.lit(0), F.lit(9)))
    assert got == [255, -1, None, None, ".3.1:2", None, "m#1/0 9"]
    bad = values(spark, X.utf8_error(F.coalesce(F.lit(b"ab\xff"))), X.utf8_error(F.coalesce(F.lit(b"ab\xe2\x82"))), X.utf8_error(F.coalesce(F.lit(b"ab"))))
    assert [b and tuple(b) for b in bad] == [(2, 1), (2, None), None]


def test_packed_kinds_share_a_worker(spark):
    """Arrays read in one query take one pass through Python, so its memory doesn't grow with their number."""
    df = spark.createDataFrame([(b"\x01\x80",), (None,)], "b binary").select(packed.packed("b", "uint64").alias("x"), packed.packed("b", "sint32").alias("y"), packed.packed("b", "double").alias("z"))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.x and r.x["error"], r.y and r.y["values"], r.z and r.z["error"]) for r in df.collect()] == [(1, [-1], 0), (None, None, None)]


def test_decoding_holds_a_slice_of_a_batch(spark):
    """What decoding takes follows the longest message, not the batch."""
    import tracemalloc

    column = pa.array([b"\x0a\xe8\x07" + bytes(1000)] * 15000 + [None, b""] + [b"\x08\x05"] * 3)
    assert [hi - lo for lo, hi in fields.slices(column.slice(14999), 1003)] == [3, 3] and list(fields.slices(column[:0])) == [(0, 0)]
    tracemalloc.start()
    try:
        got = [x for out in fields._decoder(False, ["tag"]).func(iter([column])) for x in pa.compute.list_value_length(out.field("fields")).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[:15000] == [1] * 15000 and got[15001:] == [0, 1, 1, 1] and peak < 100e6
