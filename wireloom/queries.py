"""Queries over the driver's tables, each with the SQL that checks it.

The SQL never decodes: it computes what must come out from the columns that the
messages were made of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import encode as E
from .functions import tags as T
from .functions import text as X
from .functions import varint as V
from .functions.bits import reading
from .operators import catalog, document, packed, patch, paths
from .plans import messages as M
from .plans.messages import table
from .sources import envelope, fields
from .streaming import chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _len(v: str) -> str:
    """SQL for the varint length of a number that isn't negative."""
    return "CASE " + " ".join(f"WHEN {v} < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


def _hex(v: str) -> str:
    """SQL for the varint bytes, in hex, of a number below 2**35 that isn't negative."""
    out = ""
    for n in range(1, 6):
        parts = " || ".join(f"printf('%02X', (({v}) >> {7 * i}) & 127{' | 128' if i < n - 1 else ''})" for i in range(n))
        out += f" WHEN ({v}) < {1 << 7 * n} THEN {parts}"
    return f"(CASE{out} END)"


def _zig(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN -2 * ({v}) - 1 ELSE 2 * ({v}) END)"


def _le(v: str, n: int) -> str:
    return " || ".join(f"printf('%02X', (({v}) >> {8 * i}) & 255)" for i in range(n))


def _str(c: str) -> str:
    """SQL for the length prefix and bytes of a string, in hex."""
    return f"{_hex(f'octet_length(encode({c}))')} || hex(encode({c}))"


# Varints, zigzag and tags


@query(f"SELECT o_orderkey, {_hex('o_orderkey')} AS key_hex, {_hex('o_custkey * 1000')} AS cust_hex, ({_len('o_custkey * 1000')})::INTEGER AS cust_len FROM orders")
def varint_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    big = F.col("o_custkey") * 1000
    return o.select("o_orderkey", F.hex(V.varint_encode("o_orderkey")).alias("key_hex"), F.hex(V.varint_encode(big)).alias("cust_hex"), V.varint_len(big).cast("int").alias("cust_len"))


@query(f"SELECT o_orderkey, o_orderkey * 99991 AS value, ({_len('o_orderkey * 99991')})::INTEGER AS used FROM orders")
def varint_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    got = V.varint_decode(F.concat(V.varint_encode(F.col("o_orderkey") * 99991), F.lit(b"\xff")))
    return o.select("o_orderkey", got.alias("g")).select("o_orderkey", "g.value", "g.used")


@query(f"SELECT c_custkey, {_zig('round(c_acctbal * 100)::BIGINT')} AS zig, round(c_acctbal * 100)::BIGINT AS back, {_zig('c_nationkey - 12')}::BIGINT AS zig32, (c_nationkey - 12)::BIGINT AS back32 FROM customer")
def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    cents, small = M.cents("c_acctbal"), F.col("c_nationkey") - 12
    return c.select("c_custkey", V.zigzag_encode(cents).alias("zig"), V.zigzag_decode(V.zigzag_encode(cents)).alias("back"), V.zigzag_encode(small, 32).alias("zig32"), V.zigzag_decode(V.zigzag_encode(small, 32), 32).alias("back32"))


@query("""WITH t AS (SELECT n * 1234567 AS number, w FROM range(500) a(n), range(8) b(w))
SELECT number, w, CASE WHEN number BETWEEN 1 AND 536870911 AND w IN (0, 1, 2, 5) THEN number * 8 + w END AS tag,
 CASE WHEN number BETWEEN 1 AND 536870911 AND w IN (0, 1, 2, 5) THEN number::INTEGER END AS back_number,
 CASE WHEN number BETWEEN 1 AND 536870911 AND w IN (0, 1, 2, 5) THEN w::INTEGER END AS back_type,
 CASE WHEN number BETWEEN 1 AND 536870911 AND w < 6 THEN number * 8 + w END AS with_groups FROM t""")
def tag_make_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(500).select((F.col("id") * 1234567).alias("number"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("w"))
    t = t.withColumn("tag", T.make_tag("number", "w"))
    return t.select("number", "w", "tag", T.tag_number("tag").alias("back_number"), T.tag_wire_type("tag").alias("back_type"), T.make_tag("number", "w", groups=True).alias("with_groups"))


# Encoding

_CUSTOMER_HEX = f"""'08' || {_hex('c_custkey')} || '12' || {_str('c_name')} || '18' || {_hex(_zig('c_nationkey'))} || '20' || {_hex(_zig('round(c_acctbal * 100)::BIGINT'))} || '2A' || {_str('c_mktsegment')}"""


@query(f"SELECT c_custkey, {_CUSTOMER_HEX} AS msg_hex, (length({_CUSTOMER_HEX}) / 2)::INTEGER AS size FROM customer")
def encode_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.hex(E.encode_message(M.customer_fields())).alias("msg_hex"), E.encoded_len(M.customer_fields()).alias("size"))


@query(f"""WITH b AS (SELECT *, '08' || {_hex('p_size')} || '15' || {_le('p_size', 4)} AS inner_, '0A' || {_str('p_brand')} AS deep FROM part)
SELECT p_partkey, '0A' || {_hex('length(inner_) // 2')} || inner_ || '1A' || {_hex('length(deep) // 2 + 2')} || '12' || {_hex('length(deep) // 2')} || deep || '2200' AS msg_hex FROM b""")
def encode_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    msg = [E.message(1, [E.varint(1, "p_size"), E.fixed32(2, "p_size")]), E.message(3, [E.message(2, [E.string(1, "p_brand")])]), E.message(4, [])]
    return p.select("p_partkey", F.hex(E.encode_message(msg)).alias("msg_hex"))


# Decoding


@query("SELECT o_orderstatus AS status, count(*) AS n, sum(o_custkey)::BIGINT AS customers FROM orders GROUP BY o_orderstatus")
def order_totals_from_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages, decoded and pivoted back, totalled by status."""
    rows = fields.scan(M.order_heads(spark, sf_dir), members=["field_number", "varint", "bytes"])
    wide = rows.groupBy("o_orderkey").agg(
        F.max(F.when(F.col("field_number") == 2, F.col("varint"))).alias("customer"),
        F.max(F.when(F.col("field_number") == 3, F.col("bytes").cast("string"))).alias("status"),
    )
    return wide.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("customer").cast("long").alias("customers"))


@query(f"""WITH s AS (SELECT o_orderkey, {_len('o_orderkey')} AS a, {_len('o_custkey')} AS b, o_custkey, o_orderstatus FROM orders),
r AS (SELECT o_orderkey, 0 AS ord, 8 AS tag, 0 AS offset_, 1 + a AS end_, o_orderkey AS varint, NULL AS text FROM s
UNION ALL SELECT o_orderkey, 1, 16, 1 + a, 2 + a + b, o_custkey, NULL FROM s
UNION ALL SELECT o_orderkey, 2, 26, 2 + a + b, 4 + a + b + length(o_orderstatus), NULL, o_orderstatus FROM s)
SELECT o_orderkey, ord::INTEGER AS ord, tag::BIGINT AS tag, offset_::INTEGER AS start, end_::INTEGER AS stop, (end_ - offset_)::INTEGER AS raw_len, varint, text FROM r""")
def cursor_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields.scan(M.order_heads(spark, sf_dir), mode="cursor")
    return rows.select("o_orderkey", "ord", "tag", F.col("offset").alias("start"), F.col("end").alias("stop"), F.length("raw").alias("raw_len"), "varint", F.col("bytes").cast("string").alias("text"))


@query(f"""WITH s AS (SELECT o_orderkey, {_len('o_orderkey')} AS a, {_len('o_custkey')} AS b, length(o_orderstatus) AS c FROM orders),
t AS (SELECT *, 4 + a + b + c AS n, k FROM s, range(1, 6) x(k)), u AS (SELECT *, n - k AS m FROM t)
SELECT o_orderkey, k::INTEGER AS cut, (CASE WHEN m >= 2 + a + b THEN 2 WHEN m >= 1 + a THEN 1 ELSE 0 END)::INTEGER AS n_fields,
 CASE WHEN m IN (0, 1 + a, 2 + a + b) THEN NULL ELSE 'Truncated' END AS kind,
 CASE WHEN m IN (0, 1 + a, 2 + a + b) THEN NULL WHEN m >= 4 + a + b THEN 4 + a + b WHEN m >= 3 + a + b THEN 3 + a + b WHEN m > 1 + a THEN 2 + a WHEN m > 0 THEN 1 END::INTEGER AS at FROM u""")
def cursor_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages cut short by 1 to 5 bytes."""
    m = M.order_heads(spark, sf_dir).select("o_orderkey", "msg", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("cut"))
    m = m.withColumn("msg", F.substring("msg", F.lit(1), F.length("msg") - F.col("cut")))
    got = fields.errors(m)
    return got.select("o_orderkey", "cut", "n_fields", F.col("cursor.kind").alias("kind"), F.col("cursor.offset").alias("at"))


@query("""SELECT c_custkey, c_custkey AS k, (c_custkey::INTEGER) AS k32, c_name AS name, c_nationkey AS nation, round(c_acctbal * 100)::BIGINT AS cents, c_custkey <> 0 AS yes, NULL::BIGINT AS none FROM customer""")
def scalar_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.customers(spark, sf_dir).select("c_custkey", fields.cursor("msg").alias("d"))
    f = F.col("d.fields")

    def one(n: int, kind: str, wire: str, name: str):
        return reading(kind, document.first(f, T.tag(n, wire))).alias(name)

    return d.select(
        "c_custkey", one(1, "uint64", "varint", "k"), one(1, "int32", "varint", "k32"), one(2, "string", "len", "name"), one(3, "sint32", "varint", "nation"),
        one(4, "sint64", "varint", "cents"), one(1, "bool", "varint", "yes"), one(2, "uint64", "len", "none"),
    )


@query("""SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity AS quantity, (l_linenumber * 7)::BIGINT AS seven, l_returnflag AS flag FROM lineitem""")
def nested_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = paths.extract(M.orders(spark, sf_dir), M.LINE, ["o_orderkey"], members=["payload"]).select("o_orderkey", fields.cursor("payload", members=["tag", "wire_type", "varint", "fixed32", "fixed64", "bytes"]).alias("d"))
    f = F.col("d.fields")
    return inner.select(
        "o_orderkey", reading("int32", document.first(f, T.tag(1, "varint"))).alias("l_linenumber"), reading("double", document.first(f, T.tag(4, "i64"))).alias("quantity"),
        reading("fixed32", document.first(f, T.tag(16, "i32"))).alias("seven"), reading("string", document.last(f, T.tag(8, "len"))).alias("flag"),
    )


@query("""SELECT o_orderkey, count(l_orderkey)::INTEGER AS n_lines, CASE WHEN count(l_orderkey) > 0 THEN 3 END AS head, CASE WHEN count(l_orderkey) > 0 THEN (2 + count(l_orderkey))::INTEGER END AS tail,
 (3 + count(l_orderkey))::INTEGER AS n_fields, 2 AS varints, (1 + count(l_orderkey))::INTEGER AS lendels, count(l_orderkey) > 0 AS any_line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def document_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.orders(spark, sf_dir).select("o_orderkey", fields.cursor("msg", members=["ord", "tag", "wire_type"]).alias("d"))
    f, line = F.col("d.fields"), T.tag(10, "len")
    stats, b = document.wire_stats(f), document.bucket(f, line)
    return d.select("o_orderkey", F.size(document.all_of(f, line)).alias("n_lines"), b["head"].alias("head"), b["tail"].alias("tail"), stats["fields"].alias("n_fields"), stats["varints"].alias("varints"), stats["lendels"].alias("lendels"), document.has(f, line).alias("any_line"))


@query(f"""SELECT c_custkey, {_CUSTOMER_HEX} AS whole, '08' || {_hex('c_custkey')} || '18' || {_hex(_zig('c_nationkey'))} || '20' || {_hex(_zig('round(c_acctbal * 100)::BIGINT'))} || '2A' || {_str('c_mktsegment')} AS without_name FROM customer""")
def document_reencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.customers(spark, sf_dir).select("c_custkey", fields.cursor("msg").alias("d"))
    f = F.col("d.fields")
    return d.select("c_custkey", F.hex(document.to_bytes(f)).alias("whole"), F.hex(document.to_bytes(document.without(f, F.array(F.lit(1))))).alias("without_name"))


@query("""SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum([x::DOUBLE for x in embedding]), 4) AS total, embedding[1]::DOUBLE AS first_, embedding[-1]::DOUBLE AS last_, label FROM embeddings""")
def packed_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.embeddings(spark, sf_dir).select("vec_id", fields.cursor("msg").alias("d"))
    f = F.col("d.fields")
    got = d.select("vec_id", packed.packed(document.first(f, T.tag(2, "len"))["bytes"], "float").alias("p"), reading("int32", document.first(f, T.tag(3, "varint"))).alias("label"))
    v = F.col("p.values")
    return got.select("vec_id", F.size(v).alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.element_at(v, 1).alias("first_"), F.element_at(v, -1).alias("last_"), "label")


@query("""SELECT o_orderkey, [o_custkey, o_orderkey, 300] AS unsigned, [-o_custkey, o_orderkey, -3] AS signed, (o_orderkey % 3) = 0 AS odd_size,
 CASE WHEN o_orderkey % 3 = 0 THEN 4 END::INTEGER AS fixed_error FROM orders""")
def packed_varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    plain = F.array("o_custkey", "o_orderkey")
    u = packed.push(E.concat_all(F.transform(plain, lambda x: packed.packed_element(x, "uint64"))), F.lit(300), "uint64")
    s = packed.push(E.concat_all(F.transform(F.array(-F.col("o_custkey"), "o_orderkey"), lambda x: packed.packed_element(x, "sint64"))), F.lit(-3), "sint64")
    odd = F.concat(packed.packed_element("o_custkey", "fixed32"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(b"\x01")).otherwise(F.lit(b"")))
    got = o.select("o_orderkey", packed.packed(u, "uint64").alias("u"), packed.packed(s, "sint64").alias("s"), packed.packed(odd, "fixed32").alias("f"))
    return got.select("o_orderkey", F.col("u.values").alias("unsigned"), F.col("s.values").alias("signed"), F.col("f.error").isNotNull().alias("odd_size"), F.col("f.error").alias("fixed_error"))


@query(f"""WITH o AS (SELECT o_orderkey AS k, {_len('o_orderkey')} AS a FROM orders), t AS (SELECT k, a, i FROM o, range(8) x(i))
SELECT k AS o_orderkey, i::INTEGER AS way, (CASE WHEN i = 6 THEN 2 ELSE 1 END)::INTEGER AS n_fields, CASE i WHEN 0 THEN 'InvalidVarint' WHEN 1 THEN 'InvalidTag' WHEN 2 THEN 'InvalidTag' WHEN 3 THEN 'MalformedGroup' WHEN 4 THEN 'MalformedGroup' WHEN 5 THEN 'InvalidVarint' WHEN 7 THEN 'MalformedGroup' END AS kind,
 CASE i WHEN 0 THEN 2 + a WHEN 1 THEN 1 + a WHEN 2 THEN 1 + a WHEN 3 THEN 1 + a WHEN 4 THEN 2 + a WHEN 5 THEN 1 + a WHEN 7 THEN 2 + a END::INTEGER AS at, CASE WHEN i = 6 THEN '1005' END AS group_hex FROM t""")
def decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad varints, tags and groups behind a good field; one way is a good group."""
    ways = [b"\x08" + b"\xff" * 9 + b"\x02", b"\x00\x01", b"\x0e", b"\x0c", b"\x0b\x10\x05", b"\xff\xff\xff\xff\x10\x00", b"\x0b\x10\x05\x0c", b"\x0b\x14\x0c"]
    tails = F.posexplode(F.array(*(F.lit(w) for w in ways))).alias("way", "tail")
    m = table(spark, sf_dir, "orders").select("o_orderkey", tails).select("o_orderkey", "way", F.concat(E.encode_message([E.varint(1, "o_orderkey")]), "tail").alias("msg"))
    d = m.select("o_orderkey", "way", fields.cursor("msg", groups=True, members=["tag", "bytes"]).alias("d"))
    return d.select("o_orderkey", "way", F.size("d.fields").alias("n_fields"), F.col("d.error.kind").alias("kind"), F.col("d.error.offset").alias("at"), F.hex(document.first(F.col("d.fields"), T.tag(1, "sgroup"))["bytes"]).alias("group_hex"))


_KINDS = {"uint32": ("o_custkey", "7"), "int32": ("-o_custkey", "-7"), "sint32": ("-o_custkey", "7"), "bool": ("1", "0"), "uint64": ("o_custkey * 1000003", "7"), "int64": ("-o_custkey * 1000003", "7"), "sint64": ("-o_custkey * 1000003", "7"), "fixed32": ("o_custkey", "7"), "sfixed32": ("-o_custkey", "7"), "fixed64": ("o_custkey * 1000003", "7"), "sfixed64": ("-o_custkey * 1000003", "-7")}


@query("SELECT o_orderkey, " + ", ".join(f"[{a}, {b}]::BIGINT[] AS {k}_values" for k, (a, b) in _KINDS.items()) + ", [o_custkey + 0.5, -2.25]::DOUBLE[] AS double_values, [o_custkey % 1000 + 0.5, -2.25]::DOUBLE[] AS float_values, 0 AS cut_at FROM orders")
def packed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed kind, written and read."""
    from .functions.bits import double_bits, float_bits

    o = table(spark, sf_dir, "orders")
    arrays = {k: [packed.packed_element(F.expr(x).cast("long"), k) for x in two] for k, two in _KINDS.items()}
    arrays |= {"double": [packed.packed_element(double_bits(x), "fixed64") for x in (F.col("o_custkey") + F.lit(0.5), F.lit(-2.25))], "float": [packed.packed_element(float_bits(x.cast("float")), "fixed32") for x in (F.col("o_custkey") % 1000 + F.lit(0.5), F.lit(-2.25))]}
    cut = packed.packed(F.lit(b"\x80"), "uint64")["error"]
    return o.select("o_orderkey", *(packed.packed(F.concat(*two), k)["values"].alias(f"{k}_values") for k, two in arrays.items()), cut.alias("cut_at"))


# Paths


@query("""SELECT l_orderkey AS o_orderkey, 2 AS depth, l_partkey AS varint, NULL::VARCHAR AS text FROM lineitem UNION ALL SELECT o_orderkey, 1, NULL, o_orderstatus FROM orders
UNION ALL SELECT l_orderkey, 2, l_linenumber, NULL FROM lineitem""")
def scan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = paths.scan_paths(M.orders(spark, sf_dir), [M.LINE_PART, M.ORDER_STATUS, M.LINE_NUMBER], ["o_orderkey"], members=["depth", "varint", "payload"])
    return got.select("o_orderkey", "depth", "varint", F.col("payload").cast("string").alias("text"))


@query("""WITH e AS (SELECT l_orderkey AS o_orderkey, 2 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS place, 2 AS depth, l_partkey AS part FROM lineitem)
SELECT o_orderkey, place::INTEGER AS place, depth, part FROM e UNION ALL SELECT o_orderkey, (place + 1)::INTEGER, 1, NULL FROM e""")
def scan_emission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are wanted, and a field inside: each comes after what is in it."""
    from pyspark.sql import Window

    got = paths.scan_paths(M.orders(spark, sf_dir), [M.LINE, M.LINE_PART], ["o_orderkey"], members=["depth", "varint", "end"])
    place = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("end", F.desc("depth")))
    return got.select("o_orderkey", place.alias("place"), "depth", F.col("varint").alias("part"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS ok FROM orders")
def well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.order_heads(spark, sf_dir)
    m = m.withColumn("msg", F.when(F.col("o_orderkey") % 2 == 0, F.col("msg")).otherwise(F.concat("msg", F.lit(b"\x08"))))
    return paths.well_formed(m, ["o_orderkey"])


@query("""SELECT l_orderkey AS o_orderkey, size, l_partkey AS varint FROM lineitem, (SELECT unnest([7, 64])::INTEGER AS size)""")
def chunked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in chunks of 7 and 64 bytes, walked chunk by chunk."""
    m = M.orders(spark, sf_dir).withColumn("size", F.explode(F.array(F.lit(7), F.lit(64))))
    got = chunks.paths_of_chunks(chunks.cut(m.withColumn("stream_id", F.concat_ws(":", "o_orderkey", "size")), F.col("size")), [M.LINE_PART], members=["varint"])
    at = F.split("stream_id", ":")
    return got.select(at[0].cast("long").alias("o_orderkey"), at[1].cast("int").alias("size"), "varint")


@query(f"""WITH s AS (SELECT o_orderkey, 1 + {_len('o_orderkey')} AS a, 1 + {_len('o_custkey')} AS b, o_custkey, o_orderstatus FROM orders)
SELECT o_orderkey, 0 AS start, o_orderkey AS varint, NULL AS text, true AS is_last, NULL AS error FROM s UNION ALL SELECT o_orderkey, a, o_custkey, NULL, true, NULL FROM s
UNION ALL SELECT o_orderkey, a + b, NULL, o_orderstatus[:1], false, NULL FROM s UNION ALL SELECT o_orderkey, a + b, NULL, NULL, NULL, 'Truncated' FROM s""")
def chunked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 3 bytes of messages whose last field is cut off: what is open is told, then the error."""
    m = M.order_heads(spark, sf_dir)
    status = E.encode_message([E.varint(1, "o_orderkey"), E.varint(2, "o_custkey"), E.binary(3, F.concat(F.col("o_orderstatus").cast("binary"), F.lit(bytes(100))))])
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("stream_id"), F.substring(status, F.lit(1), F.length(status) - 100).alias("msg"))
    got = chunks.fields_of_chunks(chunks.cut(m, 3), partial=True)
    return got.select(F.col("stream_id").cast("long").alias("o_orderkey"), F.col("offset").cast("int").alias("start"), "varint", F.col("payload").cast("string").alias("text"), "is_last", "error")


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS way FROM orders)
SELECT o_orderkey, CASE WHEN way = 0 THEN [o_custkey, 5] WHEN way = 1 THEN [o_custkey] END AS strict_values, CASE WHEN way = 1 THEN [o_custkey] ELSE [o_custkey, 5] END AS lenient_values, CASE WHEN way = 2 THEN 'Malformed' END AS kind FROM o""")
def planned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed reads inside a group and a message: all or nothing, or what comes before an error."""
    inner = E.message(4, [E.varint(2, "o_custkey")])
    two = [E.group(3, [inner]), E.group(3, [E.message(4, [E.varint(2, F.lit(5))])])]
    o = table(spark, sf_dir, "orders")
    way = F.col("o_orderkey") % 3
    msg = F.when(way == 0, E.encode_message(two)).when(way == 1, E.encode_message(two[:1])).otherwise(F.concat(E.encode_message(two), F.lit(b"\x80")))
    m = o.select("o_orderkey", msg.alias("msg"))
    path = T.path((3, "sgroup"), (4, "len"), (2, "varint"))
    return m.select("o_orderkey", paths.values_at("msg", path, "uint64", strict=True).alias("strict_values"), paths.values_at("msg", path, "uint64").alias("lenient_values"), paths.walk("msg", [path], groups=True, members=["depth"])["error"]["kind"].alias("kind"))


# Edits


def _log(df: DataFrame, *edits: dict) -> DataFrame:
    """The same edits for every message of df."""
    return df.select("c_custkey", F.inline(patch.Log(list(edits)).column()))


def _at(*steps: tuple[int, int]) -> list[tuple[int, int]]:
    return list(steps)


_EDITED = f"""'08' || {_hex('7')} || '12' || {_str('c_name')} || '20' || {_hex(_zig('round(c_acctbal * 100)::BIGINT'))} || '2A' || {_str('c_mktsegment')} || 'C803' || '8101' || 'D203' || '026869'"""


@query(f"SELECT c_custkey, {_EDITED} AS edited, {_CUSTOMER_HEX} AS untouched FROM customer")
def patch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set, delete and insert; a transaction that was rolled back leaves no trace."""
    m = M.customers(spark, sf_dir)
    log = _log(
        m,
        {"seq": 1, "op": "set", "path": _at((1, 0)), "value": 7},
        {"seq": 2, "op": "delete", "path": _at((3, 0))},
        {"seq": 3, "op": "insert", "path": [], "tag": T.tag(57, "varint"), "value": 128},
        {"seq": 4, "op": "set", "target": 3, "value": 129},
        {"seq": 5, "op": "insert", "path": [], "tag": T.tag(58, "len"), "payload": b"hi"},
        {"seq": 6, "op": "set_bytes", "path": _at((2, 0)), "payload": b"lost", "txn": "t"},
        {"seq": 7, "op": "set", "path": _at((9, 0)), "value": 1},
    )
    states = spark.createDataFrame([("t", "rolled back")], "txn string, state string")
    edited = patch.apply_edits(m, patch.committed(log, states), ["c_custkey"]).select("c_custkey", F.hex("msg").alias("edited"))
    same = patch.apply_edits(m, patch.committed(log.filter("txn = 't'"), states), ["c_custkey"]).select("c_custkey", F.hex("msg").alias("untouched"))
    return edited.join(same, "c_custkey")


_INNER = f"'08' || {_hex('c_custkey + 1000000')} || '12' || {_str('c_name')}"
_CHANGED = f"'0805' || '12' || {_str('c_name')} || '2001'"


@query(f"SELECT c_custkey, '1A' || {_hex(f'length({_CHANGED}) // 2')} || {_CHANGED} || '1A00' AS edited FROM customer")
def patch_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits two levels down; the lengths above follow."""
    c = table(spark, sf_dir, "customer")
    m = c.select("c_custkey", E.encode_message([E.message(3, [E.varint(1, F.col("c_custkey") + 1000000), E.string(2, "c_name")]), E.message(3, [])]).alias("msg"))
    log = _log(m, {"seq": 1, "op": "set", "path": _at((3, 0), (1, 0)), "value": 5}, {"seq": 2, "op": "insert", "path": _at((3, 0)), "tag": T.tag(4, "varint"), "value": 1})
    return patch.apply_edits(m, log, ["c_custkey"]).select("c_custkey", F.hex("msg").alias("edited"))


@query("SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey + 100 AS part FROM lineitem")
def edit_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds 100 to a field of every line item inside its order."""
    m = M.orders(spark, sf_dir)
    got = patch.edit_values(m, list(M.LINE_PART), lambda v: v + 100, ["o_orderkey"])
    inner = paths.extract(got, M.LINE, ["o_orderkey"], members=["payload"]).select("o_orderkey", fields.cursor("payload", members=["tag", "varint"]).alias("d"))
    return inner.select("o_orderkey", document.first(F.col("d.fields"), T.tag(1, "varint"))["varint"].cast("int").alias("l_linenumber"), document.first(F.col("d.fields"), T.tag(2, "varint"))["varint"].alias("part"))


_KINDS_HEX = f"""'08' || {_hex(_zig('5 - c_custkey'))} || '15' || {_le('c_custkey + 1', 4)} || '19' || {_le('c_custkey * 2', 8)} || '22' || {_str("c_name || '!'")} || '2B' || '0801' || '2C' || '31' || '000000000000F83F'"""


@query(f"SELECT c_custkey, '52' || {_hex(f'length({_KINDS_HEX}) // 2')} || {_KINDS_HEX} AS edited FROM customer")
def edit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of each kind inside a message, each changed along its path."""
    c = table(spark, sf_dir, "customer")
    inner = [E.sint(1, -F.col("c_custkey")), E.fixed32(2, "c_custkey"), E.fixed64(3, "c_custkey"), E.string(4, "c_name"), E.group(5, []), E.fixed64(6, F.lit(0x3FF0000000000000))]
    m = c.select("c_custkey", E.encode_message([E.message(10, inner)]).alias("msg"))
    for number, wire, kind, change in (
        (1, "varint", "sint64", lambda v: v + 5), (2, "i32", "fixed32", lambda v: v + 1), (3, "i64", "sfixed64", lambda v: v * 2), (4, "len", "bytes", lambda v: F.concat(v, F.lit(b"!"))),
        (5, "sgroup", "group", lambda v: F.concat(v, F.lit(b"\x08\x01"))), (6, "i64", "double", lambda v: v * F.lit(1.5)),
    ):
        m = patch.edit_values(m, T.path((10, "len"), (number, wire)), change, ["c_custkey"], kind=kind, groups=True)
    return m.select("c_custkey", F.hex("msg").alias("edited"))


@query(f"""SELECT c_custkey, '08' || {_hex('c_custkey')} || '12' || '026869' || '18' || {_hex(_zig('c_nationkey'))} || '2A' || {_str('c_mktsegment')} || 'CD03' || '07000000' || 'D3030801D403' AS edited FROM customer""")
def patch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload that is set, a set that is cleared, a delete that stands, fixed and group inserts, values of the wrong type."""
    log = patch.Log()
    log.set_bytes([(2, 0)], b"hi")
    log.set([(1, 0)], 99)
    log.clear([(1, 0)])
    log.set([(4, 0)], 1)
    log.delete([(4, 0)])
    log.clear([(4, 0)])
    log.set([(2, 0)], 5)
    log.set_bytes([(3, 0)], b"no")
    log.insert(T.tag(57, "i32"), 7)
    gone = log.insert(T.tag(59, "varint"), 1)
    log.delete(gone)
    log.insert(T.tag(58, "sgroup"), b"\x08\x01")
    try:
        with log.transaction():
            log.delete([(1, 0)])
            raise KeyError
    except KeyError:
        pass
    return M.customers(spark, sf_dir).select("c_custkey", F.hex(patch.edited("msg", log.column())).alias("edited"))


@query(f"""WITH c AS (SELECT c_custkey, {_len('c_custkey')} AS a, octet_length(encode(c_name)) AS n, c_name FROM customer),
r AS (SELECT c_custkey, '' AS parent, 3 AS field_number, 0 AS occurrence, false AS deleted, false AS inserted, false AS edited, true AS child, NULL::BIGINT AS varint, 0 AS start FROM c
UNION ALL SELECT c_custkey, '', 7, 0, false, true, false, false, 42, NULL FROM c UNION ALL SELECT c_custkey, '/3:0', 1, 0, true, false, false, false, c_custkey, 2 FROM c
UNION ALL SELECT c_custkey, '/3:0', 1, 1, false, false, true, false, 8, 3 + a FROM c)
SELECT c_custkey, parent, field_number, occurrence, deleted, inserted, edited, child, varint, start::INTEGER AS start FROM r""")
def edited_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of messages under edits, with deleted and inserted ones, read through the edits."""
    m = table(spark, sf_dir, "customer").select("c_custkey", E.encode_message([E.message(3, [E.varint(1, "c_custkey"), E.varint(1, F.lit(5))])]).alias("msg"))
    log = patch.Log()
    log.delete([(3, 0), (1, 0)])
    log.set([(3, 0), (1, 1)], 8)
    log.insert(T.tag(7, "varint"), 42)
    got = patch.edited_fields(m, _log(m, *log.rows), ["c_custkey"])
    return got.select("c_custkey", "parent", "field_number", "occurrence", "deleted", "inserted", "edited", "child", "varint", F.col("offset").alias("start"))


@query(f"""WITH s AS (SELECT c_custkey, {_len('c_custkey')} AS a, octet_length(encode(c_name)) AS n FROM customer)
SELECT c_custkey, (1 + a)::INTEGER AS start, (2 + a)::INTEGER AS tag_end, (2 + a + {_len('n')})::INTEGER AS payload_start, (2 + a + {_len('n')} + n)::INTEGER AS payload_end FROM s""")
def field_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields.scan(M.customers(spark, sf_dir)).filter("field_number = 2")
    return rows.select("c_custkey", F.col("offset").alias("start"), "tag_end", F.col("value_start").alias("payload_start"), F.col("value_end").alias("payload_end"))


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT l_orderkey AS o_orderkey, (3 + i)::INTEGER AS line, 1 AS depth, 1 AS field_number FROM l""")
def byte_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest field at the third byte of every line item: its own first field."""
    lines = F.filter(fields.cursor("msg", members=["field_number", "value_start"])["fields"], lambda f: f["field_number"] == 10)
    got = M.orders(spark, sf_dir).select("o_orderkey", "msg", F.transform(lines, lambda f: f["value_start"] + 1).alias("at"))
    got = got.select("o_orderkey", F.inline(document.drilldown("msg", "at", [T.tag(10, "len")])))
    return got.select("o_orderkey", F.element_at("path", 1).alias("line"), "depth", "field_number")


@query("""SELECT l_orderkey AS o_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS occurrence,
 '.10' || CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) > 1 THEN ':' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) ELSE '' END || '.2' AS path FROM lineitem""")
def occurrence_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document.with_occurrence(fields.scan(M.orders(spark, sf_dir), members=["ord", "field_number"]), ["o_orderkey"]).filter("field_number = 10")
    step = F.array(F.struct(F.lit(10).alias("number"), F.col("occurrence")), F.struct(F.lit(2).alias("number"), F.lit(0).alias("occurrence")))
    parsed = X.parse_user_path(X.user_path(step))
    return rows.select("o_orderkey", F.element_at(parsed, 1)["occurrence"].alias("occurrence"), X.user_path(step).alias("path"))


@query("""SELECT l_orderkey AS o_orderkey, l_partkey AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem) WHERE i = 2""")
def user_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """.10:1.2 - the part of each order's second line item."""
    return paths.by_user_path(M.orders(spark, sf_dir), [(10, 1), (2, 0)], ["o_orderkey"]).select("o_orderkey", F.col("varint").alias("part"))


# Envelopes and text


#: Event ids of one envelope: a user with more has several, so that none outgrows a task.
ENVELOPE_IDS = 1 << 16


def _framed(events: DataFrame, ids: int = ENVELOPE_IDS) -> DataFrame:
    """All events as frames of their user's envelopes, cut at multiples of ids, and back; idx counts on through a user's envelopes."""
    raw = F.col("props").cast("binary")
    zipped = F.when(F.col("event_id") % 2 == 0, envelope.gzip(raw)).otherwise(raw)
    flags = F.when(F.col("event_id") % 2 == 0, 1).otherwise(0) + F.when(F.col("event_id") % 3 == 0, 2).otherwise(0)
    e = events.withColumn("part", F.floor(F.col("event_id") / ids))
    sizes = e.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("user_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("user_id").alias("u"), F.col("part").alias("k"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    e = e.select("user_id", "part", "event_id", envelope.frame(flags.cast("long"), zipped).alias("f"))
    whole = document.assemble(e, ["user_id", "part"], "f", "event_id")
    whole = whole.join(sizes, F.col("user_id").eqNullSafe(F.col("u")) & F.col("part").eqNullSafe(F.col("k"))).select("user_id", "before", "msg")
    rows = envelope.frame_rows(whole)
    plain = envelope.decompress(F.when(F.col("compressed"), F.col("payload")))
    rows = rows.withColumn("p", plain).withColumn("idx", (F.col("before") + F.col("idx")).cast("int"))
    return rows.select("user_id", "idx", "compressed", "json", F.coalesce("p.payload", "payload").cast("string").alias("props"), "p.format")


@query("""SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS idx, event_id % 2 = 0 AS compressed, event_id % 3 = 0 AS json, props,
 CASE WHEN event_id % 2 = 0 THEN 'gzip' END AS format FROM events""")
def envelope_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of each user in envelopes, every other one compressed, and back."""
    return _framed(table(spark, sf_dir, "events"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'gzip' WHEN 1 THEN 'deflate' WHEN 2 THEN 'deflate-raw' END AS format, props, CASE WHEN event_id % 5 = 0 THEN 'frame 0 has 4 of 5 header bytes' WHEN event_id % 5 = 1 THEN 'frame 1 declares 9 byte(s); 1 are left' END AS error,
 CASE WHEN event_id % 5 > 1 THEN 1 END AS preferred FROM events""")
def envelope_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way of compression is told by its bytes; broken envelopes, and the frame to look at first."""
    raw = F.col("props").cast("binary")
    zipped = F.when(F.col("event_id") % 4 == 0, envelope.compress(raw)).when(F.col("event_id") % 4 == 1, envelope.compress(raw, "deflate")).when(F.col("event_id") % 4 == 2, envelope.compress(raw, "deflate-raw")).otherwise(raw)
    one, two = envelope.frame(F.lit(1), F.lit(b"z")), envelope.frame(F.lit(0), F.lit(b"plain"))
    msg = F.when(F.col("event_id") % 5 == 0, F.lit(bytes(4))).when(F.col("event_id") % 5 == 1, F.concat(one, F.lit(b"\x00\x00\x00\x00\x09\xff"))).otherwise(F.concat(one, two))
    got = table(spark, sf_dir, "events").select("event_id", "props", envelope.decompress(zipped).alias("p"), envelope.frames(msg).alias("e"))
    ranked = F.transform("e.frames", lambda f: F.struct(envelope.is_compressed(f["flags"]).alias("zipped"), envelope.is_json(f["flags"]).alias("json"), f["idx"].alias("idx")))
    return got.select("event_id", F.col("p.format").alias("format"), F.col("p.payload").cast("string").alias("props"), F.col("e.error").alias("error"), F.array_min(ranked)["idx"].alias("preferred"))


@query(r"""WITH b AS (SELECT p_partkey, p_name, hex(encode(p_name)) AS h, encode(p_name) AS b FROM part)
SELECT p_partkey, p_name AS from_hex, p_name AS from_base64, p_name AS from_url, trim(regexp_replace(h, '(..)', '\1 ', 'g')) AS spaced, '[' || regexp_replace(regexp_replace(h, '(..)', '0x\1, ', 'g'), ', $', '') || ']' AS brackets,
 '{ ' || regexp_replace(regexp_replace(h, '(..)', '0x\1, ', 'g'), ', $', '') || ' }' AS c_array, regexp_replace(h, '(..)', chr(92) || chr(92) || 'x\1', 'g') AS c_escape,
 rtrim(translate(base64(b), '+/', '-_'), '=') AS url, octet_length(b) || 'B "' || CASE WHEN length(p_name) > 32 THEN p_name[:32] || '…' ELSE p_name END || '"' AS summary FROM b""")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = F.col("p_name").cast("binary")
    return p.select(
        "p_partkey", X.from_text(F.concat(F.lit("0x "), X.hex_spaced(b))).cast("string").alias("from_hex"), X.from_text(F.base64(b)).cast("string").alias("from_base64"), X.from_text(X.url_base64(b)).cast("string").alias("from_url"),
        X.hex_spaced(b).alias("spaced"), X.bracket_array(b).alias("brackets"), X.c_array(b).alias("c_array"), X.c_escape(b).alias("c_escape"), X.url_base64(b).alias("url"), X.len_summary(b).alias("summary"),
    )


@query("""SELECT doc_id, true AS valid, NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]') AS readable, octet_length(encode(text))::INTEGER AS broken_at, 1 AS error_len, octet_length(encode(text))::INTEGER AS cut_at, NULL::INTEGER AS cut_len FROM documents""")
def utf8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    broken, cut = X.utf8_error(F.concat("b", F.lit(b"\xff!"))), X.utf8_error(F.concat("b", F.lit(b"\xe2\x82")))
    d = d.select("doc_id", F.is_valid_utf8("b").alias("valid"), X.readable("b").alias("readable"), broken.alias("x"), cut.alias("y"))
    return d.select("doc_id", "valid", "readable", F.col("x.valid_up_to").alias("broken_at"), F.col("x.error_len").alias("error_len"), F.col("y.valid_up_to").alias("cut_at"), F.col("y.error_len").alias("cut_len"))


@query("""SELECT doc_id, lang, length(text) AS n FROM documents""")
def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through the wire and back."""
    rows = fields.scan(M.documents(spark, sf_dir), members=["field_number", "bytes"])
    return rows.groupBy("doc_id").agg(F.max(F.when(F.col("field_number") == 3, F.col("bytes").cast("string"))).alias("lang"), F.max(F.when(F.col("field_number") == 2, F.char_length(F.col("bytes").cast("string")))).cast("long").alias("n"))


@query(f"""SELECT p_partkey, 8 * p_size + 1 AS tag, 2 AS tag_used, p_partkey % 2 = 0 AS flag, {_hex('p_partkey')} AS v32, CASE WHEN p_partkey < 0 THEN 1 END AS beyond, '0A' || {_hex('p_partkey')} AS appended, 'p_' || p_partkey || '_3_4' AS frame,
 p_size || ':2:' || p_partkey || '/1:0:4' AS selection, p_partkey AS occurrence, p_partkey::VARCHAR AS number, true AS inside, false AS apart, 3 AS moved, (CASE p_partkey % 3 WHEN 0 THEN 'protobuf' WHEN 1 THEN 'envelope' ELSE 'raw' END) AS kind,
 '00000000  41 42 43                                          |ABC|' AS dump, [p_size::VARCHAR, 'x'] AS lines FROM part""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar helpers, one of each: tags and bools read back, names, selections, spans, kinds of bytes, dumps."""
    from .functions import spans as S

    p = table(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("long"))
    tag = T.decode_tag(F.concat(F.rpad(F.lit(b""), 0, b""), V.varint_encode(F.col("size") * 8 + 1), F.lit(b"\x7f")))
    step = F.array(F.struct(F.col("p_size").alias("number"), F.lit(2).alias("wire_type"), F.col("p_partkey").cast("int").alias("occurrence")), F.struct(F.lit(1).alias("number"), F.lit(0).alias("wire_type"), F.lit(4).alias("occurrence")))
    a, b = S.span(F.lit(0), F.lit(5)), S.span(F.lit(1), F.lit(3))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.lit(b"\x08\x01")).when(F.col("p_partkey") % 3 == 1, F.lit(b"\x00\x00\x00\x00\x00")).otherwise(F.lit(b"\xff"))
    return p.select(
        "p_partkey", tag["tag"].alias("tag"), F.when(tag["tag"] < 128, tag["used"] + 1).otherwise(tag["used"]).alias("tag_used"), V.bool_decode(F.when(F.col("p_partkey") % 2 == 0, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))).alias("flag"),
        F.hex(V.varint_encode("p_partkey", 32)).alias("v32"), V.varint_len(F.col("p_partkey") + (1 << 32), 32).alias("beyond"), F.hex(E.encode_into(F.lit(b"\x0a"), [E.Field(V.varint_encode("p_partkey"), V.varint_len("p_partkey"))])).alias("appended"),
        X.frame_name(F.lit("{source}_{idx1}_{len}"), F.concat(F.lit("p_"), F.col("p_partkey").cast("string")), F.lit(2), F.lit(4)).alias("frame"), X.selection_path(step).alias("selection"), F.element_at(X.parse_selection_path(X.selection_path(step)), 1)["occurrence"].cast("long").alias("occurrence"),
        V.unsigned(X.number(F.concat(F.lit("0x"), F.hex("p_partkey")))).cast("string").alias("number"), S.contains(a, b).alias("inside"), S.intersects(b, S.span(F.lit(3), F.lit(4))).alias("apart"), S.shifted(b, 2)["start"].alias("moved"), envelope.classify(raw, fields.cursor(raw)).alias("kind"),
        X.hex_dump(F.lit(b"ABC")).alias("dump"), catalog.expand_paths(F.concat(F.lit("x\n "), F.col("p_size").cast("string"), F.lit(" \n\nx"))).alias("lines"),
    )


# The catalog


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = M.customers(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
    m = m.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("class_id"), F.col("c_name").alias("name"), (F.col("c_custkey") * 10).alias("modified_ms"), "msg")
    return m, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("class_name"))


@query(f"""SELECT c_custkey AS id, c_nationkey AS class_id, c_name AS name, c_custkey * 10 AS modified_ms, CASE WHEN c_nationkey < 20 THEN n_name ELSE 'default' END AS class_name, (length({_CUSTOMER_HEX}) / 2)::INTEGER AS bytes_len
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, classes = _catalog(spark, sf_dir)
    return catalog.listing(m, classes.filter("class_id < 20"))


@query("SELECT n_nationkey AS class_id, n_name AS class_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 5 <> 0)")
def catalog_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, classes = _catalog(spark, sf_dir)
    left, _ = catalog.delete(m, classes, m.filter("class_id % 5 = 0").select("id"))
    return catalog.orphaned(classes, left)


@query("SELECT c_custkey AS ref_id, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS payload FROM customer")
def frame_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References into stored messages; those to a message that changed since are void."""
    m, _ = _catalog(spark, sf_dir)
    name = fields.scan(m, keep=["id", "modified_ms"]).filter("field_number = 2")
    refs = name.select(F.col("id").alias("ref_id"), F.col("id").alias("source_id"), F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("modified_ms")).cast("long").alias("modified_ms"), F.col("value_start").alias("start"), (F.col("value_end") - F.col("value_start")).alias("size"))
    got = envelope.from_references(refs, m)
    return got.select("ref_id", F.col("payload").cast("string").alias("payload"))


@query("SELECT CASE WHEN c_nationkey < 20 THEN c_nationkey ELSE -1 END::INTEGER AS class_id, c_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' (copy)' END AS name, (CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 ELSE 99 END)::BIGINT AS modified_ms, 1 AS ids FROM customer WHERE c_custkey % 2 = 0 OR c_custkey > 0")
def catalog_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the messages are there; copies of the others are made, of known classes or the default."""
    m, classes = _catalog(spark, sf_dir)
    m = m.withColumn("class_id", F.when(F.col("class_id") < 20, F.col("class_id")).otherwise(-1).cast("int"))
    new = m.filter("id % 2 <> 0").select("class_id", F.concat("name", F.lit(" (copy)")).alias("name"), "msg")
    got = catalog.create(m.filter("id % 2 = 0"), classes.filter("class_id < 20"), new, F.lit(99).cast("long"), default=-1)
    ids = Window.partitionBy("id")
    return got.select("class_id", "name", "modified_ms", F.count(F.lit(1)).over(ids).cast("int").alias("ids"))


@query("SELECT n_nationkey AS class_id, CASE WHEN n_nationkey = 3 THEN 'Three' ELSE n_name END AS class_name FROM nation")
def catalog_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, classes = _catalog(spark, sf_dir)
    return catalog.rename(classes, "class_id", 3, "class_name", "Three")
