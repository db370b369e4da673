"""The driver's tables as messages: a key column and msg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions.bits import double_bits, float_bits
from ..functions.tags import path
from ..functions.varint import little_endian

#: Tag paths in the messages below.
LINE = path((10, "len"))
LINE_NUMBER, LINE_PART = path((10, "len"), (1, "varint")), path((10, "len"), (2, "varint"))
ORDER_KEY, ORDER_CUSTOMER, ORDER_STATUS = path((1, "varint")), path((2, "varint")), path((3, "len"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, msg {1: key, 2: customer, 3: status}."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", E.encode_message([E.varint(1, "o_orderkey"), E.varint(2, "o_custkey"), E.string(3, "o_orderstatus")]).alias("msg"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, msg {1: key, 2: name, 3: sint nation, 4: sint cents, 5: segment}."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", E.encode_message(customer_fields()).alias("msg"))


def customer_fields() -> list[E.Field]:
    return [E.varint(1, "c_custkey"), E.string(2, "c_name"), E.sint(3, "c_nationkey", 32), E.sint(4, cents("c_acctbal")), E.string(5, "c_mktsegment")]


def line_fields() -> list[E.Field]:
    return [E.varint(1, "l_linenumber"), E.varint(2, "l_partkey"), E.varint(3, "l_suppkey"), E.fixed64(4, double_bits(F.col("l_quantity").cast("double"))), E.string(8, "l_returnflag"), E.string(9, "l_linestatus"), E.fixed32(16, F.col("l_linenumber") * 7)]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, msg {1: key, 2: customer, 3: status, 10: line items by number}."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", E.encode_message(line_fields()).alias("b")).alias("l"))
    lines = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l")).alias("ls"))
    got = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    bodies = F.transform(F.coalesce("ls", F.array().cast(lines.schema["ls"].dataType)), lambda x: x["b"])
    return got.select("o_orderkey", E.encode_message([E.varint(1, "o_orderkey"), E.varint(2, "o_custkey"), E.string(3, "o_orderstatus"), E.repeated_messages(10, bodies)]).alias("msg"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, msg {1: id, 2: packed floats, 3: label}."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    e = e.select("vec_id", "label", "i", little_endian(float_bits(F.col("x").cast("float")), 4).alias("b"))
    e = e.groupBy("vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("xs"))
    body = E.concat_all(F.transform("xs", lambda x: x["b"]))
    return e.select("vec_id", E.encode_message([E.varint(1, "vec_id"), E.binary(2, body), E.varint(3, "label")]).alias("msg"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, msg {1: id, 2: text, 3: lang, 4: source, 5: n_chars}."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", E.encode_message([E.varint(1, "doc_id"), E.string(2, "text"), E.string(3, "lang"), E.string(4, "source"), E.varint(5, "n_chars")]).alias("msg"))
