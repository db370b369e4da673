"""Half-open spans of bytes, struct<start, end>, and what lies in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .varint import col


def span(start: Column | str | int, end: Column | str | int) -> Column:
    """The span, or null where it would end before it starts."""
    a, b = col(start).cast("int"), col(end).cast("int")
    return F.when((a >= 0) & (a <= b), F.struct(a.alias("start"), b.alias("end")))


def length(s: Column) -> Column:
    return s["end"] - s["start"]


def is_empty(s: Column) -> Column:
    return s["start"] == s["end"]


def shifted(s: Column, by: Column | str | int) -> Column:
    """The span in the coordinates of what it lies in, by bytes further on."""
    return span(s["start"] + col(by), s["end"] + col(by))


def cut(data: Column | str, s: Column) -> Column:
    """The bytes in a span; null where data ends before it."""
    d = col(data)
    return F.when(s["end"] <= F.length(d), F.substring(d, s["start"] + 1, length(s)))


def intersects(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def of_field(f: Column) -> Column:
    """struct<field, tag, prefix, payload> of a decoded field; prefix is null but for delimited ones, payload a scalar's value."""
    prefix = F.when(f["wire_type"] == 2, span(f["tag_end"], f["value_start"]))
    return F.struct(span(f["offset"], f["end"]).alias("field"), span(f["offset"], f["tag_end"]).alias("tag"), prefix.alias("prefix"), span(f["value_start"], f["value_end"]).alias("payload"))
