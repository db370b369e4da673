"""Bytes as text and back: imports, copy formats, previews, paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .varint import col


def from_text(text: Column | str) -> Column:
    """Bytes typed as hex (0x may lead, white space anywhere) or else base64, standard or URL-safe; null if neither."""
    t = F.regexp_replace(col(text), r"\s", "")
    t = F.when(t.rlike("^0[xX]"), F.substring(t, 3, 1 << 30)).otherwise(t)
    standard = F.translate(t, "-_", "+/")
    bare = F.regexp_replace(standard, "=+$", "")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    one_kind = t.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(t) % 4 == 0) | t.rlike("^[A-Za-z0-9_-]*={0,2}$") & ((F.length(t) % 4 == 0) | ~t.contains("="))
    hexed = F.when(t.rlike("^([0-9A-Fa-f]{2})+$"), F.try_to_binary(t, F.lit("hex")))
    return F.when(F.length(t) == 0, None).otherwise(F.coalesce(hexed, F.when(one_kind & (F.length(bare) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))))


def url_base64(b: Column | str) -> Column:
    """URL-safe base64 without padding, as in a share link."""
    return F.rtrim(F.translate(F.base64(col(b)), "+/\r\n", "-_"), F.lit("="))


def _pairs(b: Column, each: str) -> Column:
    return F.regexp_replace(F.hex(b), "(..)", each)


def hex_spaced(b: Column | str) -> Column:
    return F.rtrim(_pairs(col(b), "$1 "))


def hex_compact(b: Column | str) -> Column:
    return F.hex(col(b))


def c_array(b: Column | str) -> Column:
    """{ 0x00, 0xFF }"""
    b = col(b)
    return F.when(F.length(b) == 0, "{ }").otherwise(F.concat(F.lit("{ "), F.regexp_replace(_pairs(b, "0x$1, "), ", $", ""), F.lit(" }")))


def c_escape(b: Column | str) -> Column:
    return _pairs(col(b), r"\\x$1")


def bracket_array(b: Column | str) -> Column:
    """[0x4A, 0x6F]"""
    return F.concat(F.lit("["), F.regexp_replace(_pairs(col(b), "0x$1, "), ", $", ""), F.lit("]"))


def hex_dump(b: Column | str) -> Column:
    """Lines of 16 bytes: offset, hex in two halves, printable characters."""
    b = col(b)

    def line(i: Column) -> Column:
        part = F.substring(b, i * 16 + 1, F.lit(16))
        codes = F.hex(part)
        halves = F.concat(F.regexp_replace(F.substring(codes, 1, 16), "(..)", "$1 "), F.lit(" "), F.regexp_replace(F.substring(codes, 17, 16), "(..)", "$1 "))
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^ -~]", ".")
        return F.concat(F.lpad(F.hex(i * 16), 8, "0"), F.lit("  "), F.rpad(halves, 49, " "), F.lit(" |"), shown, F.lit("|"))

    rows = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(b) / 16).cast("int") - 1, F.lit(0)))
    return F.when(F.length(b) == 0, "").otherwise(F.array_join(F.transform(rows, line), "\n"))


@F.arrow_udf(T.StructType([T.StructField("valid_up_to", T.IntegerType()), T.StructField("error_len", T.IntegerType())]))
def _utf8_error(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        out = []
        for b in column:
            raw = b.as_py()
            got = None
            try:
                _ = raw is None or raw.decode()
            except UnicodeDecodeError as e:
                got = {"valid_up_to": e.start, "error_len": None if e.reason == "unexpected end of data" else e.end - e.start}
            out.append(got)
        yield pa.array(out, pa.struct([("valid_up_to", pa.int32()), ("error_len", pa.int32())]))


def utf8_error(b: Column | str) -> Column:
    """struct<valid_up_to, error_len> of bytes that aren't UTF-8, else null; error_len is null at an unexpected end.

    Valid bytes stay in the JVM.
    """
    b = col(b)
    return _utf8_error(F.when(~F.is_valid_utf8(b), b))


def readable(b: Column | str) -> Column:
    """Valid UTF-8 without control characters but \\n, \\r and \\t."""
    b = col(b)
    return F.is_valid_utf8(b) & ~F.when(F.is_valid_utf8(b), b.cast("string")).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")


def printable_ascii(b: Column | str) -> Column:
    return F.hex(col(b)).rlike("^([2-6][0-9A-F]|7[0-9A-E])*$")


def cut_text(text: Column | str, most: int) -> Column:
    """At most that many characters, with an ellipsis for the rest."""
    t = col(text)
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def len_summary(b: Column | str, most: int = 32) -> Column:
    """Size and, of printable bytes, a preview: 5B "hello"."""
    b = col(b)
    size = F.concat(F.length(b).cast("string"), F.lit("B"))
    return F.when((F.length(b) > 0) & printable_ascii(b), F.concat(size, F.lit(' "'), cut_text(F.decode(b, "US-ASCII"), most), F.lit('"'))).otherwise(size)


def number(text: Column | str) -> Column:
    """A decimal or 0x number as the bits of a long; null if it is none or over 64 bits."""
    t = F.trim(col(text))
    h, d = F.regexp_extract(t, "^0[xX]([0-9A-Fa-f]{1,16})$", 1), F.regexp_extract(t, "^([0-9]{1,20})$", 1)
    big = F.when(d != "", d).cast("decimal(38,0)")
    return F.when(h != "", F.conv(h, 16, -10).cast("long")).when(big < F.lit(str(1 << 64)).cast("decimal(38,0)"), F.conv(F.conv(d, 10, 16), 16, -10).cast("long"))


def frame_name(template: Column | str, source: Column | str, index: Column | str, size: Column | str) -> Column:
    """A template with {source}, {idx} (from 0), {idx1} (from 1) and {len}."""
    t, i = col(template), col(index)
    for name, value in (("{source}", col(source)), ("{idx1}", (i + 1).cast("string")), ("{idx}", i.cast("string")), ("{len}", col(size).cast("string"))):
        t = F.replace(t, F.lit(name), value)
    return t


def user_path(steps: Column | str) -> Column:
    """[(3, 0), (1, 2)] as .3.1:2: field numbers, and occurrences other than the first."""
    one = F.transform(col(steps), lambda s: F.concat(F.lit("."), s["number"].cast("string"), F.when(s["occurrence"] > 0, F.concat(F.lit(":"), s["occurrence"].cast("string"))).otherwise("")))
    return F.array_join(one, "")


def parse_user_path(text: Column | str) -> Column:
    """.3.1:2 as an array of struct<number, occurrence>; null if it is no path."""
    t = F.regexp_replace(F.trim(col(text)), r"^\.", "")
    steps = F.transform(F.split(t, r"\."), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(1)).cast("int").alias("number"), F.coalesce(F.nullif(F.split_part(s, F.lit(":"), F.lit(2)), F.lit("")).cast("int"), F.lit(0)).alias("occurrence")))
    return F.when(t.rlike(r"^[1-9][0-9]{0,8}(:[0-9]{1,9})?(\.[1-9][0-9]{0,8}(:[0-9]{1,9})?)*$"), steps)


def selection_path(steps: Column | str) -> Column:
    """[(3, 2, 0), (1, 0, 4)] as 3:2:0/1:0:4: number, wire type and occurrence of that tag."""
    return F.array_join(F.transform(col(steps), lambda s: F.concat_ws(":", s["number"].cast("string"), s["wire_type"].cast("string"), s["occurrence"].cast("string"))), "/")


def parse_selection_path(text: Column | str) -> Column:
    """3:2:0/1:0:4 as an array of struct<number, wire_type, occurrence>; null if it is no such path."""
    t = col(text)

    def step(s: Column) -> Column:
        part = F.transform(F.split(s, ":"), lambda x: x.cast("int"))
        return F.struct(F.get(part, F.lit(0)).alias("number"), F.get(part, F.lit(1)).alias("wire_type"), F.get(part, F.lit(2)).alias("occurrence"))

    return F.when(t.rlike(r"^[1-9][0-9]{0,8}:[0-5]:[0-9]{1,9}(/[1-9][0-9]{0,8}:[0-5]:[0-9]{1,9})*$"), F.transform(F.split(t, "/"), step))


def byte_cells(b: Column | str) -> Column:
    """An array of struct<place, hex, ascii>, a cell for each byte; other than printable bytes show as a dot."""
    b = col(b)

    def cell(i: Column) -> Column:
        one = F.substring(b, i + 1, F.lit(1))
        shown = F.when(printable_ascii(one), F.decode(one, "US-ASCII")).otherwise(".")
        return F.struct(i.alias("place"), F.hex(one).alias("hex"), shown.alias("ascii"))

    return F.when(F.length(b) > 0, F.transform(F.sequence(F.lit(0), F.length(b) - 1), cell)).when(F.length(b) == 0, F.array().cast("array<struct<place:int,hex:string,ascii:string>>"))
