"""Many paths in one walk: matches, errors, typed reads and new values along tag paths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from ..functions.tags import EGROUP, I32, I64, LEN, SGROUP, VARINT
from ..sources.fields import cursor, fresh, fresh_in, slices
from ..sources.walk import MATCH, Tree, rewrite_batch, walk_batch, walked

MAX_NODES, MAX_EDGES, MAX_DEPTH = 65535, 32767, 100
Path = Sequence[int]


def steps(paths: Sequence[Path]) -> list[tuple[int, int, int, bool, bool]]:
    """Rows (node, tag, next, terminal, more) of the tree that the paths form; node 0 is the root."""
    edges: dict[tuple[int, int], int] = {}
    ends: set[int] = set()
    for p in paths:
        if not p:
            raise ValueError("a path has no step")
        if len(p) > MAX_DEPTH:
            raise ValueError(f"a path has over {MAX_DEPTH} steps")
        node = 0
        for t in p:
            node = edges.setdefault((node, t), len(edges) + 1)
        ends.add(node)
    if len(edges) > MAX_EDGES or len(edges) + 1 > MAX_NODES:
        raise ValueError("too many path steps")
    inner = {node for node, _ in edges}
    return [(node, t, to, to in ends, to in inner) for (node, t), to in edges.items()]


def walk(msg: Column | str, paths: Sequence[Path], groups: bool = False, strict: bool = False, members: Sequence[str] | None = None) -> Column:
    """struct<matches, error, at>: what lies at the ends of paths, in the order of the walk, up to the first error.

    members are those of MATCH that are wanted. strict gives no matches of a
    message with an error on the paths, and takes a field that should lead on, but
    isn't a message, as one. A null message gives null.
    """
    tree, wanted = Tree.of(steps(paths)), [f.name for f in MATCH if members is None or f.name in members]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for lo, hi in slices(column):
                yield walk_batch(column.slice(lo, hi - lo), tree, groups, strict, wanted)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, walked(wanted)).asNondeterministic()(F.col(msg) if isinstance(msg, str) else msg)


def _walked(df: DataFrame, paths: Sequence[Path], keys: list[str], msg: str, groups: bool, strict: bool = False, members: Sequence[str] | None = None) -> tuple[DataFrame, Column]:
    name = fresh(df, "_walk")
    return df.select(*keys, walk(msg, paths, groups, strict, members).alias(name)), F.col(name)


def scan_errors(df: DataFrame, keys: list[str], paths: Sequence[Path] = (), msg: str = "msg", groups: bool = False) -> DataFrame:
    """keys, error and at (where the bad unit starts) of messages whose walk fails; the first error only.

    Inside a payload, a unit that its end cuts off is Malformed at the unit's start.
    """
    got, w = _walked(df, paths, keys, msg, groups, members=["depth"])
    return got.filter(w["error"].isNotNull()).select(*keys, w["error"].alias("error"), w["at"].alias("at"))


def well_formed(df: DataFrame, keys: list[str], msg: str = "msg", groups: bool = False) -> DataFrame:
    """keys and ok: whether the top level is well framed; payloads aren't looked into."""
    return df.select(*keys, cursor(msg, groups, ["ord"])["error"].isNull().alias("ok"))


def scan_paths(df: DataFrame, paths: Sequence[Path], keys: list[str], msg: str = "msg", groups: bool = False, strict: bool = False, members: Sequence[str] | None = None) -> DataFrame:
    """One row per match: keys and the members of MATCH (all, unless some are named).

    Ordered by (end, depth descending), rows come as the walk meets them: a
    payload that is itself wanted comes after what was found in it. Where a
    walk fails, only what it met before the error is given. Null and repeated
    keys are as good as others. A member that keys have gets underscores.
    """
    got, w = _walked(df, paths, keys, msg, groups, strict, members)
    names = [f.name for f in MATCH if members is None or f.name in members]
    return got.select(*keys, F.inline(w["matches"]).alias(*(fresh_in(keys, n) for n in names)))


def extract(df: DataFrame, path: Path, keys: list[str], msg: str = "msg", groups: bool = False, strict: bool = False, members: Sequence[str] | None = None) -> DataFrame:
    """The matches of one path."""
    return scan_paths(df, [path], keys, msg, groups, strict, members)


#: Kinds that a value can be read and set as: wire type, the member of MATCH it is in, and the SQL type.
KINDS = {
    **{k: (VARINT, "varint", "long") for k in ("uint64", "int64", "uint32", "int32", "sint64", "sint32", "bool")}, "fixed32": (I32, "fixed32", "long"), "sfixed32": (I32, "fixed32", "long"), "float": (I32, "real", "double"),
    "fixed64": (I64, "fixed64", "long"), "sfixed64": (I64, "fixed64", "long"), "double": (I64, "real", "double"), "bytes": (LEN, "payload", "binary"), "group": (SGROUP, "payload", "binary"),
}


def _typed(kind: str, bits: Column) -> Column:
    from ..functions.varint import low32, zigzag_decode

    read = {"uint32": lambda v: low32(v), "int32": lambda v: low32(v, True).cast("long"), "sfixed32": lambda v: low32(v, True).cast("long"), "sint64": zigzag_decode, "sint32": lambda v: zigzag_decode(low32(v), 32).cast("int").cast("long"), "bool": lambda v: (v != 0).cast("long")}
    return read.get(kind, lambda v: v)(bits)


def _bits(kind: str, value: Column) -> Column:
    from ..functions.varint import low32, zigzag_encode

    write = {"uint32": lambda v: low32(v), "sint64": zigzag_encode, "sint32": lambda v: zigzag_encode(v, 32), "bool": lambda v: (v.cast("boolean")).cast("long")}
    out = write.get(kind, lambda v: v)(value)
    return out.cast(KINDS[kind][2])


def values_at(msg: Column | str, path: Path, kind: str, strict: bool = False, groups: bool = False) -> Column:
    """The values at the end of a path as an array, read as a kind; null (strict) where a message on the path is bad.

    Groups are read if groups says so or the path has one. int32 and sfixed32 come with their sign, bool as 0 or 1, bytes and group as their payloads.
    """
    wire, member, _ = KINDS[kind]
    if path[-1] & 7 != wire:
        raise ValueError(f"{kind} isn't read from wire type {path[-1] & 7}")
    w = walk(msg, [path], groups or any(t & 7 == SGROUP for t in path), strict, [member])
    out = F.transform(w["matches"], lambda m: _typed(kind, m[member]))
    return F.when(w["error"].isNull(), out) if strict else out


def with_values(msg: Column | str, path: Path, kind: str, values: Column, groups: bool = False) -> Column:
    """msg with the values at the end of a path replaced, by an array in the order of values_at.

    Every message on the path is encoded anew: its tags become canonical, and the
    length prefixes on the path; other fields stay as they are. A message that
    doesn't decode on the path stays as it is.
    """
    wire, _, sql = KINDS[kind]
    if path[-1] & 7 != wire:
        raise ValueError(f"{kind} can't be set on wire type {path[-1] & 7}")
    groups, tags = groups or any(t & 7 == SGROUP for t in path), list(path)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, new in batches:
            for lo, hi in slices(column):
                yield rewrite_batch(column.slice(lo, hi - lo), new.slice(lo, hi - lo), tags, groups)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    new = F.transform(values, lambda v: _bits(kind, v)).cast(f"array<{sql}>")
    return F.arrow_udf(run, P.BinaryType()).asNondeterministic()(F.col(msg) if isinstance(msg, str) else msg, new)


def by_user_path(df: DataFrame, steps: Sequence[tuple[int, int]], keys: list[str], msg: str = "msg", groups: bool = False) -> DataFrame:
    """The field at a path of (number, occurrence) steps in each message, with its columns and root_base.

    Occurrences are counted over all wire types. A payload on the way that is no
    message but reads as hex or base64 of one is read so; root_base is null
    below it. Messages without such a field give no row. Null and repeated keys
    are as good as others: a field is picked inside its own message.
    """
    from ..functions.text import from_text

    if not steps:
        raise ValueError("a path has no step")
    body, base = fresh(df, "_body"), fresh(df, "root_base")
    rows = df.select(*keys, F.lit(0).alias(base), F.col(msg).alias(body))
    for i, (number, occurrence) in enumerate(steps):
        d = fresh(rows, "_decoded")
        got = rows.select(*keys, base, cursor(body, groups).alias(d)).filter(F.col(d)["error"].isNull())
        mine = F.get(F.filter(F.col(d)["fields"], lambda f: f["field_number"] == number), F.lit(occurrence))
        fields = got.select(*keys, base, mine.alias(d)).filter(F.col(d).isNotNull())
        if i + 1 == len(steps):
            return fields.select(*keys, base, f"{d}.*")
        f = F.col(d)
        inner = fields.filter(f["wire_type"].isin(LEN, SGROUP)).select(*keys, (F.col(base) + f["value_start"]).alias(base), f["bytes"].alias(body))
        inner = inner.withColumn(ok := fresh(inner, "_ok"), cursor(body, groups, ["ord"])["error"].isNull())
        text = F.when(F.is_valid_utf8(body), from_text(F.col(body).cast("string")))
        rows = inner.select(*keys, F.when(F.col(ok), F.col(base)).alias(base), F.when(F.col(ok), F.col(body)).otherwise(F.coalesce(text, body)).alias(body))
    raise AssertionError


def end_tag(number: int) -> int:
    return number << 3 | EGROUP
