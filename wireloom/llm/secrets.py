"""Secret scans by corpus-wide ownership.

All work is DataFrame expressions. Spans come from splitting a text by a
pattern: the pieces between matches and the matches alternate, so running sums
of their lengths are the positions, in code points. Every candidate value is
then counted by distinct repositories and owners over the whole corpus: a value
that many owners hold, or very many repositories, is a copied example; one that
a single owner holds in few repositories and that looks random is live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_hot, keep

#: Kind, pattern, group with the secret, least length of the group.
BASE_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds that the method adds where their value isn't widely copied.
ADDED_KINDS = (
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 26),
    ("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{16,})", 0, 20),
    ("url", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{6,128})@", 1, 6),
)
KINDS = BASE_KINDS + ADDED_KINDS

#: A value held by this many owners, or in this many repositories whoever owns them, is an example that was copied.
COPIED_OWNERS, COPIED_REPOS = 3, 20


def _quoted(pattern: str) -> Column:
    return F.lit(pattern)


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,order,kind,end,value>> of a kind's matches that are long enough."""
    between = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    whole = F.regexp_extract_all(text, _quoted(pattern), F.lit(0))
    value = F.regexp_extract_all(text, _quoted(pattern), F.lit(group)) if group else whole
    joined = F.zip_with(F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda gap, w: F.struct(gap.alias("gap"), w.alias("w"))), value, lambda m, v: F.struct(m["gap"].alias("gap"), F.char_length(m["w"]).alias("len"), v.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (begin + m["len"]).alias("end"), m["v"].alias("value"))
        return F.struct((begin + m["len"]).alias("at"), F.when(F.char_length(m["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(joined, start, step, lambda acc: acc["out"])
    # Most texts have no match; for them the pattern runs once and nothing else does.
    return F.when(text.rlike(pattern), spans).otherwise(start["out"])


def candidates(docs: DataFrame, text_col: str, *kept_cols: Column) -> DataFrame:
    """docs as kept_cols and spans: all kinds' matches by start, then kind as listed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.concat(*[_spans(text, kind, i, *rest) for i, (kind, *rest) in enumerate(KINDS)])
    return docs.select(*kept_cols, F.array_sort(spans).alias("spans"))


def random_looking(value: Column) -> Column:
    """At least 8 distinct characters with a digit and a letter, and no placeholder word."""
    chars = F.size(F.array_distinct(F.split(value, "")))
    return (chars >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~F.lower(value).rlike("example|changeme|your|placeholder|xxxx|1234567")


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, repo, owner) rows to one row per value: n_owners, n_repos, n_found.

    A value found in a third of all rows is cut down before any shuffle: the
    first two steps aggregate on the map side.
    """
    each = found.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = each.groupBy("value_hash", "owner").agg(F.count("repo").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("value_hash").agg(F.count("owner").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row per row of docs: the id, base_spans, spans, n_live, n_copied.

    spans are arrays of (start, ord, kind, end, value, n_owners, n_repos, live).
    Null and empty texts have none. A null repo or owner counts as no one's, so
    such a value isn't called live or copied for it. Repeated rows and null ids
    keep a row each. Other columns are not read.
    """
    rows = candidates(docs, text_col, F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    rows = keep(rows, "spans")
    one = rows.filter(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("s"))
    one = one.withColumn("value_hash", F.xxhash64("s.value"))
    held = ownership(one.select("value_hash", "repo", "owner"))
    one = join_hot(one, held, ["value_hash"], "left")
    base = F.col("s.ord") < len(BASE_KINDS)
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS)
    live = (F.col("n_owners") == 1) & ~copied & random_looking(F.col("s.value"))
    span = F.struct(F.col("s.start").alias("start"), F.col("s.ord").alias("ord"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), F.col("n_owners"), F.col("n_repos"), live.alias("live"))
    by_row = one.filter(base | ~copied).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.count_if(live).alias("n_live"), F.count_if(copied).alias("n_copied"))
    out = rows.select("row", F.col("id").alias(id_col)).join(by_row, "row", "left")
    empty = F.array().cast(by_row.schema["spans"].dataType)
    out = out.withColumn("spans", F.coalesce("spans", empty))
    return out.select(id_col, F.filter("spans", lambda s: s["ord"] < len(BASE_KINDS)).alias("base_spans"), "spans", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
