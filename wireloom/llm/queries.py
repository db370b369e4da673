"""One query per text operator over the driver's tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, line_dedup, lm_scoring, near_dedup, packing, quality_rules, secrets, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    got = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.lit(quality_rules.POLICIES["base"])
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "n_lines", "n_letter_words", "fail_bits",
    )


#: Words of each text as a list, in DuckDB.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RULES_SQL = " + ".join(f"(CASE WHEN {sql} THEN {quality_rules.BITS[rule]} ELSE 0 END)" for rule, sql in quality_rules.RULES.items())
ORACLES["op9_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, {_WORDS} AS ws FROM d),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT r, i, [word, lead(word) OVER p, lead(word, 2) OVER p] AS g, lead(i, 2) OVER p AS whole FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM t WHERE whole IS NOT NULL) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(3) AS x(k) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_words,
  coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(lc.n_lines, 0)::BIGINT AS n_lines, coalesce(lc.dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  len([x for x in ws if regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')])::BIGINT AS n_letter_words
  FROM d JOIN w USING (r) LEFT JOIN lc USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, ({_RULES_SQL})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {quality_rules.POLICIES["base"]}) <> 0 AS base_failed, (fail_bits & {quality_rules.POLICIES["v1"]}) = 0 AS kept,
  n_lines, n_letter_words, fail_bits FROM b
"""


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k piece vocabulary."""
    import public_tokenizers

    counts = token_counts.token_counts(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    got = table(spark, sf_dir, "documents").select("doc_id", counts.alias("c"))
    return got.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > 4096).alias("over_limit"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    got = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


ORACLES["op5_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, ns, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hit), LATERAL (SELECT unnest(range(n)) AS k) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; a document is a repository, its source the owner."""
    got = secrets.scan(table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"), "n_live", "n_copied")


def _fold(n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(0))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a third of the ids is held out of learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.filter(_fold(3) != 1), labels.filter(_fold(3) != 1))
    got = docs.select("doc_id", (_fold(3) == 1).alias("held_out"), toxicity.score(spark, model, F.col("text")).alias("t"))
    return got.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.7).cast("int").alias("predicted"), "t.llr", "t.peak")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the ids is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.filter(_fold(3) != 1))
    got = docs.select("doc_id", (_fold(3) == 1).alias("held_out"), language_id.identify(spark, net, F.col("text")).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document; a seventh of the ids is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    model = lm_scoring.fit(docs.filter(_fold(7) != 2))
    got = docs.select("doc_id", (_fold(7) == 2).alias("held_out"), lm_scoring.score(model, F.col("text")).alias("s"))
    score = F.col("s.score")
    return got.select(
        "doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        F.round("s.base_score", 6).alias("base_score"), F.round(score, 6).alias("score"), F.round(F.pow(F.lit(10.0), -score / F.col("s.n_tokens")), 4).alias("perplexity"),
    )


_D = "CASE WHEN n1 * n2 * n3 * n4 = 0 THEN [0.5, 1.0, 1.5] ELSE [greatest(0, least(1, 1 - 2 * n1 / (n1 + 2 * n2) * n2 / n1)), greatest(0, least(2, 2 - 3 * n1 / (n1 + 2 * n2) * n3 / n2)), greatest(0, least(3, 3 - 4 * n1 / (n1 + 2 * n2) * n4 / n3))] END"


def _tally(c: str) -> str:
    return ", ".join(f"count(*) FILTER ({c} = {i})::DOUBLE AS n{i}" for i in range(1, 5)) + f", count(*) FILTER ({c} > 2)::DOUBLE AS more"


ORACLES["op2_lm_scoring"] = rf"""
WITH RECURSIVE bits AS (SELECT n, n AS c, 0 AS k FROM range(256) AS t(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents),
crc AS (SELECT doc_id, s, 4294967295::BIGINT AS c, 1 AS i FROM ids UNION ALL
  SELECT doc_id, s, xor(c >> 8, t[((xor(c, ascii(s[i])::BIGINT)) & 255) + 1]), i + 1 FROM crc, crc_table WHERE i <= length(s)),
fold AS (SELECT doc_id, xor(c, 4294967295) % 7 = 2 AS held_out FROM crc WHERE i = length(s) + 1),
d AS (SELECT row_number() OVER () AS r, doc_id, held_out,
  list_concat(['<'], [' ' || x for x in regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')], ['>']) AS ws
  FROM documents JOIN fold USING (doc_id)),
b AS (SELECT r, held_out, unnest(ws[:-2]) AS h, unnest(ws[2:]) AS w FROM d),
p AS (SELECT h, w, count(*) AS c FROM b WHERE NOT held_out GROUP BY ALL),
pt AS (SELECT {_tally("c")} FROM p), pd AS (SELECT {_D} AS d FROM pt),
u AS (SELECT w, sum(c) AS c, count(*) AS k FROM p GROUP BY w),
ut AS (SELECT {_tally("k")}, sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v, sum(k)::DOUBLE AS types FROM u), ud AS (SELECT *, {_D} AS d FROM ut),
ctx AS (SELECT h, sum(c)::DOUBLE AS total, (d[1] * count(*) FILTER (c = 1) + d[2] * count(*) FILTER (c = 2) + d[3] * count(*) FILTER (c > 2)) / sum(c) AS rest FROM p, pd GROUP BY h, d),
s AS (SELECT r, coalesce(u.c, 0) AS c, log10((coalesce(u.c, 0) + 1) / (n + v + 1)) AS base,
  log10(CASE WHEN p.c IS NULL THEN 0 ELSE (p.c - pd.d[least(p.c, 3)]) / total END + coalesce(rest, 1) *
    (CASE WHEN k IS NULL THEN 0 ELSE (k - ud.d[least(k, 3)]) / types END + (ud.d[1] * n1 + ud.d[2] * n2 + ud.d[3] * more) / types / (v + 1))) AS lp
  FROM b LEFT JOIN u USING (w) LEFT JOIN p USING (h, w) LEFT JOIN ctx USING (h), pd, ud),
g AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, sum(base) AS base_score, sum(lp) AS score FROM s GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n::BIGINT FROM ut) AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score,
  round(pow(10.0, -score / n_tokens), 4) AS perplexity FROM d JOIN g USING (r)
"""


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are at least 85 % alike."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op7_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON node = doc_id
"""


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lines of every document that repeat, within 2 edits, one that stays elsewhere."""
    got = line_dedup.repeated_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_long", F.size("removed").cast("long").alias("n_removed"), "n_near", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


#: Two lines within 2 edits agree in their first or last 10 characters, or else an edit lies
#: in each of these and what is between agrees, shifted by 1 at most.
ORACLES["op4_line_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS no FROM d),
x AS (SELECT doc_id, no, line FROM o WHERE length(line) >= 32),
u AS (SELECT line, row_number() OVER () AS k, length(line) AS n FROM (SELECT DISTINCT line FROM x)),
m AS (SELECT k, line, n, s, substr(line, 11 + s, n - 20) AS mid FROM u, (SELECT unnest([-1, 0, 1]) AS s)),
c AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON left(a.line, 10) = left(b.line, 10) AND a.k < b.k AND abs(a.n - b.n) <= 2
  UNION SELECT a.k, b.k FROM u a JOIN u b ON right(a.line, 10) = right(b.line, 10) AND a.k < b.k AND abs(a.n - b.n) <= 2
  UNION SELECT least(a.k, b.k), greatest(a.k, b.k) FROM m a JOIN m b ON a.mid = b.mid AND a.k < b.k
  UNION SELECT least(a.k, b.k), greatest(a.k, b.k) FROM m a JOIN (SELECT k, substr(line, 11, n - 21) AS mid FROM u UNION ALL SELECT k, substr(line, 12, n - 21) FROM u
    UNION ALL SELECT k, substr(line, 10, n - 19) FROM u UNION ALL SELECT k, substr(line, 11, n - 19) FROM u) b ON a.mid = b.mid AND a.k <> b.k),
l AS (SELECT a, b FROM c JOIN u p ON p.k = a JOIN u q ON q.k = b WHERE levenshtein(p.line, q.line) <= 2),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT k AS node, k AS root FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
g AS (SELECT node, min(root) AS root FROM r GROUP BY node),
w AS (SELECT doc_id, no, k, root, first_value(k) OVER p AS stays, row_number() OVER p AS rank FROM x JOIN u USING (line) JOIN g ON node = k WINDOW p AS (PARTITION BY root ORDER BY doc_id, no)),
z AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (k <> stays) AS n_near, string_agg(no::VARCHAR, ',' ORDER BY no) AS removed FROM w WHERE rank > 1 GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_long FROM x GROUP BY doc_id)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_long, 0)::BIGINT AS n_long, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(removed, '') AS removed
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN z USING (doc_id)
"""


@query
def op4_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with exact repeats of all lines that aren't blank, however short."""
    got = line_dedup.repeated_lines(table(spark, sf_dir, "documents"), exact_chars=1)
    return got.select("doc_id", "n_lines", "n_long", F.size("removed").cast("long").alias("n_removed"), "n_near", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


def _all_lines(sql: str) -> str:
    """All lines that aren't blank in x and u; edits connect only those of 32 characters and more."""
    lines, rest = sql.split("\nm AS (")
    edits, families = rest.split("\nl AS (")
    lines = lines.replace("length(line) >= 32", r"length(line) >= 32 OR regexp_matches(line, '[^\x20\x09-\x0D]')") + "\nv AS (SELECT * FROM u WHERE n >= 32),"
    return lines + "\nm AS (" + edits.replace("FROM u", "FROM v").replace("JOIN u", "JOIN v") + "\nl AS (" + families


ORACLES["op4_line_dedup_all"] = _all_lines(ORACLES["op4_line_dedup"])


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 512 to 8192 tokens (of the 32k piece vocabulary, and an end) that hold every document."""
    import public_tokenizers

    counts = token_counts.token_counts(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", (counts["n_tokens"] + 1).alias("n_tokens")))


@query
def op9_quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, alone and beside the others, from the ledger."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")


_RULE_ROWS = ", ".join(f"('{rule}', {bit})" for rule, bit in quality_rules.BITS.items() if bit & quality_rules.POLICIES["v1"])
ORACLES["op9_quality_ablation"] = f"""
WITH led AS (SELECT fail_bits & {quality_rules.POLICIES["v1"]} AS failed FROM ({ORACLES["op9_quality_rules"]})),
rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS t(rule, bit))
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_only FROM led, rules GROUP BY rule
"""
