"""The registered queries: their SQL on the smallest tables, and the folds and columns of their contracts."""

import zlib
from pathlib import Path

import duckdb
import pytest

from tests.test_entry import DATA, TABLES, rows
from wireloom.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA), db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def in_fold(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


@pytest.mark.parametrize(("name", "columns"), [("op1_toxicity", ["doc_id", "held_out", "score", "predicted"]), ("op3_language_id", ["doc_id", "held_out", "lang_pred", "score"])])
def test_held_out_folds(spark, db, name, columns):
    got = QUERIES[name](spark, DATA)
    assert got.columns[:4] == columns
    out = got.collect()
    assert sorted(r.doc_id for r in out) == sorted(x for (x,) in db.sql("select doc_id from documents").fetchall())
    assert all(r.held_out == in_fold(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in out)
    if name == "op1_toxicity":
        assert all(r.predicted == int(r.score >= 0.7) for r in out)


def test_token_counts(spark, db):
    texts = dict(db.sql("select doc_id, octet_length(encode(coalesce(text, ''))) from documents").fetchall())
    got = QUERIES["op6_token_counts"](spark, DATA).collect()
    assert {r.doc_id: r.n_bytes for r in got} == texts and all(r.over_limit == (r.n_tokens > 4096) for r in got)
