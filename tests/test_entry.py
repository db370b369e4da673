"""The driver's contract: every wire query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from wireloom import queries as wire

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(round(v[i], 6) if isinstance(v[i], float) else v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(wire.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = wire.QUERIES[name](spark, DATA)
    want = db.sql(wire.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(wire.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_prune_columns_and_decode_once(spark):
    plan = wire.QUERIES["order_totals_from_wire"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "o_totalprice" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan


def test_all_events_are_framed(spark):
    """More events than the first 2,000 ids, and users whose events lie in several envelopes."""
    events = spark.range(6000).selectExpr("id % 7 as user_id", "id as event_id", "concat('{', id, '}') as props")
    for ids in (wire.ENVELOPE_IDS, 500):
        got = {(r.user_id, r.idx): (r.compressed, r.json, r.props, r.format) for r in wire._framed(events, ids).collect()}
        assert got == {(i % 7, i // 7): (i % 2 == 0, i % 3 == 0, f"{{{i}}}", None if i % 2 else "gzip") for i in range(6000)}


def test_registered_envelopes_cover_every_event(spark):
    data = "/root/testdata/sf0.01"
    assert entry.queries()["envelope_frames"](spark, data).count() == spark.read.parquet(f"{data}/events.parquet").count()
