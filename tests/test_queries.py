"""Registered queries against their SQL on the smallest tables. Set TALLYFRAME_ALL=1 to run every query."""

import os

import duckdb
import pytest
from helpers import SF

import __spark_entry__ as entry
from tools.compare import TABLES, normal

SOME = ["facts_current", "restatements", "skip_reasons", "fiscal_period", "interim_derived", "formula_metrics", "cash_roll_forward", "unusual_change", "growth", "quality_gate", "series_summary", "max_drawdown",
        "assumption_ladder", "forecast_base", "forecast_scenarios", "fallback_marks", "lineage_ancestors", "lineage_broken", "sic_classify", "entity_search", "doc_versions", "companyfacts_flatten", "table_cells",
        "statement_view", "stream_current_view", "stream_snapshots"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.catalog.all_queries()) if os.environ.get("TALLYFRAME_ALL") else SOME)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(v) for v in r) for r in df.select(*columns).collect())
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(entry.catalog.all_queries()) == set(entry.catalog.all_oracles())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
