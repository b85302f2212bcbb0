"""Registered queries against their SQL on DuckDB at the smallest scale, and the driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows, same
from tidegauge.registry import REGISTRY

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ("pf1_prepare_stock_panel", "pf7_yesterday_limitup", "dq4_expected_universe", "rg8_state_machine", "ad8_reason_codes", "ev4_forward_outcomes", "in12_security_universe", "in17_parse_quote_text", "st5_infer_limits", "in21_limit_flags_from_pool", "pf16_rsi_flat_tail", "rg19_top_days", "ev11_bootstrap_intervals")


def test_contract():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150
    assert set(REGISTRY) <= set(oracle)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["market", "trade_date", "adv_ratio", "above_ma20_ratio", "above_ma60_ratio", "nhnl_ratio"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    want = rows(rel.fetchall(), names)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert sorted(names) == sorted(df.columns) and len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
