"""Queries that derive several tables from the order lines compute the bars once."""

from __future__ import annotations

import re

import pytest

from tidegauge.registry import REGISTRY, ingest
from tidegauge.sources import testdata as td
from tidegauge.sources.snapshots import SnapshotTable

SF = "/root/testdata/sf0.001"


def line_scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")


def test_upsert_batches_are_cut_from_stored_bars(spark):
    assert [line_scans(df) for df in ingest.batches(spark, SF)] == [0, 0]


def test_a_market_delivered_again_is_read_from_the_stored_table(spark, monkeypatch):
    seen, own = [], SnapshotTable.replace_where
    monkeypatch.setattr(SnapshotTable, "replace_where", lambda self, df, *rest: (seen.append(line_scans(df)), own(self, df, *rest))[1])
    REGISTRY["in2_save_dataset"].build(spark, SF)
    assert seen == [0]


def test_revisions_and_bars_come_of_one_computation(spark):
    rows = td.bars_with_revisions(spark, SF)
    assert line_scans(rows) == 1
    bars = td.bars(spark, SF)
    want = bars.unionByName(bars.filter("sk % 4 = 0").selectExpr("* EXCEPT (close, row_seq)", "open AS close", "0L AS row_seq"))
    assert rows.exceptAll(want).count() == want.exceptAll(rows.select(want.columns)).count() == 0


@pytest.mark.parametrize("name", ["ev18_parameter_robustness", "ev19_readiness_gate", "ev19_readiness_all_sets", "ev22_multiple_testing_tally", "ev21_case_study_slice", "sv6_diagnostics"])
def test_bars_are_computed_once(spark, monkeypatch, name):
    made, own = [], td.raw_bars
    monkeypatch.setattr(td, "raw_bars", lambda *args: (made.append(name), own(*args))[1])
    REGISTRY[name].build(spark, SF)
    assert len(made) == 1


def test_lines_reach_their_bar_in_one_narrow_shuffle(spark):
    """Merging lines into bars starts behind the shuffle by security and week, not before it."""
    plan = td.raw_bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min_by") < re.search(r"hashpartitioning\(sk#\w+, trade_date", plan).start()
