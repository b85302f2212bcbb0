"""Panel, factors, quality and scoring on small markets."""

import datetime as dt

import numpy as np
import pytest
from conftest import frame, values
from pyspark.sql import functions as F

from tidegauge.operators import factors as fx
from tidegauge.operators import quality as dq
from tidegauge.operators import scoring as sc
from tidegauge.operators.panel import keep_last, prepare_stock_panel
from tidegauge.params import Quality, Windows
from tidegauge.plans.temperature import market_temperature
from tidegauge.schemas import BARS, conform
from tidegauge.sources import tables as tb

DAY = dt.date(2026, 1, 2)
SMALL = "market string, ts_code string, trade_date date, close double, pre_close double, volume double, amount_rmb double, row_seq bigint"


def panel(spark, rows):
    return conform(frame(spark, SMALL, rows), BARS)


def business(n, start=dt.date(2024, 1, 1)):
    days, d = [], start
    while len(days) < n:
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(days=1)
    return days


def test_flat_rows_leave_the_advance_ratio(spark):
    p = panel(spark, [("M", c, DAY, close, 10.0, 1.0, 1.0, 1) for c, close in (("A", 11.0), ("B", 9.0), ("C", 10.0))])
    counts = fx.daily_panel_counts(fx.add_stock_windows(prepare_stock_panel(p)))
    row = fx.add_breadth(counts).collect()[0]
    assert (row.adv_ratio, row.flat_count, row.eligible_count, row.breadth_quality) == (0.5, 1, 3, "VALID")


def test_dedupe_keeps_the_last_of_many_copies(spark):
    """A third of all rows are copies of one key."""
    n = 3000
    df = spark.range(n).select(F.lit("M").alias("market"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("row_seq"), (F.col("id") * 2).alias("v"))
    got = keep_last(df, ["market", "k"])
    assert got.count() == 2 * n // 3 + 1
    assert got.filter("k = 'hot'").collect()[0].v == (n - 3) * 2
    assert "partial_max_by" in got._jdf.queryExecution().toString()


def test_exact_median_without_gathering_groups(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", float(v)) for i, v in enumerate(rng.integers(0, 40, 601))]
    got = {r.k: r.m for r in fx.value_summary(frame(spark, "k string, v double", rows), ["k"], "v", "avg", "n", "m").collect()}
    for k in {r[0] for r in rows}:
        assert got[k] == np.median([v for g, v in rows if g == k])


def test_limit_rate_and_next_day_return(spark):
    d1, d2, d3 = business(3)
    p = panel(spark, [("M", c, d, close, 10.0, 1.0, 1.0, 1) for c, d, close in (("A", d1, 10.0), ("B", d1, 10.0), ("C", d1, 10.0), ("D", d1, 10.0), ("A", d2, 12.0), ("B", d2, 10.0), ("A", d3, 15.0), ("B", d3, 10.0))])
    lim = frame(spark, "market string, ts_code string, trade_date date, is_limit_up boolean, is_limit_down boolean, limit_up_source string, limit_down_source string, limit_up_status string, limit_down_status string, row_seq bigint", [("M", "A", d1, True, False, "pool", "", "REAL_ROWS", "", 1), ("M", "C", d1, True, None, "", "", "", "", 2)])
    prepared = prepare_stock_panel(p)
    flags = fx.prepare_limit_panel(lim)
    counts = fx.daily_panel_counts(fx.add_stock_windows(prepared))
    nxt = fx.limitup_next_summary(fx.limitup_next_returns(prepared, flags))
    out = fx.add_profit_effect(fx.add_breadth(counts), fx.limit_day_counts(flags), nxt).orderBy("trade_date").collect()
    assert out[0].limit_up_rate == 0.5 and out[1].limit_up_rate == 0.0
    assert out[0].yesterday_limitup_mean_return is None
    assert abs(out[1].yesterday_limitup_mean_return - 0.2) < 1e-12 and out[1].yesterday_limitup_sample_count == 1  # C has no next close
    assert out[0].limit_up_source == "pool" and out[1].limit_up_source == "REAL_LIST" and out[1].limit_down_status == "REAL_ZERO"


def test_markets_without_limit_rows_are_unavailable(spark):
    p = panel(spark, [("M", "A", DAY, 11.0, 10.0, 1.0, 1.0, 1)])
    empty = frame(spark, "market string, trade_date date, limit_up_count bigint, limit_down_count bigint, limit_up_source string, limit_down_source string, limit_up_status string, limit_down_status string", [])
    nxt = frame(spark, "market string, trade_date date, yesterday_limitup_mean_return double, yesterday_limitup_sample_count bigint, yesterday_limitup_median_return double", [])
    row = fx.add_profit_effect(fx.add_breadth(fx.daily_panel_counts(fx.add_stock_windows(prepare_stock_panel(p)))), empty, nxt).collect()[0]
    assert row.limit_up_rate is None and row.limit_down_status == "DATA_UNAVAILABLE" and row.profit_effect_quality == "INVALID"


def test_rising_index_has_rsi_100(spark):
    rows = [("M", "I", d, 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i) for i, d in enumerate(business(40))]
    df = fx.add_stretch(frame(spark, "market string, benchmark string, trade_date date, open double, high double, low double, close double", rows))
    rsi = values(df, "rsi14")
    assert rsi[13] is None and rsi[14] == 100.0 and rsi[-1] == 100.0
    flat = fx.add_stretch(frame(spark, "market string, benchmark string, trade_date date, open double, high double, low double, close double", [(*r[:3], 1.0, 1.0, 1.0, 1.0) for r in rows]))
    assert values(flat, "rsi14")[-1] == 50.0 and values(flat, "ma20_atr")[-1] is None


def test_expected_universe_counts_partial_day(spark):
    d1, d2 = business(2)
    rows = [("M", f"{i:03d}", d1, 10.0, 9.0, 100.0, 1e6, 1) for i in range(100)] + [("M", f"{i:03d}", d2, 10.0, 9.0, 100.0, 1e6, 1) for i in range(10)]
    cov = dq.market_coverage_daily(panel(spark, rows), Quality(minimum_universe=50)).orderBy("trade_date").collect()
    assert [(r.observed_universe, r.expected_eligible_count, r.data_quality) for r in cov] == [(100, 100, "VALID"), (10, 100, "INVALID")]
    assert cov[1].warnings == "MARKET_COVERAGE_BELOW_MINIMUM_0.100"


@pytest.mark.parametrize("seed", [0, 1])
def test_expected_universe_sweep_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    days = business(30)
    rows, meta = [], {}
    for i in range(40):
        listed = days[rng.integers(0, 30)] if rng.random() < 0.7 else None
        gone = days[rng.integers(0, 30)] if rng.random() < 0.3 else None
        seen = sorted(rng.choice(30, size=rng.integers(1, 20), replace=False))
        meta[f"c{i}"] = (listed, gone, days[seen[0]])
        rows += [("M", f"c{i}", days[j], listed, gone, None) for j in seen]
    df = frame(spark, "market string, ts_code string, trade_date date, list_date date, delist_date date, universe_count int", rows)
    got = {r.trade_date: r.expected_eligible_count for r in dq.expected_universe_daily(df).collect()}
    for d in sorted({r[2] for r in rows}):
        seen = [m for m in meta.values() if m[2] <= d]
        listed = sum((m[0] is None or m[0] <= d) and (m[1] is None or m[1] >= d) for m in seen)
        known = any(m[0] or m[1] for m in seen)
        assert got[d] == (listed if listed > 0 and known else len(seen))


def test_integrity_gate_collapse_and_mismatch(spark):
    d1, d2 = business(2)
    ddl = "market string, trade_date date, expected_eligible_count bigint, observed_universe bigint, market_coverage_ratio double, eligible_count bigint, observed_eligible_count bigint, valid_amount_count bigint, data_quality_warnings string, adv_ratio double"
    df = frame(spark, ddl, [("M", d1, 100, 100, 1.0, 100, 100, 100, "", 0.5), ("M", d2, 100, 10, 0.1, 10, 10, 10, "", 1.5)])
    bad = dq.add_integrity_gate(df, Quality(minimum_universe=50, production=True)).orderBy("trade_date").collect()
    assert bad[0].integrity_warnings == "" and bad[0].production_gate == "PASS"
    assert bad[1].integrity_warnings.split(";") == [
        "MARKET_COVERAGE_BELOW_MINIMUM", "MARKET_COVERAGE_COLLAPSE", "CROSS_MODULE_UNIVERSE_MISMATCH_eligible_count", "CROSS_MODULE_UNIVERSE_MISMATCH_observed_eligible_count", "CROSS_MODULE_UNIVERSE_MISMATCH_valid_amount_count", "IMPOSSIBLE_RATIO",
    ]


def test_weights_renormalise_over_present_scores(spark):
    df = sc.add_composite(frame(spark, "a double, b double, c double", [(80.0, None, 20.0), (None, None, None), (None, None, 30.0)]), {"a": 0.5, "b": 0.3, "c": 0.0}, "score")
    rows = df.collect()
    assert [r.score for r in rows] == [80.0, None, None]
    assert rows[0].score_missing_factors == "b" and rows[0].score_effective_weights == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_validation_issues_and_gates(spark):
    rows = [("M", "A", DAY, 0.0, 1.0, -1.0, 1.0, 1), ("M", "A", DAY, 5.0, 1.0, 1.0, 1.0, 2)]
    issues = dq.validate_timeseries(panel(spark, rows).select("market", "ts_code", "trade_date", "close", "volume"))
    assert {(r.code, r.rows) for r in issues.collect()} >= {("DUPLICATE_DATES", 1), ("IMPOSSIBLE_PRICES", 1), ("NEGATIVE_VOLUME", 1)}
    with pytest.raises(dq.DataValidationError):
        dq.validate_strict(issues)
    p = panel(spark, [("M", "A", DAY, 11.0, 10.0, 1.0, 1.0, 1)])
    assessed = dq.assess_market_coverage(dq.market_coverage_daily(p), p)
    with pytest.raises(dq.InsufficientMarketCoverage):
        dq.production_gate(assessed)
    dq.production_gate(assessed, allow_partial=True)
    with pytest.raises(dq.UnavailableMarketFactor):
        dq.approximate_gate(frame(spark, "market string, limit_method string", [("M", "board_band_APPROXIMATION")]))


def test_conform_turns_nan_into_null(spark):
    row = conform(frame(spark, "market string, ts_code string, trade_date string, close double, list_date string", [("M", "A", "20260102", float("nan"), "2020/01/05")]), BARS).collect()[0]
    assert row.close is None and row.trade_date == DAY and row.list_date == dt.date(2020, 1, 5) and row.universe_count is None


def test_temperature_is_causal_and_market_independent(spark):
    """Two markets at once equal each alone; a prefix run equals the full run on the prefix."""
    rng = np.random.default_rng(7)
    days = business(60)
    rows, idx = [], []
    for m in ("M", "N"):
        price = {c: 50.0 for c in "ABCD"}
        for i, d in enumerate(days):
            for c in "ABCD":
                pre, price[c] = price[c], float(max(5, price[c] + rng.integers(-5, 6)))
                rows.append((m, c, d, price[c], pre, 100.0 + float(rng.integers(0, 50)), 1e4 * float(rng.integers(1, 50)), 1))
            idx.append((m, "I", d, *[float(x) for x in (100 + i, 103 + i + rng.integers(0, 3), 97 + i, 100 + i + rng.integers(-2, 3))]))
    windows, quality = Windows(ma_short=3, ma_long=5, high_low=5, turnover_z=5, rsi=3, atr=3, index_ma=3, short_return=2, long_return=4), Quality(minimum_universe=1, minimum_coverage=0.5)
    from tidegauge.params import Percentile

    def run(panel_rows, index_rows):
        p = panel(spark, panel_rows)
        move = F.col("close") / F.col("pre_close") - 1
        lim = p.select("market", "ts_code", "trade_date", (move > 0.05).alias("is_limit_up"), (move < -0.05).alias("is_limit_down"), F.lit("m").alias("limit_method"), F.lit("s").alias("limit_up_source"), F.lit("s").alias("limit_down_source"), F.lit("REAL_ROWS").alias("limit_up_status"), F.lit("REAL_ROWS").alias("limit_down_status"), "row_seq").filter("is_limit_up or is_limit_down")
        ib = frame(spark, "market string, benchmark string, trade_date date, open double, high double, low double, close double", index_rows)
        out = market_temperature(p, lim, ib, windows, quality, Percentile(20, 5)).select("market", "trade_date", F.round("raw_market_temperature", 9).alias("t"), "market_temperature_quality")
        return {(r.market, r.trade_date): (r.t, r.market_temperature_quality) for r in out.collect()}

    both = run(rows, idx)
    assert any(v[0] is not None for v in both.values())
    alone = run([r for r in rows if r[0] == "M"], [r for r in idx if r[0] == "M"])
    assert alone == {k: v for k, v in both.items() if k[0] == "M"}
    cut = days[45]
    prefix = run([r for r in rows if r[2] < cut], [r for r in idx if r[2] < cut])
    assert prefix == {k: v for k, v in both.items() if k[1] < cut}


def test_upsert_new_rows_win(spark):
    ddl = "ts_code string, trade_date date, close double, row_seq bigint"
    old = frame(spark, ddl, [("A", DAY, 10.0, 5)])
    new = frame(spark, ddl, [("A", DAY, 11.0, 1), ("A", dt.date(2026, 1, 5), 12.0, 1)])
    got = tb.upsert(old, new, ["ts_code", "trade_date"]).orderBy("trade_date").collect()
    assert [r.close for r in got] == [11.0, 12.0]


def test_production_run_carries_the_assessment(spark):
    from tidegauge.params import Percentile

    days = business(12)
    rows = [("M", c, d, 10.0 + (i + k) % 3, 10.0, 100.0, 1e6, 1) for i, d in enumerate(days) for k, c in enumerate("ABCD")]
    p = panel(spark, rows)
    lim = frame(spark, "market string, ts_code string, trade_date date, is_limit_up boolean, is_limit_down boolean, limit_method string, limit_up_source string, limit_down_source string, limit_up_status string, limit_down_status string, row_seq bigint", [("M", "A", days[3], True, False, "list", "", "", "", "", 1)])
    ib = frame(spark, "market string, benchmark string, trade_date date, open double, high double, low double, close double", [("M", "I", d, 10.0, 11.0, 9.0, 10.0 + i % 2) for i, d in enumerate(days)])
    out = market_temperature(p, lim, ib, Windows(3, 5, 5, 5, 3, 3, 3, 2, 4), Quality(minimum_universe=5, production=True), Percentile(10, 3)).orderBy("trade_date").collect()
    assert len(out) == 12 and all(r.production_gate == "INVALID" and r.raw_market_temperature is None for r in out)
    for code in ("HISTORICAL_LIST_DATE_INCOMPLETE", "EXPECTED_UNIVERSE_BELOW_MINIMUM_4", "SURVIVORSHIP_BIAS_WARNING", "PARTIAL_STOCK_PANEL_SYMBOLS_4"):
        assert code in out[-1].data_quality_warnings.split(";")


def test_profile_reads_the_panel_once_and_counts_every_row(spark):
    """Null days and codes, a declared universe, repeated rows, and metadata that comes late."""
    rows = [
        ("M", "a", dt.date(2024, 1, 2), None, None, None, None), ("M", "a", dt.date(2024, 1, 3), dt.date(2024, 1, 1), None, 0, 7), ("M", "a", dt.date(2024, 1, 3), dt.date(2024, 1, 1), None, 0, 7),
        ("M", "b", None, dt.date(2023, 1, 1), dt.date(2024, 1, 2), 1, 9), ("M", None, dt.date(2024, 1, 4), None, None, None, 50), (None, "z", dt.date(2024, 1, 2), None, None, None, 4),
    ]
    df = frame(spark, "market string, ts_code string, trade_date date, list_date date, delist_date date, is_st int, universe_count int", rows)
    profile = dq.panel_profile(df)
    securities = profile.filter("is_day = 0").groupBy("market").agg(F.count("*").alias("n"), F.sum("listed_rows").alias("l"), F.sum("delisted_rows").alias("d"), F.sum("st_rows").alias("s")).collect()
    assert {r.market: (r.n, r.l, r.d, r.s) for r in securities} == {"M": (3, 3, 1, 3), None: (1, 0, 0, 0)}
    expected = {(r.market, r.trade_date): (r.expected_eligible_count, r.expected_universe_source) for r in dq.expected_from_profile(profile).collect()}
    assert expected == {
        ("M", dt.date(2024, 1, 2)): (1, "point_in_time_listing_metadata"), ("M", dt.date(2024, 1, 3)): (1, "point_in_time_listing_metadata"),
        (None, dt.date(2024, 1, 2)): (4, "declared_universe_count"),
    }
    plan = dq.expected_universe_daily(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") == 1
    assert dq.panel_profile(df.limit(0)).count() == 0
