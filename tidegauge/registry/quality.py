"""Validation and data-quality queries (DQ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as dq
from ..operators.panel import valid_price
from ..params import Quality
from ..plans.temperature import market_temperature
from ..sources import testdata as td
from .base import cte, register
from .factors import KEYS, W, panel

Q = td.QUALITY

# The validation input damages some bars on purpose: duplicated rows, zero closes, swapped ranges.
cte("dirty", """
SELECT market, ts_code, CASE WHEN sk % 29 = 0 AND volume > 40 THEN NULL ELSE trade_date END AS trade_date, open,
  CASE WHEN sk % 7 = 0 AND volume > 80 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN sk % 11 = 0 AND volume > 60 THEN 0.0E0 ELSE close END AS close, CASE WHEN sk % 19 = 0 THEN -volume ELSE volume END AS volume
FROM bars UNION ALL SELECT market, ts_code, trade_date, open, high, low, close, volume FROM bars WHERE sk % 3 = 0 AND volume > 90
""")


def dirty(spark, d):
    bars = td.bars(spark, d)
    hurt = bars.select(
        "market", "ts_code",
        F.when(~((F.col("sk") % 29 == 0) & (F.col("volume") > 40)), F.col("trade_date")).alias("trade_date"),
        "open",
        F.when((F.col("sk") % 7 == 0) & (F.col("volume") > 80), F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low",
        F.when((F.col("sk") % 11 == 0) & (F.col("volume") > 60), 0.0).otherwise(F.col("close")).alias("close"),
        F.when(F.col("sk") % 19 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
    )
    copies = bars.filter((F.col("sk") % 3 == 0) & (F.col("volume") > 90)).select(*hurt.columns)
    return hurt.unionByName(copies)


def clean_outliers(spark, d):
    return dq.validate_timeseries(td.bars(spark, d))


cte("issue_counts", """
SELECT market, count(*) FILTER (WHERE trade_date IS NULL) AS n0,
  count(*) FILTER (WHERE open <= 0 OR open IS NULL) AS n1, count(*) FILTER (WHERE high <= 0 OR high IS NULL) AS n2,
  count(*) FILTER (WHERE low <= 0 OR low IS NULL) AS n3, count(*) FILTER (WHERE close <= 0 OR close IS NULL) AS n4,
  count(*) FILTER (WHERE high < low) AS n5, count(*) FILTER (WHERE close > high) AS n6, count(*) FILTER (WHERE close < low) AS n7,
  count(*) FILTER (WHERE volume < 0) AS n8, count(*) - count(DISTINCT row(ts_code, trade_date)) AS n9
FROM dirty GROUP BY market
""")
_ISSUES = [
    ("INVALID_DATES", "Some trade dates cannot be parsed"), ("IMPOSSIBLE_PRICES", "Invalid values in open"), ("IMPOSSIBLE_PRICES", "Invalid values in high"),
    ("IMPOSSIBLE_PRICES", "Invalid values in low"), ("IMPOSSIBLE_PRICES", "Invalid values in close"), ("INCONSISTENT_PRICE_RANGE", "High price is below low price"),
    ("CLOSE_OUTSIDE_RANGE", "Close price is above high"), ("CLOSE_OUTSIDE_RANGE", "Close price is below low"), ("NEGATIVE_VOLUME", "Negative values in volume"),
    ("DUPLICATE_DATES", "Duplicate trade dates found"),
]
cte("issues", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT market, '{c}' AS code, '{m}' AS message, n{i} AS rows, 'error' AS severity FROM issue_counts" for i, (c, m) in enumerate(_ISSUES)) + ") WHERE rows > 0")
# Return outliers need a total order, so they are checked on the undamaged bars.
cte("outliers", """
SELECT market, 'OUTLIER_RETURNS' AS code, count(*) AS rows, 'warning' AS severity
FROM (SELECT market, abs(close / lag(close) OVER (PARTITION BY market, ts_code ORDER BY trade_date) - 1) AS r FROM bars) WHERE r > 0.8 GROUP BY market
""")
register("dq1_validate_timeseries", lambda s, d: dq.validate_timeseries(dirty(s, d)).filter("code <> 'OUTLIER_RETURNS'"), "market code message rows:n severity", "issues")
register("dq1_outlier_returns", lambda s, d: clean_outliers(s, d).filter("code = 'OUTLIER_RETURNS'"), "market code rows:n severity", "outliers")

cte("missing_members", """
SELECT r.r_name AS market, count(*) AS rows, count(*) || ' expected universe members are absent' AS message FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.market = r.r_name AND b.sk = s.s_suppkey AND b.trade_date >= DATE '2001-07-30') GROUP BY r.r_name
""")


def expected_members(spark, d):
    return (
        td.table(spark, d, "supplier").join(td.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(td.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("market"), F.col("s_suppkey").cast("string").alias("ts_code"))
    )


register(
    "dq2_universe_membership",
    lambda s, d: dq.missing_members(expected_members(s, d), td.bars(s, d).filter(F.col("trade_date") >= F.lit("2001-07-30").cast("date"))),
    "market rows:n message", "missing_members",
)
register("dq3_valid_price_mask", lambda s, d: td.bars(s, d).withColumn("price_valid", valid_price(F.col("close"), F.col("pre_close"))), "market ts_code trade_date price_valid", "prepared")
register("dq4_expected_universe", lambda s, d: dq.expected_universe_daily(td.bars(s, d)), "market trade_date expected_eligible_count:n expected_universe_source", "expected")

cte("coverage", f"""
SELECT market, trade_date, observed_universe, symbol_count AS observed_symbol_count, valid_amount_observed AS valid_amount_count,
  e.expected_eligible_count, e.expected_universe_source, e.expected_eligible_count - observed_universe AS missing_close_count,
  e.expected_eligible_count - valid_amount_observed AS missing_amount_count,
  CAST(observed_universe AS double) / nullif(e.expected_eligible_count, 0) AS coverage_ratio,
  CAST(valid_amount_observed AS double) / nullif(e.expected_eligible_count, 0) AS liquidity_coverage,
  CASE WHEN CAST(observed_universe AS double) / nullif(e.expected_eligible_count, 0) >= {Q.minimum_coverage} THEN 'VALID' ELSE 'INVALID' END AS data_quality,
  concat_ws(';', CASE WHEN e.expected_eligible_count < {Q.minimum_universe} THEN 'EXPECTED_UNIVERSE_BELOW_MINIMUM_' || e.expected_eligible_count END,
    CASE WHEN CAST(observed_universe AS double) / nullif(e.expected_eligible_count, 0) < {Q.minimum_coverage}
      THEN 'MARKET_COVERAGE_BELOW_MINIMUM_' || printf('%.3f', CAST(observed_universe AS double) / e.expected_eligible_count) END) AS warnings
FROM counts c LEFT JOIN expected e USING (market, trade_date)
""")
register(
    "dq5_market_coverage_daily", lambda s, d: dq.market_coverage_daily(td.bars_with_revisions(s, d), Q),
    "market trade_date observed_universe:n observed_symbol_count:n valid_amount_count:n expected_eligible_count:n missing_close_count:n missing_amount_count:n coverage_ratio:f liquidity_coverage:f data_quality warnings",
    "coverage",
)
cte("assessment", f"""
SELECT market, trade_date AS latest_date, (SELECT count(*) FROM coverage k WHERE k.market = c.market) AS date_count, expected_eligible_count, observed_universe,
  coverage_ratio AS latest_coverage_ratio, expected_eligible_count >= {Q.minimum_universe} AS sufficient_universe, coverage_ratio >= {Q.minimum_coverage} AS sufficient_coverage,
  expected_eligible_count >= {Q.minimum_universe} AND coverage_ratio >= {Q.minimum_coverage} AS valid, warnings0 || warnings AS warnings
FROM (SELECT *, (SELECT concat_ws('', CASE WHEN count(list_date) = 0 THEN 'HISTORICAL_LIST_DATE_INCOMPLETE;' END,
        CASE WHEN count(delist_date) = 0 THEN 'HISTORICAL_DELIST_DATE_INCOMPLETE;' END) FROM bars b WHERE b.market = v.market) AS warnings0 FROM coverage v) c
QUALIFY row_number() OVER (PARTITION BY market ORDER BY trade_date DESC) = 1
""")
register(
    "dq6_assess_market_coverage", lambda s, d: dq.assess_market_coverage(dq.market_coverage_daily(td.bars(s, d), Q, dedupe=False), td.bars(s, d), Q),
    "market latest_date date_count:n expected_eligible_count:n observed_universe:n latest_coverage_ratio:f sufficient_universe sufficient_coverage valid warnings", "assessment",
)
cte("approx", "SELECT market, bool_or(contains(lower(CASE WHEN sk % 97 = 0 THEN 'board_band_APPROX' ELSE limit_method END), 'approx')) AS approximate FROM limits GROUP BY market")
register(
    "dq7_approximate_sources",
    lambda s, d: dq.approximate_sources(td.limits(td.bars(s, d)).withColumn("limit_method", F.when(F.col("row_seq") % 97 == 0, "board_band_APPROX").otherwise(F.col("limit_method")))),
    "market approximate", "approx",
)


def temperature(spark, d, quality=Q):
    bars = panel(spark, d)
    return market_temperature(bars, td.limits(bars), td.index_bars(spark, d, bars), W, quality, td.PERCENTILE, dedupe=False)


def _pct(x: str, part: str = "market", bearish: bool = False) -> str:
    w = f"(PARTITION BY {part} ORDER BY trade_date ROWS BETWEEN {td.PERCENTILE.lookback - 1} PRECEDING AND CURRENT ROW)"
    seen = f"(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {w})"
    score = f"(len(list_filter({seen}, lambda v: v < {x})) + 0.5E0 * len(list_filter({seen}, lambda v: v = {x}))) / len({seen}) * 100.0E0"
    score = f"100.0E0 - {score}" if bearish else score
    return f"CASE WHEN {x} IS NOT NULL AND len({seen}) >= {td.PERCENTILE.min_periods} THEN {score} END"


def _flat(x: str) -> str:
    w = "(PARTITION BY market ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return f"(count({x}) OVER {w} < 5 OR coalesce(list_unique(list({x}) OVER {w}), 0) <= 2 OR coalesce(var_pop({x}) OVER {w}, 0) <= 1e-12)"


def _combine(weights: dict[str, float], score_of) -> str:
    used = [(score_of(n), w) for n, w in weights.items() if w > 0]
    avail = " + ".join(f"CASE WHEN {s} IS NOT NULL THEN {w}E0 ELSE 0.0E0 END" for s, w in used)
    total = " + ".join(f"CASE WHEN {s} IS NOT NULL THEN {s} * ({w}E0 / nullif({avail}, 0)) ELSE 0.0E0 END" for s, w in used)
    return f"CASE WHEN ({avail}) > 0 THEN {total} END"


from ..params import BREADTH_WEIGHTS, LIQUIDITY_WEIGHTS, MODULE_WEIGHTS, PROFIT_WEIGHTS, STRETCH_WEIGHTS  # noqa: E402

_RAW = {**{f: f for f in BREADTH_WEIGHTS}, **{f: f for f in PROFIT_WEIGHTS}, "turnover_percentile": "total_market_turnover", "signed_turnover_intensity": "signed_turnover_intensity"}
_BEAR = ("limit_down_rate", "failed_limit_rate")
cte("percentiles", "SELECT *, " + ", ".join(f"{_pct(c, 'market', f in _BEAR)} AS p_{f}" for f, c in _RAW.items()) + ", " + ", ".join(f"{_flat(c)} AS flat_{f}" for f, c in _RAW.items() if f != "turnover_percentile") + " FROM profit")
cte("masked", "SELECT *, p_turnover_percentile AS s_turnover_percentile, " + ", ".join(f"CASE WHEN NOT flat_{f} THEN p_{f} END AS s_{f}" for f in _RAW if f != "turnover_percentile") + ", " + ", ".join(
    f"concat_ws(',', {', '.join(f'CASE WHEN flat_{f} THEN {chr(39)}{f}{chr(39)} END' for f in fs)}) AS {m}_degenerate_factors"
    for m, fs in (("breadth", BREADTH_WEIGHTS), ("profit_effect", PROFIT_WEIGHTS), ("liquidity", ["signed_turnover_intensity"]))
) + " FROM percentiles")
cte("module_scores", "SELECT *, " + ", ".join(f"{_combine(w, lambda n: 's_' + n)} AS {m}_score" for m, w in (("breadth", BREADTH_WEIGHTS), ("profit_effect", PROFIT_WEIGHTS), ("liquidity", LIQUIDITY_WEIGHTS))) + " FROM masked")
cte("stretch_pct", "SELECT market, benchmark, trade_date, " + ", ".join(f"{_pct(f, 'market, benchmark')} AS {f}" for f in STRETCH_WEIGHTS) + " FROM stretch")
cte("stretch_avg", "SELECT market, trade_date, " + ", ".join(f"avg({f}) AS s_{f}" for f in STRETCH_WEIGHTS) + " FROM stretch_pct GROUP BY market, trade_date")
cte("stretch_score", f"SELECT *, {_combine(STRETCH_WEIGHTS, lambda n: 's_' + n)} AS stretch_score FROM stretch_avg")
cte("dataset_warnings", f"""
SELECT s.market, concat_ws(';', 'SURVIVORSHIP_BIAS_WARNING', 'OPTIONS_UNAVAILABLE', 'MARGIN_OPTIONAL', 'FAILED_LIMIT_RATE_UNAVAILABLE',
  CASE WHEN symbols < {Q.partial_panel_symbols} THEN 'PARTIAL_STOCK_PANEL_SYMBOLS_' || symbols END,
  CASE WHEN l.market IS NULL THEN 'LIMIT_DATA_UNAVAILABLE' WHEN approximate THEN 'LIMIT_RULES_APPROXIMATE_NOT_PRODUCTION_VALID' END) AS data_quality_warnings
FROM (SELECT market, count(DISTINCT ts_code) AS symbols FROM bars GROUP BY market) s
LEFT JOIN (SELECT market, bool_or(contains(lower(limit_method), 'approx')) AS approximate FROM limits GROUP BY market) l USING (market)
""")
cte("temp0", f"""
SELECT m.*, z.stretch_score, CAST(NULL AS double) AS options_score, w.data_quality_warnings AS base_warnings,
  CAST(m.observed_universe AS double) / nullif(m.expected_eligible_count, 0) AS market_coverage_ratio,
  last_value(CASE WHEN m.observed_universe > 0 THEN m.observed_universe END IGNORE NULLS) OVER (PARTITION BY m.market ORDER BY m.trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_observed
FROM module_scores m LEFT JOIN stretch_score z USING (market, trade_date) LEFT JOIN dataset_warnings w ON w.market = m.market
""")
_RATIOS = [c for c in dq.RATIO_COLUMNS]
cte("temp1", "SELECT *, " + _combine(MODULE_WEIGHTS, lambda n: n) + " AS raw0, " + " OR ".join(f"coalesce({c} < 0 OR {c} > 1, false)" for c in _RATIOS) + " AS ratio_violation FROM temp0")


def _mismatch(c: str) -> str:
    return f"CASE WHEN expected_eligible_count > 0 AND abs({c} - expected_eligible_count) / CAST(expected_eligible_count AS double) > {Q.max_cross_module_deviation} THEN 'CROSS_MODULE_UNIVERSE_MISMATCH_{c}' END"


cte("temp2", f"""
SELECT *, concat_ws(';', CASE WHEN expected_eligible_count < {Q.minimum_universe} THEN 'EXPECTED_UNIVERSE_BELOW_MINIMUM_' || expected_eligible_count END,
  CASE WHEN NOT coalesce(market_coverage_ratio >= {Q.minimum_coverage}, false) THEN 'MARKET_COVERAGE_BELOW_MINIMUM' END,
  CASE WHEN CAST(observed_universe AS double) / prev_observed < {Q.minimum_relative_universe} THEN 'MARKET_COVERAGE_COLLAPSE' END,
  {_mismatch('eligible_count')}, {_mismatch('observed_eligible_count')}, {_mismatch('valid_amount_count')},
  CASE WHEN ratio_violation THEN 'IMPOSSIBLE_RATIO' END) AS integrity_warnings FROM temp1
""")
cte("temp3", """
SELECT * REPLACE (CASE WHEN breadth_score IS NULL AND breadth_degenerate_factors <> '' THEN 'DEGENERATE' ELSE breadth_quality END AS breadth_quality,
    CASE WHEN profit_effect_score IS NULL AND profit_effect_degenerate_factors <> '' THEN 'DEGENERATE' ELSE profit_effect_quality END AS profit_effect_quality,
    CASE WHEN liquidity_score IS NULL AND liquidity_degenerate_factors <> '' THEN 'DEGENERATE' ELSE liquidity_quality END AS liquidity_quality),
  integrity_warnings <> '' AS integrity_invalid,
  concat_ws(';', nullif(base_warnings, ''), nullif(integrity_warnings, '')) AS data_quality_warnings
FROM temp2
""")
cte("temperature", """
SELECT *, CASE WHEN NOT integrity_invalid THEN raw0 END AS raw_market_temperature, CASE grade WHEN 'A' THEN 'HIGH' WHEN 'B' THEN 'MEDIUM' WHEN 'C' THEN 'LOW' ELSE 'NONE' END AS confidence,
  CASE WHEN grade = 'INVALID' THEN 'INVALID' WHEN data_quality_warnings <> '' THEN 'WARN' ELSE 'PASS' END AS data_quality_status, grade AS market_temperature_quality,
  concat_ws(',', 'options,failed_limit_rate,margin_buy_ratio', CASE WHEN breadth_score IS NULL THEN 'breadth_score' END, CASE WHEN profit_effect_score IS NULL THEN 'profit_effect_score' END,
    CASE WHEN liquidity_score IS NULL THEN 'liquidity_score' END, CASE WHEN stretch_score IS NULL THEN 'stretch_score' END) AS missing_factors
FROM (SELECT *, CASE WHEN integrity_invalid OR 'INVALID' IN (breadth_quality, profit_effect_quality, liquidity_quality) THEN 'INVALID'
        WHEN breadth_quality IN ('DEGRADED', 'DEGENERATE') OR profit_effect_quality IN ('DEGRADED', 'DEGENERATE') OR liquidity_quality IN ('DEGRADED', 'DEGENERATE') THEN 'C'
        WHEN data_quality_warnings <> '' THEN 'B' ELSE 'A' END AS grade FROM temp3)
""")

cte("violations", "SELECT market, trade_date, coalesce(adv_ratio * 1.5 > 1, false) OR coalesce(limit_up_rate > 1, false) OR coalesce(breadth_coverage > 1, false) AS ratio_violation FROM profit")
register(
    "dq8_ratio_violations",
    lambda s, d: _profit_for_ratios(s, d).withColumn("ratio_violation", dq.ratio_violation(("adv_ratio", "limit_up_rate", "breadth_coverage"))),
    "market trade_date ratio_violation", "violations",
)


def _profit_for_ratios(spark, d):
    from .factors import profit

    return profit(spark, d).withColumn("adv_ratio", F.col("adv_ratio") * 1.5)


register("dq9_integrity_gate", temperature, "market trade_date integrity_warnings integrity_invalid ratio_violation", "temperature")
register(
    "dq10_quality_grade", temperature,
    "market trade_date breadth_quality profit_effect_quality liquidity_quality market_temperature_quality confidence data_quality_status", "temperature",
)
register("dq11_dataset_warnings", lambda s, d: dq.dataset_warnings(td.bars(s, d), td.limits(td.bars(s, d)), None, Q), "market data_quality_warnings", "dataset_warnings")

# The second limit panel uses a slightly tighter rule, so some days mismatch.
cte("limits_b", "SELECT market, ts_code, trade_date, close / pre_close - 1 >= 1.1E0 AS is_limit_up, close / pre_close - 1 <= -0.5E0 AS is_limit_down FROM bars WHERE pre_close > 0 AND (close / pre_close - 1 >= 1.1E0 OR close / pre_close - 1 <= -0.5E0)")
cte("cross_days", "SELECT *, row_number() OVER (PARTITION BY market ORDER BY trade_date) - 1 AS pos, count(*) OVER (PARTITION BY market) AS n FROM limit_days")
cte("cross_picks", """
SELECT market, 'max_down' AS reason, arg_max(trade_date, row(limit_down_count, -epoch(trade_date))) AS trade_date FROM cross_days GROUP BY market
UNION ALL SELECT market, 'max_up', arg_max(trade_date, row(limit_up_count, -epoch(trade_date))) FROM cross_days GROUP BY market
UNION ALL SELECT market, 'median', trade_date FROM cross_days WHERE pos = n // 2
""")
cte("cross_pairs", """
SELECT coalesce(a.market, b.market) AS market, coalesce(a.trade_date, b.trade_date) AS trade_date, coalesce(a.is_limit_up, false) AS a_up, coalesce(a.is_limit_down, false) AS a_down,
  coalesce(b.is_limit_up, false) AS b_up, coalesce(b.is_limit_down, false) AS b_down FROM limits a FULL JOIN limits_b b USING (market, ts_code, trade_date)
""")
cte("cross_check", " UNION ALL ".join(f"""
SELECT p.market, p.reason, p.trade_date, '{side}' AS side, count(*) FILTER (WHERE a_{side}) AS cached_count, count(*) FILTER (WHERE b_{side}) AS derived_count,
  count(*) FILTER (WHERE a_{side} AND NOT b_{side}) AS only_cached, count(*) FILTER (WHERE b_{side} AND NOT a_{side}) AS only_derived,
  CASE WHEN count(*) FILTER (WHERE a_{side} OR b_{side}) = 0 THEN 1.0E0 ELSE count(*) FILTER (WHERE a_{side} AND b_{side}) / CAST(count(*) FILTER (WHERE a_{side} OR b_{side}) AS double) END AS jaccard,
  CASE WHEN count(*) FILTER (WHERE a_{side} <> b_{side}) = 0 THEN 'PASS' ELSE 'MISMATCH' END AS status
FROM cross_picks p JOIN cross_pairs c USING (market, trade_date) GROUP BY p.market, p.reason, p.trade_date""" for side in ("up", "down")))


def cross_check(spark, d):
    bars = panel(spark, d)
    move = F.col("close") / F.nullif(F.col("pre_close"), F.lit(0.0)) - 1
    other = bars.filter((F.col("pre_close") > 0) & ((move >= 1.1) | (move <= -0.5))).select("market", "ts_code", "trade_date", (move >= 1.1).alias("is_limit_up"), (move <= -0.5).alias("is_limit_down"))
    return dq.limit_cross_check(td.limits(bars), other)


register("dq12_limit_cross_check", cross_check, "market reason trade_date side cached_count:n derived_count:n only_cached:n only_derived:n jaccard:f status", "cross_check")
