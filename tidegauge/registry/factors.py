"""Panel preparation and factor-module queries (PF)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import factors as fx
from ..operators.panel import prepare_stock_panel
from ..operators.quality import expected_universe_daily
from ..plans.temperature import raw_factors
from ..sources import testdata as td
from ..sources.tables import stage_table
from .base import cte, register

W = td.WINDOWS
KEYS = ["market"]
IDX = ["market", "benchmark"]

cte("deduped", "SELECT * FROM panel_rev QUALIFY row_number() OVER (PARTITION BY market, ts_code, trade_date ORDER BY row_seq DESC) = 1")
cte("stepped", """
SELECT * REPLACE (coalesce(pre_close, lag(close) OVER w) AS pre_close), pre_close AS pre_raw,
  lead(close) OVER w AS next_close, lead(trade_date) OVER w AS next_date, row_number() OVER w - 1 AS age
FROM deduped WINDOW w AS (PARTITION BY market, ts_code ORDER BY trade_date)
""")
cte("prepared", f"""
SELECT * REPLACE (coalesce(pct_chg, (close / nullif(pre_close, 0) - 1.0) * 100) AS pct_chg), age < {W.exclude_recent} AS recent_ipo_excluded,
  coalesce(close > 0 AND pre_close > 0 AND volume > 0, false) AND NOT regexp_matches(name, '(?i)\\*?ST') AND is_st <> 1
    AND (list_date IS NULL OR trade_date >= list_date) AND (delist_date IS NULL OR trade_date <= delist_date)
    AND NOT age < {W.exclude_recent} AS is_eligible,
  coalesce(close > 0 AND pre_raw > 0 AND volume > 0, false) AND NOT regexp_matches(name, '(?i)\\*?ST') AND is_st <> 1 AS price_valid
FROM stepped
""")


def _roll(agg: str, n: int) -> str:
    w = f"(PARTITION BY market, ts_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) OVER {w} >= {n} THEN {agg}(close) OVER {w} END"


cte("stocks", f"""
SELECT *, {_roll('avg', W.ma_short)} AS ma20, {_roll('avg', W.ma_long)} AS ma60, {_roll('max', W.high_low)} AS rolling_high, {_roll('min', W.high_low)} AS rolling_low
FROM prepared
""")
cte("counts", """
SELECT market, trade_date,
  count(*) FILTER (WHERE is_eligible) AS eligible_count,
  count(*) FILTER (WHERE is_eligible AND close > pre_close) AS advancing_count,
  count(*) FILTER (WHERE is_eligible AND close < pre_close) AS declining_count,
  count(*) FILTER (WHERE is_eligible AND close = pre_close) AS flat_count,
  count(*) FILTER (WHERE is_eligible AND close > ma20) AS above_ma20_count,
  count(*) FILTER (WHERE is_eligible AND close > ma60) AS above_ma60_count,
  count(*) FILTER (WHERE is_eligible AND ma20 IS NOT NULL) AS ma20_valid_count,
  count(*) FILTER (WHERE is_eligible AND ma60 IS NOT NULL) AS ma60_valid_count,
  count(*) FILTER (WHERE is_eligible AND close >= rolling_high) AS new_high_60,
  count(*) FILTER (WHERE is_eligible AND close <= rolling_low) AS new_low_60,
  count(DISTINCT ts_code) AS symbol_count, max(universe_count) AS declared_count,
  sum(amount_rmb) FILTER (WHERE is_eligible) AS total_market_turnover,
  count(amount_rmb) FILTER (WHERE is_eligible) AS eligible_amount_count,
  count(*) FILTER (WHERE price_valid) AS observed_universe,
  count(*) FILTER (WHERE amount_rmb >= 0) AS valid_amount_observed
FROM stocks GROUP BY market, trade_date
""")
cte("securities", """
SELECT market, ts_code, min(trade_date) AS first_seen, min(list_date) AS list_date, min(delist_date) AS delist_date FROM bars GROUP BY market, ts_code
""")
cte("days", "SELECT DISTINCT market, trade_date FROM bars")
cte("expected", """
SELECT d.market, d.trade_date,
  CASE WHEN count(s.ts_code) FILTER (WHERE s.list_date <= d.trade_date AND (s.delist_date IS NULL OR s.delist_date >= d.trade_date)) > 0
       THEN count(s.ts_code) FILTER (WHERE s.list_date <= d.trade_date AND (s.delist_date IS NULL OR s.delist_date >= d.trade_date))
       ELSE count(s.ts_code) END AS expected_eligible_count,
  CASE WHEN count(s.ts_code) FILTER (WHERE s.list_date <= d.trade_date AND (s.delist_date IS NULL OR s.delist_date >= d.trade_date)) > 0
       THEN 'point_in_time_listing_metadata' ELSE 'cumulative_observed_symbols' END AS expected_universe_source
FROM days d JOIN securities s ON s.market = d.market AND s.first_seen <= d.trade_date GROUP BY d.market, d.trade_date
""")
cte("breadth", f"""
SELECT c.*, e.expected_eligible_count, e.expected_universe_source,
  CAST(advancing_count AS double) / nullif(advancing_count + declining_count, 0) AS adv_ratio,
  CAST(above_ma20_count AS double) / nullif(ma20_valid_count, 0) AS above_ma20_ratio,
  CAST(above_ma60_count AS double) / nullif(ma60_valid_count, 0) AS above_ma60_ratio,
  CAST(new_high_60 - new_low_60 AS double) / nullif(eligible_count, 0) AS nhnl_ratio,
  e.expected_eligible_count AS known_stocks,
  CAST(eligible_count AS double) / nullif(e.expected_eligible_count, 0) AS breadth_coverage,
  CASE WHEN CAST(eligible_count AS double) / nullif(e.expected_eligible_count, 0) >= {td.QUALITY.minimum_coverage} THEN 'VALID' ELSE 'INVALID' END AS breadth_quality
FROM counts c LEFT JOIN expected e USING (market, trade_date)
""")
cte("turnover_stats", f"""
SELECT *, CASE WHEN count(total_market_turnover) OVER z >= {W.turnover_z} THEN avg(total_market_turnover) OVER z END AS mu,
  CASE WHEN count(total_market_turnover) OVER z >= {W.turnover_z} THEN stddev_pop(total_market_turnover) OVER z END AS sigma
FROM breadth WINDOW z AS (PARTITION BY market ORDER BY trade_date ROWS BETWEEN {W.turnover_z - 1} PRECEDING AND CURRENT ROW)
""")
cte("liquidity", f"""
SELECT *, CASE WHEN turnover_zscore <= 0 THEN 0.0E0 ELSE turnover_zscore END AS abnormal_turnover,
  CASE WHEN turnover_zscore <= 0 THEN 0.0E0 ELSE turnover_zscore * (2.0E0 * adv_ratio - 1.0E0) END AS signed_turnover_intensity,
  eligible_amount_count AS valid_amount_count,
  CAST(eligible_amount_count AS double) / nullif(known_stocks, 0) AS liquidity_coverage,
  CASE WHEN CAST(eligible_amount_count AS double) / nullif(known_stocks, 0) >= {td.QUALITY.minimum_coverage} THEN 'VALID' ELSE 'INVALID' END AS liquidity_quality
FROM (SELECT *, (total_market_turnover - mu) / nullif(sigma, 0) AS turnover_zscore FROM turnover_stats)
""")
cte("limit_days", """
SELECT market, trade_date, count(*) FILTER (WHERE is_limit_up) AS limit_up_count, count(*) FILTER (WHERE is_limit_down) AS limit_down_count,
  arg_min(limit_up_source, row_seq) FILTER (WHERE is_limit_up AND limit_up_source <> '') AS limit_up_source,
  arg_min(limit_down_source, row_seq) FILTER (WHERE is_limit_down AND limit_down_source <> '') AS limit_down_source,
  arg_min(limit_up_status, row_seq) FILTER (WHERE is_limit_up AND limit_up_status <> '') AS limit_up_status,
  arg_min(limit_down_status, row_seq) FILTER (WHERE is_limit_down AND limit_down_status <> '') AS limit_down_status
FROM limits GROUP BY market, trade_date
""")
cte("calendar", "SELECT market, trade_date, lead(trade_date) OVER (PARTITION BY market ORDER BY trade_date) AS next_market_date FROM days")
cte("next_returns", """
SELECT l.market, l.ts_code, c.next_market_date AS trade_date, n.close / p.close - 1.0E0 AS next_return
FROM limits l JOIN deduped p USING (market, ts_code, trade_date) JOIN calendar c ON c.market = l.market AND c.trade_date = l.trade_date
JOIN deduped n ON n.market = l.market AND n.ts_code = l.ts_code AND n.trade_date = c.next_market_date
WHERE l.is_limit_up AND p.close > 0 AND n.close IS NOT NULL
""")
cte("next_summary", """
SELECT market, trade_date, avg(next_return) AS yesterday_limitup_mean_return, quantile_cont(next_return, 0.5) AS yesterday_limitup_median_return,
  count(*) AS yesterday_limitup_sample_count FROM next_returns GROUP BY market, trade_date
""")
cte("profit_joined", """
SELECT q.* EXCLUDE (limit_up_source, limit_down_source, limit_up_status, limit_down_status, limit_up_count, limit_down_count),
  CASE WHEN have THEN coalesce(limit_up_count, 0) END AS limit_up_count, CASE WHEN have THEN coalesce(limit_down_count, 0) END AS limit_down_count,
  CASE WHEN have THEN coalesce(limit_up_source, 'REAL_LIST') ELSE 'DATA_UNAVAILABLE' END AS limit_up_source,
  CASE WHEN have THEN coalesce(limit_down_source, 'REAL_LIST') ELSE 'DATA_UNAVAILABLE' END AS limit_down_source,
  CASE WHEN have THEN coalesce(limit_up_status, 'REAL_ZERO') ELSE 'DATA_UNAVAILABLE' END AS limit_up_status,
  CASE WHEN have THEN coalesce(limit_down_status, 'REAL_ZERO') ELSE 'DATA_UNAVAILABLE' END AS limit_down_status
FROM (SELECT y.*, d.limit_up_count, d.limit_down_count, d.limit_up_source, d.limit_down_source, d.limit_up_status, d.limit_down_status,
        s.yesterday_limitup_mean_return, s.yesterday_limitup_median_return, s.yesterday_limitup_sample_count, h.market IS NOT NULL AS have,
        y.eligible_count AS observed_eligible_count, coalesce(y.expected_eligible_count, y.eligible_count) AS profit_effect_eligible_count
      FROM liquidity y LEFT JOIN limit_days d USING (market, trade_date) LEFT JOIN next_summary s USING (market, trade_date)
      LEFT JOIN (SELECT DISTINCT market FROM limit_days) h ON h.market = y.market) q
""")
cte("profit_rates", """
SELECT *, CAST(limit_up_count AS double) / nullif(profit_effect_eligible_count, 0) AS limit_up_rate,
  CAST(limit_down_count AS double) / nullif(profit_effect_eligible_count, 0) AS limit_down_rate,
  CAST(NULL AS double) AS failed_limit_rate,
  CASE WHEN regexp_matches(limit_down_status, '^(REAL|LEGACY)') THEN profit_effect_eligible_count ELSE 0 END AS limit_rule_known_count,
  have AND (count(limit_down_count) OVER v < 5 OR list_unique(list(limit_down_count) OVER v) <= 2 OR coalesce(var_pop(limit_down_count) OVER v, 0) <= 1e-12)
    AND count(limit_down_count) OVER v >= 5 AS flat
FROM profit_joined WINDOW v AS (PARTITION BY market ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""")
cte("profit", f"""
SELECT * REPLACE (CASE WHEN flat AND regexp_matches(limit_down_status, '^(REAL|LEGACY)') THEN 'DEGENERATE' ELSE limit_down_status END AS limit_down_status),
  profit_effect_eligible_count - limit_rule_known_count AS limit_rule_unknown_count,
  CASE WHEN flat AND q0 = 'VALID' THEN 'DEGRADED' ELSE q0 END AS profit_effect_quality
FROM (SELECT *, CASE WHEN profit_effect_coverage >= {td.QUALITY.minimum_coverage} THEN 'VALID' ELSE 'INVALID' END AS q0
      FROM (SELECT *, CASE WHEN have THEN CAST(limit_rule_known_count AS double) / nullif(profit_effect_eligible_count, 0) ELSE 0 END AS profit_effect_coverage FROM profit_rates))
""")
cte("index_steps", f"""
SELECT *, row_number() OVER w - 1 AS position, lag(close) OVER w AS previous_close,
  lag(close, {W.short_return}) OVER w AS close_a, lag(close, {W.long_return}) OVER w AS close_b,
  CASE WHEN count(close) OVER m >= {W.index_ma} THEN avg(close) OVER m END AS index_ma
FROM index_bars WINDOW w AS (PARTITION BY market, benchmark ORDER BY trade_date),
  m AS (PARTITION BY market, benchmark ORDER BY trade_date ROWS BETWEEN {W.index_ma - 1} PRECEDING AND CURRENT ROW)
""")
cte("index_moves", """
SELECT *, greatest(high - low, abs(high - previous_close), abs(low - previous_close)) AS true_range,
  CASE WHEN close - previous_close > 0 THEN close - previous_close WHEN previous_close IS NOT NULL THEN 0.0E0 END AS gain,
  CASE WHEN close - previous_close < 0 THEN previous_close - close WHEN previous_close IS NOT NULL THEN 0.0E0 END AS loss
FROM index_steps
""")


def _wilder(x: str, n: int) -> str:
    seed = f"(avg({x}) FILTER (WHERE position BETWEEN 1 AND {n}) OVER u)"
    later = f"coalesce(list({x}) FILTER (WHERE position > {n}) OVER u, [])"
    return f"CASE WHEN position >= {n} THEN list_reduce(list_prepend({seed}, {later}), lambda a, v: (a * {n - 1}.0E0 + v) / {n}.0E0) END"


cte("index_wilder", f"""
SELECT *, {_wilder('gain', W.rsi)} AS avg_gain, {_wilder('loss', W.rsi)} AS avg_loss, {_wilder('true_range', W.atr)} AS atr14
FROM index_moves WINDOW u AS (PARTITION BY market, benchmark ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
cte("stretch", """
SELECT *, CASE WHEN avg_gain = 0 AND avg_loss = 0 THEN 50.0E0 WHEN avg_loss = 0 THEN 100.0E0 ELSE 100.0E0 - 100.0E0 / (1.0E0 + avg_gain / nullif(avg_loss, 0)) END AS rsi14,
  (close - index_ma) / nullif(atr14, 0) AS ma20_atr, close / nullif(close_a, 0) - 1.0E0 AS return5d, close / nullif(close_b, 0) - 1.0E0 AS return20d
FROM index_wilder
""")


def prepared(spark, d):
    return prepare_stock_panel(td.bars_with_revisions(spark, d), W)


def stocks(spark, d):
    return fx.add_stock_windows(prepare_stock_panel(td.bars(spark, d), W, dedupe=False), W)


def counts(spark, d):
    return fx.daily_panel_counts(stocks(spark, d))


def with_expected(spark, d):
    return counts(spark, d).join(expected_universe_daily(td.bars(spark, d)), ["market", "trade_date"], "left")


def breadth(spark, d):
    return fx.add_breadth(with_expected(spark, d), td.QUALITY.minimum_coverage, "expected_eligible_count")


def liquidity(spark, d):
    return fx.add_liquidity(breadth(spark, d), W, KEYS, td.QUALITY.minimum_coverage, "expected_eligible_count")


def limit_panel(spark, d):
    return fx.prepare_limit_panel(td.limits(td.bars(spark, d)))


def next_returns(bars):
    return fx.limitup_next_returns(prepare_stock_panel(bars, W, dedupe=False), fx.prepare_limit_panel(td.limits(bars)))


def panel(spark, d):
    """The stock panel as a stored table, for plans that walk it in several branches."""
    return stage_table(td.bars(spark, d), "panel")


def profit(spark, d):
    bars = panel(spark, d)
    return raw_factors(bars, td.limits(bars), W, td.QUALITY, dedupe=False)


def stretch(spark, d, bars=None):
    return fx.add_stretch(fx.prepare_index(td.index_bars(spark, d, bars)), W, IDX)


register("pf1_prepare_stock_panel", prepared, "market ts_code trade_date close:f pre_close:f pct_chg:f recent_ipo_excluded is_eligible", "prepared")
register("pf2_stock_windows", stocks, "market ts_code trade_date ma20:f ma60:f rolling_high:f rolling_low:f", "stocks")
register(
    "pf3_breadth_counts", counts,
    "market trade_date eligible_count:n advancing_count:n declining_count:n flat_count:n above_ma20_count:n above_ma60_count:n ma20_valid_count:n ma60_valid_count:n new_high_60:n new_low_60:n",
    "counts",
)
register("pf4_breadth_ratios", breadth, "market trade_date adv_ratio:f above_ma20_ratio:f above_ma60_ratio:f nhnl_ratio:f", "breadth")
register("pf5_coverage_denominators", breadth, "market trade_date known_stocks:n breadth_coverage:f breadth_quality", "breadth")
register("pf6_limit_rates", profit, "market trade_date observed_eligible_count:n profit_effect_eligible_count:n limit_up_count:n limit_down_count:n limit_up_rate:f limit_down_rate:f", "profit")
register(
    "pf7_yesterday_limitup", lambda s, d: fx.limitup_next_summary(next_returns(panel(s, d))),
    "market trade_date yesterday_limitup_mean_return:f yesterday_limitup_median_return:f yesterday_limitup_sample_count:n", "next_summary",
)
register(
    "pf8_limit_source_status", lambda s, d: fx.limit_day_counts(limit_panel(s, d)),
    "market trade_date limit_up_source limit_down_source limit_up_status limit_down_status", "limit_days",
)
register(
    "pf9_limit_rule_coverage", profit,
    "market trade_date limit_rule_known_count:n limit_rule_unknown_count:n profit_effect_coverage:f limit_down_status profit_effect_quality", "profit",
)


def limit_copies(spark, d):
    first = td.limits(td.bars(spark, d)).drop("sk")
    later = first.withColumns({"limit_method": F.lit("second_copy"), "row_seq": F.col("row_seq") + 1_000_000_000, "is_limit_up": F.lit(None).cast("boolean")})
    return fx.prepare_limit_panel(first.unionByName(later))


register("pf10_prepare_limit_panel", limit_copies, "market ts_code trade_date is_limit_up is_limit_down limit_method", "limits")
register("pf11_turnover_zscore", liquidity, "market trade_date total_market_turnover:f turnover_zscore:f", "liquidity")
register(
    "pf12_signed_turnover", liquidity,
    "market trade_date abnormal_turnover:f signed_turnover_intensity:f valid_amount_count:n liquidity_coverage:f liquidity_quality", "liquidity",
)
register("pf13_prepare_index", lambda s, d: fx.prepare_index(td.index_bars(s, d).withColumn("row_seq", F.lit(1)).unionByName(td.index_bars(s, d).withColumns({"row_seq": F.lit(2), "close": F.col("close") + 1}))), "market benchmark trade_date open:f high:f low:f close:f", "index_bars")
register("pf14_true_range", lambda s, d: fx.add_true_range(td.index_bars(s, d), IDX), "market benchmark trade_date position:n true_range:f", "index_moves")
register("pf15_wilder_atr", stretch, "market benchmark trade_date atr14:f", "stretch")
register("pf16_wilder_rsi", stretch, "market benchmark trade_date rsi14:f", "stretch")
FLAT_FROM = 40
cte("index_flat", f"""
SELECT market, benchmark, trade_date, position, CASE WHEN position >= {FLAT_FROM} THEN frozen ELSE close END AS close
FROM (SELECT *, row_number() OVER (PARTITION BY market, benchmark ORDER BY trade_date) - 1 AS position,
  nth_value(close, {FLAT_FROM + 1}) OVER (PARTITION BY market, benchmark ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS frozen FROM index_bars)
""")
cte("flat_moves", """
SELECT *, CASE WHEN close - previous_close > 0 THEN close - previous_close WHEN previous_close IS NOT NULL THEN 0.0E0 END AS gain,
  CASE WHEN close - previous_close < 0 THEN previous_close - close WHEN previous_close IS NOT NULL THEN 0.0E0 END AS loss
FROM (SELECT *, lag(close) OVER (PARTITION BY market, benchmark ORDER BY trade_date) AS previous_close FROM index_flat)
""")
cte("flat_rsi", f"""
SELECT *, CASE WHEN avg_gain = 0 AND avg_loss = 0 THEN 50.0E0 WHEN avg_loss = 0 THEN 100.0E0 ELSE 100.0E0 - 100.0E0 / (1.0E0 + avg_gain / nullif(avg_loss, 0)) END AS rsi14
FROM (SELECT *, {_wilder('gain', W.rsi)} AS avg_gain, {_wilder('loss', W.rsi)} AS avg_loss
  FROM flat_moves WINDOW u AS (PARTITION BY market, benchmark ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
""")


def flat_stretch(spark, d):
    """The index bars with every close from row FLAT_FROM on frozen: the averages fade, their ratio must not."""
    bars = fx.prepare_index(td.index_bars(spark, d))
    w = Window.partitionBy(*IDX).orderBy("trade_date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frozen = F.when(F.row_number().over(w) > FLAT_FROM, F.nth_value("close", FLAT_FROM + 1).over(whole)).otherwise(F.col("close"))
    return fx.add_stretch(bars.withColumn("close", frozen), W, IDX)


register("pf16_rsi_flat_tail", flat_stretch, "market benchmark trade_date rsi14:f", "flat_rsi")
register("pf17_index_distance_returns", stretch, "market benchmark trade_date ma20_atr:f return5d:f return20d:f", "stretch")
cte("stretch_wide", """
SELECT market, trade_date, """ + ", ".join(
    f"max({f}) FILTER (WHERE benchmark = '{b}') AS {b}_{f}" for b in td.BENCHMARKS for f in ("rsi14", "ma20_atr", "return5d", "return20d")
) + " FROM stretch GROUP BY market, trade_date")
register(
    "pf18_stretch_wide", lambda s, d: fx.stretch_wide(stretch(s, d), td.BENCHMARKS),
    "market trade_date " + " ".join(f"{b}_{f}:f" for b in td.BENCHMARKS for f in ("rsi14", "ma20_atr", "return5d", "return20d")), "stretch_wide",
)
