"""Percentile, composite and temperature queries (SC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.series import degenerate_mask, mid_rank_percentile, trailing_winsorize
from ..operators import factors as fx
from ..operators import scoring as sc
from ..params import BREADTH_WEIGHTS, MODULE_WEIGHTS, Quality
from ..plans.temperature import intraday_temperature, market_temperature, raw_factors
from ..sources import testdata as td
from ..sources.tables import hand_off, stage_table
from .base import cte, register
from .factors import IDX, KEYS, W, panel, profit, stretch
from .quality import Q, temperature

P = td.PERCENTILE

register("sc1_historical_percentile", lambda s, d: profit(s, d).withColumns({"p_adv_ratio": mid_rank_percentile("adv_ratio", KEYS, P.lookback, P.min_periods), "p_limit_down_rate": mid_rank_percentile("limit_down_rate", KEYS, P.lookback, P.min_periods, True)}), "market trade_date p_adv_ratio:f p_limit_down_rate:f", "percentiles")
register("sc2_degenerate_mask", lambda s, d: profit(s, d).withColumns({"flat_limit_up_rate": degenerate_mask("limit_up_rate", KEYS, 20, 2, 5, 1e-12), "flat_failed_limit_rate": degenerate_mask("failed_limit_rate", KEYS, 20, 2, 5, 1e-12)}), "market trade_date flat_limit_up_rate flat_failed_limit_rate", "percentiles")
register("sc3_mask_degenerate_scores", lambda s, d: sc.score_profit_effect(profit(s, d), KEYS, P), "market trade_date s_limit_up_rate:f s_limit_down_rate:f s_yesterday_limitup_mean_return:f s_failed_limit_rate:f profit_effect_degenerate_factors", "masked")
_w = f"(PARTITION BY market ORDER BY trade_date ROWS BETWEEN {P.lookback - 1} PRECEDING AND CURRENT ROW)"
cte("winsorized", f"""
SELECT market, trade_date, CASE WHEN total_market_turnover IS NOT NULL THEN CASE WHEN count(total_market_turnover) OVER {_w} >= {P.min_periods}
  THEN least(greatest(total_market_turnover, quantile_cont(total_market_turnover, 0.01) OVER {_w}), quantile_cont(total_market_turnover, 0.99) OVER {_w}) ELSE total_market_turnover END END AS clipped FROM liquidity
""")
register("sc4_rolling_winsorize", lambda s, d: profit(s, d).withColumn("clipped", trailing_winsorize("total_market_turnover", KEYS, P.lookback, P.min_periods, 0.01, 0.99)), "market trade_date clipped:f", "winsorized")


def _eff(weights: dict[str, float], name: str) -> str:
    avail = " + ".join(f"CASE WHEN s_{n} IS NOT NULL THEN {w}E0 ELSE 0.0E0 END" for n, w in weights.items())
    return f"coalesce(CASE WHEN s_{name} IS NOT NULL THEN {weights[name]}E0 / nullif({avail}, 0) END, 0.0E0)"


cte("combined", "SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN s_{n} IS NULL THEN '{n}' END" for n in BREADTH_WEIGHTS) + ") AS breadth_missing_factors, " + ", ".join(f"{_eff(BREADTH_WEIGHTS, n)} AS w_{n}" for n in BREADTH_WEIGHTS) + " FROM module_scores")


def combined(spark, d):
    scored = sc.score_breadth(profit(spark, d), KEYS, P)
    return scored.withColumns({f"w_{n}": F.col("breadth_effective_weights")[n] for n in BREADTH_WEIGHTS})


register("sc5_combine_scores", combined, "market trade_date breadth_score:f breadth_missing_factors " + " ".join(f"w_{n}:f" for n in BREADTH_WEIGHTS), "combined")
register("sc6_breadth_score", lambda s, d: sc.score_breadth(profit(s, d), KEYS, P), "market trade_date breadth_score:f breadth_degenerate_factors", "module_scores")
register("sc7_profit_effect_score", lambda s, d: sc.score_profit_effect(profit(s, d), KEYS, P), "market trade_date profit_effect_score:f profit_effect_degenerate_factors", "module_scores")
register("sc8_liquidity_score", lambda s, d: sc.score_liquidity(profit(s, d), KEYS, P), "market trade_date liquidity_score:f liquidity_degenerate_factors", "module_scores")
register("sc9_stretch_score", lambda s, d: sc.score_stretch(stretch(s, d), KEYS, P), "market trade_date s_rsi14:f s_ma20_atr:f s_return5d:f s_return20d:f stretch_score:f", "stretch_score")
register(
    "sc10_market_temperature", temperature,
    "market trade_date breadth_score:f profit_effect_score:f liquidity_score:f stretch_score:f raw_market_temperature:f market_temperature_quality confidence missing_factors data_quality_warnings", "temperature",
)
LIVE_DAY = "2001-06-04"
PRODUCTION = Quality(**{**Q.__dict__, "production": True})


def intraday(spark, d):
    """History up to the day before, recomputed factors only for the recent 30 weeks."""
    bars = panel(spark, d)
    day = F.lit(LIVE_DAY).cast("date")
    history = raw_factors(bars, td.limits(bars), W, Q, dedupe=False)
    recent = stage_table(bars.filter(F.col("trade_date").between(F.date_sub(day, 7 * 30), day)), "recent")
    index = hand_off(td.index_bars(spark, d, bars))
    return intraday_temperature(recent, td.limits(recent), index.filter(F.col("trade_date") <= day), history, fx.add_stretch(fx.prepare_index(index), W, IDX), LIVE_DAY, W, PRODUCTION, P, dedupe=False)


# The oracle scores the same day from the full table: a live day must agree with the daily run on every
# factor whose inputs fit in the recent window.
register("sc11_intraday_temperature", intraday, "market trade_date adv_ratio:f above_ma60_ratio:f nhnl_ratio:f turnover_zscore:f breadth_score:f profit_effect_score:f liquidity_score:f stretch_score:f raw_market_temperature:f market_temperature_quality", f"temperature WHERE trade_date = DATE '{LIVE_DAY}'")
cte("latest_in_period", "SELECT * FROM temperature WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' AND market_temperature_quality <> 'INVALID' QUALIFY row_number() OVER (PARTITION BY market ORDER BY trade_date DESC) = 1")
register("sc12_period_latest", lambda s, d: sc.latest(sc.in_period(temperature(s, d), "1998-01-01", "2000-12-31"), KEYS, F.col("market_temperature_quality") != "INVALID"), "market trade_date raw_market_temperature:f", "latest_in_period")

cte("temp_distribution", """
SELECT market, count(raw_market_temperature) AS n, avg(raw_market_temperature) AS mean, stddev_samp(raw_market_temperature) AS std, min(raw_market_temperature) AS min,
  quantile_cont(raw_market_temperature, 0.05) AS p5, quantile_cont(raw_market_temperature, 0.25) AS p25, quantile_cont(raw_market_temperature, 0.5) AS median,
  quantile_cont(raw_market_temperature, 0.75) AS p75, quantile_cont(raw_market_temperature, 0.95) AS p95, max(raw_market_temperature) AS max FROM temperature GROUP BY market
""")
register("sc13_distribution_summary", lambda s, d: sc.distribution(temperature(s, d), "raw_market_temperature"), "market n:n mean:f std:f min:f p5:f p25:f median:f p75:f p95:f max:f", "temp_distribution")
cte("version_summary", """
SELECT market, 'current' AS version, max(symbol_count) AS max_symbols, count(*) FILTER (WHERE market_temperature_quality = 'INVALID') AS invalid_days,
  count(*) FILTER (WHERE limit_down_count > 0) AS nonzero_limit_down_days FROM temperature GROUP BY market
""")
register("sc13_version_comparison", lambda s, d: sc.version_summary(temperature(s, d), "current"), "market version max_symbols:n invalid_days:n nonzero_limit_down_days:n", "version_summary")
TARGETS = ("1996-02-01", "1999-07-15", "2005-01-01")
cte("nearest", f"""
SELECT t.target_date, m.market, m.trade_date, m.adv_ratio FROM profit m, (SELECT unnest([{', '.join(f"DATE '{t}'" for t in TARGETS)}]) AS target_date) t
QUALIFY row_number() OVER (PARTITION BY m.market, t.target_date ORDER BY abs(m.trade_date - t.target_date), m.trade_date) = 1
""")
register("sc14_nearest_date", lambda s, d: sc.nearest_date(profit(s, d), TARGETS, ["adv_ratio"]), "market target_date trade_date adv_ratio:f", "nearest")
cte("rebased", """
SELECT *, close / first_value(close) OVER (PARTITION BY market, benchmark ORDER BY trade_date) * 100.0E0 AS rebased FROM index_bars WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
""")
register("sc15_rebased_benchmark", lambda s, d: sc.rebased(td.index_bars(s, d), "1997-01-01", "1999-12-31"), "market benchmark trade_date rebased:f", "rebased")
