"""The four factor modules: breadth, profit effect, liquidity, index stretch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import add_wilder_means, count_true, degenerate_mask, flag, ordered, ratio, rolling
from ..params import Degenerate, Windows
from ..schemas import require
from .panel import keep_first, trading_dates


def add_stock_windows(prepared: DataFrame, windows: Windows = Windows(), keys: Sequence[str] = ("market",)) -> DataFrame:
    """Trailing averages and extremes per security; NULL until the window is full."""
    by = [*keys, "ts_code"]
    return prepared.withColumns(
        {
            "ma20": rolling(F.avg, "close", windows.ma_short, by),
            "ma60": rolling(F.avg, "close", windows.ma_long, by),
            "rolling_high": rolling(F.max, "close", windows.high_low, by),
            "rolling_low": rolling(F.min, "close", windows.high_low, by),
        }
    )


def daily_panel_counts(stocks: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Every per-day number the modules need from the panel, in one aggregation.

    All aggregates merge map-side, so the shuffle carries one row per (keys, day) and input partition,
    whatever the share of rows a single market holds. One row per security and day makes the distinct
    symbol count a plain count.
    """
    ok = F.col("is_eligible")
    close = F.col("close")
    return stocks.groupBy(*keys, "trade_date").agg(
        count_true(ok).alias("eligible_count"),
        count_true(ok & (close > F.col("pre_close"))).alias("advancing_count"),
        count_true(ok & (close < F.col("pre_close"))).alias("declining_count"),
        count_true(ok & (close == F.col("pre_close"))).alias("flat_count"),
        count_true(ok & (close > F.col("ma20"))).alias("above_ma20_count"),
        count_true(ok & (close > F.col("ma60"))).alias("above_ma60_count"),
        count_true(ok & F.col("ma20").isNotNull()).alias("ma20_valid_count"),
        count_true(ok & F.col("ma60").isNotNull()).alias("ma60_valid_count"),
        count_true(ok & (close >= F.col("rolling_high"))).alias("new_high_60"),
        count_true(ok & (close <= F.col("rolling_low"))).alias("new_low_60"),
        F.count("ts_code").alias("symbol_count"),
        F.max("universe_count").cast("bigint").alias("declared_count"),
        F.sum(F.when(ok, F.col("amount_rmb"))).alias("total_market_turnover"),
        count_true(ok & F.col("amount_rmb").isNotNull()).alias("eligible_amount_count"),
        count_true(F.col("price_valid")).alias("observed_universe"),
        count_true(flag(F.col("amount_rmb") >= 0)).alias("valid_amount_observed"),
    )


def known_universe(expected: str | None) -> Column:
    """Expected count when supplied, else the declared universe, else the symbols seen that day."""
    if expected:
        return F.col(expected)
    return F.coalesce(F.col("declared_count"), F.col("symbol_count"))


def quality_label(coverage: Column, minimum: float) -> Column:
    return F.when(flag(coverage >= minimum), "VALID").otherwise("INVALID")


def add_breadth(daily: DataFrame, minimum_coverage: float = 0.90, expected: str | None = None) -> DataFrame:
    known = known_universe(expected)
    coverage = ratio("eligible_count", F.when(known > 0, known))
    return daily.withColumns(
        {
            "adv_ratio": ratio("advancing_count", F.col("advancing_count") + F.col("declining_count")),
            "above_ma20_ratio": ratio("above_ma20_count", "ma20_valid_count"),
            "above_ma60_ratio": ratio("above_ma60_count", "ma60_valid_count"),
            "nhnl_ratio": ratio(F.col("new_high_60") - F.col("new_low_60"), "eligible_count"),
            "known_stocks": known,
            "breadth_coverage": coverage,
            "breadth_quality": quality_label(coverage, minimum_coverage),
        }
    )


def add_liquidity(daily: DataFrame, windows: Windows = Windows(), keys: Sequence[str] = ("market",), minimum_coverage: float = 0.90, expected: str | None = None) -> DataFrame:
    """Turnover z-score against the trailing window, its positive part, and that part signed by breadth."""
    n = windows.turnover_z
    z = F.col("turnover_zscore")
    known = known_universe(expected)
    coverage = ratio("eligible_amount_count", F.when(known > 0, known))
    mean = rolling(F.avg, "total_market_turnover", n, keys)
    spread = rolling(F.stddev_pop, "total_market_turnover", n, keys)
    return daily.withColumn("turnover_zscore", ratio(F.col("total_market_turnover") - mean, spread)).withColumns(
        {
            "abnormal_turnover": F.when(z <= 0, 0.0).otherwise(z),
            "signed_turnover_intensity": F.when(z <= 0, 0.0).otherwise(z * (2.0 * F.col("adv_ratio") - 1.0)),
            "margin_balance_change": F.lit(None).cast("double"),
            "margin_buy_ratio": F.lit(None).cast("double"),
            "valid_amount_count": F.col("eligible_amount_count"),
            "liquidity_coverage": coverage,
            "liquidity_quality": quality_label(coverage, minimum_coverage),
        }
    )


def prepare_limit_panel(limits: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Default missing flags to false, drop keyless rows, keep the first row per security and day."""
    require(limits, {"trade_date", "ts_code"}, "limit panel")
    clean = limits.filter(F.col("trade_date").isNotNull() & F.col("ts_code").isNotNull())
    clean = clean.withColumns({c: flag(F.col(c)) if c in limits.columns else F.lit(False) for c in ("is_limit_up", "is_limit_down")})
    return keep_first(clean, [*keys, "ts_code", "trade_date"])


def _real_text(column: str) -> Column:
    return F.when(~F.col(column).isin("", "nan", "None"), F.col(column))


def limit_day_counts(limits: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Per day: limit counts and the first non-empty source/status among the flagged rows of each side."""

    def first(column: str, side: str) -> Column:
        value = F.when(F.col(side), _real_text(column))
        return F.min_by(value, F.when(value.isNotNull(), F.col("row_seq")))

    return limits.groupBy(*keys, "trade_date").agg(
        count_true(F.col("is_limit_up")).alias("limit_up_count"),
        count_true(F.col("is_limit_down")).alias("limit_down_count"),
        first("limit_up_source", "is_limit_up").alias("limit_up_source"),
        first("limit_down_source", "is_limit_down").alias("limit_down_source"),
        first("limit_up_status", "is_limit_up").alias("limit_up_status"),
        first("limit_down_status", "is_limit_down").alias("limit_down_status"),
    )


def value_summary(df: DataFrame, keys: Sequence[str], value: str, mean: str, count: str, middle: str) -> DataFrame:
    """Mean, number and exact median per group from one aggregation, without gathering a group: equal values merge
    first, a running count over the sorted distinct values streams, and only the one or two middle values are kept."""
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)})
    low, high = F.floor((F.col("_total") - 1) / 2) + 1, F.floor(F.col("_total") / 2) + 1
    start = F.col("_upto") - F.col("_n")

    def at(position: Column) -> Column:
        return F.max(F.when((start < position) & (position <= F.col("_upto")), F.col(value)))

    total = F.sum("_n")
    return ranked.groupBy(*keys).agg((F.sum(F.col(value) * F.col("_n")) / F.nullif(total, F.lit(0))).alias(mean), total.alias(count), ((at(low) + at(high)) / 2.0).alias(middle))


def limitup_next_returns(prepared: DataFrame, limits: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Return on the next market day of every security that closed limit-up, dated on that next day.

    The successor close rides on the panel row, so the sparse limit rows meet the panel once, on its
    full key; a security that skips the next market day drops out.
    """
    keys = list(keys)
    up = limits.filter("is_limit_up").select(*keys, "ts_code", "trade_date")
    calendar = trading_dates(prepared, keys)
    priced = prepared.select(*keys, "ts_code", "trade_date", "close", "next_close", "next_date").filter((F.col("close") > 0) & F.col("next_close").isNotNull())
    return (
        up.join(priced, [*keys, "ts_code", "trade_date"])
        .join(calendar, [*keys, "trade_date"])
        .filter(F.col("next_date") == F.col("next_market_date"))
        .select(*keys, "ts_code", F.col("next_market_date").alias("trade_date"), (F.col("next_close") / F.col("close") - 1.0).alias("next_return"))
    )


def limitup_next_summary(returns: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    return value_summary(returns, [*keys, "trade_date"], "next_return", "yesterday_limitup_mean_return", "yesterday_limitup_sample_count", "yesterday_limitup_median_return")


def add_profit_effect(
    daily: DataFrame,
    limit_days: DataFrame,
    next_day: DataFrame,
    keys: Sequence[str] = ("market",),
    minimum_coverage: float = 0.90,
    expected: str | None = None,
    degenerate: Degenerate = Degenerate(),
) -> DataFrame:
    """Limit-move rates, leader returns, source status. A day without limit rows is a real zero as long
    as the market has any limit data; a market with none is unavailable throughout."""
    keys = list(keys)
    by = [*keys, "trade_date"]
    has_limits = limit_days.select(*keys).distinct().withColumn("_has_limits", F.lit(True))
    joined = daily.join(limit_days, by, "left").join(next_day, by, "left").join(has_limits, keys, "left")
    have = F.col("_has_limits").isNotNull()
    eligible = F.coalesce(F.col(expected), F.col("eligible_count")) if expected else F.col("eligible_count")
    base = joined.withColumns(
        {
            "observed_eligible_count": F.col("eligible_count"),
            "profit_effect_eligible_count": eligible,
            "limit_up_count": F.when(have, F.coalesce("limit_up_count", F.lit(0))),
            "limit_down_count": F.when(have, F.coalesce("limit_down_count", F.lit(0))),
            **{c: F.when(have, F.coalesce(c, F.lit("REAL_LIST"))).otherwise("DATA_UNAVAILABLE") for c in ("limit_up_source", "limit_down_source")},
            **{c: F.when(have, F.coalesce(c, F.lit("REAL_ZERO"))).otherwise("DATA_UNAVAILABLE") for c in ("limit_up_status", "limit_down_status")},
            "failed_limit_rate": F.lit(None).cast("double"),
            "failed_limit_rate_available": F.lit(False),
        }
    )
    denominator = F.when(F.col("profit_effect_eligible_count") > 0, F.col("profit_effect_eligible_count"))
    real = F.upper("limit_down_status").rlike("^(REAL|LEGACY)")
    known = F.when(real, F.col("profit_effect_eligible_count")).otherwise(0)
    coverage = F.when(have, ratio(known, denominator)).otherwise(0.0)
    flat = degenerate_mask("limit_down_count", keys, 20, 2, 5, degenerate.variance_floor) & (F.count("limit_down_count").over(ordered(keys).rowsBetween(-19, 0)) >= 5)
    quality = quality_label(coverage, minimum_coverage)
    return base.withColumns(
        {
            "limit_up_rate": ratio("limit_up_count", denominator),
            "limit_down_rate": ratio("limit_down_count", denominator),
            "limit_rule_known_count": known,
            "limit_rule_unknown_count": F.col("profit_effect_eligible_count") - known,
            "profit_effect_coverage": coverage,
            "limit_rule_coverage": coverage,
            "_flat": have & flat,
            "_real": real,
            "_quality": quality,
        }
    ).withColumns(
        {
            "limit_down_status": F.when(F.col("_flat") & F.col("_real"), "DEGENERATE").otherwise(F.col("limit_down_status")),
            "profit_effect_quality": F.when(F.col("_flat") & (F.col("_quality") == "VALID"), "DEGRADED").otherwise(F.col("_quality")),
        }
    ).drop("_flat", "_real", "_quality", "_has_limits")


def prepare_index(index_bars: DataFrame, keys: Sequence[str] = ("market", "benchmark")) -> DataFrame:
    """Missing open/high/low fall back to the close; rows without date or close go; first row per day stays."""
    require(index_bars, {"trade_date", "close"}, "index frame")
    filled = index_bars.withColumns({c: F.coalesce(c, "close") if c in index_bars.columns else F.col("close") for c in ("open", "high", "low")})
    filled = filled.filter(F.col("trade_date").isNotNull() & F.col("close").isNotNull())
    return keep_first(filled, [*keys, "trade_date"]) if "row_seq" in index_bars.columns else filled


def add_true_range(index: DataFrame, keys: Sequence[str] = ("market", "benchmark")) -> DataFrame:
    w = ordered(keys)
    previous = F.lag("close").over(w)
    return index.withColumns({"position": F.row_number().over(w) - 1, "previous_close": previous}).withColumn(
        "true_range",
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("previous_close")), F.abs(F.col("low") - F.col("previous_close"))),
    )


def add_stretch(index: DataFrame, windows: Windows = Windows(), keys: Sequence[str] = ("market", "benchmark")) -> DataFrame:
    """Wilder RSI and ATR, distance to the moving average in ATRs, and two trailing returns."""
    ranged = add_true_range(index, keys)
    delta = F.col("close") - F.col("previous_close")
    moved = ranged.withColumns({"_gain": F.greatest(delta, F.when(delta.isNotNull(), 0.0)), "_loss": F.when(delta < 0, -delta).when(delta.isNotNull(), 0.0)})
    smoothed = add_wilder_means(moved, {"_avg_gain": ("_gain", windows.rsi), "_avg_loss": ("_loss", windows.rsi), "atr14": ("true_range", windows.atr)}, "position", keys)
    averaged = smoothed.withColumns(
        {
            "index_ma": rolling(F.avg, "close", windows.index_ma, keys),
            "return5d": F.col("close") / F.nullif(F.lag("close", windows.short_return).over(ordered(keys)), F.lit(0.0)) - 1.0,
            "return20d": F.col("close") / F.nullif(F.lag("close", windows.long_return).over(ordered(keys)), F.lit(0.0)) - 1.0,
        }
    )
    gain, loss = F.col("_avg_gain"), F.col("_avg_loss")
    # A missing average loss compares unequal to zero, so the ratio (NULL) decides.
    rsi = (
        F.when((gain == 0) & (loss == 0), 50.0)
        .when(loss == 0, 100.0)
        .otherwise(100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0))))
    )
    return averaged.withColumns({"rsi14": rsi, "ma20_atr": ratio(F.col("close") - F.col("index_ma"), "atr14")}).drop("_gain", "_loss", "_avg_gain", "_avg_loss")


def stretch_wide(stretch: DataFrame, benchmarks: Sequence[str], keys: Sequence[str] = ("market",)) -> DataFrame:
    """Display form: one column per benchmark and factor."""
    factors = ("rsi14", "ma20_atr", "return5d", "return20d")
    wide = stretch.groupBy(*keys, "trade_date").pivot("benchmark", list(benchmarks)).agg(*[F.first(f).alias(f) for f in factors])
    return wide
