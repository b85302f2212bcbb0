"""Panel to temperature table: one pass over the panel to the daily factor table, then series scoring.

The daily factor table (one row per market and day) is the stage boundary: it is checkpointed, so the
scoring windows and the coverage assessment read it instead of the panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.factors import (
    add_breadth,
    add_liquidity,
    add_profit_effect,
    add_stock_windows,
    add_stretch,
    daily_panel_counts,
    limit_day_counts,
    limitup_next_returns,
    limitup_next_summary,
    prepare_index,
    prepare_limit_panel,
)
from ..operators.panel import prepare_stock_panel
from ..operators.quality import add_integrity_gate, add_quality_grade, assess_market_coverage, coverage_from_counts, dataset_warnings, expected_from_profile, panel_profile
from ..operators.scoring import add_temperature, score_breadth, score_liquidity, score_profit_effect, score_stretch
from ..params import Degenerate, Percentile, Quality, Windows
from ..sources.tables import hand_off


def raw_factors(panel: DataFrame, limits: DataFrame, windows: Windows = Windows(), quality: Quality = Quality(), cfg: Degenerate = Degenerate(), keys: Sequence[str] = ("market",), dedupe: bool = True, profile: DataFrame | None = None) -> DataFrame:
    """Daily factor table: the panel is prepared once and aggregated once for all modules. ``profile`` is that of the panel,
    for callers that use it elsewhere too."""
    prepared = prepare_stock_panel(panel, windows, keys, dedupe)
    counts = daily_panel_counts(add_stock_windows(prepared, windows, keys), keys)
    expected = expected_from_profile(panel_profile(panel, keys) if profile is None else profile, keys)
    coverage = coverage_from_counts(counts, expected, quality, keys).select(
        *keys, "trade_date", "expected_eligible_count", "expected_universe_source", F.col("coverage_ratio").alias("market_coverage_ratio")
    )
    flags = prepare_limit_panel(limits, keys)
    next_day = limitup_next_summary(limitup_next_returns(prepared, flags, keys), keys)
    daily = counts.join(coverage, [*keys, "trade_date"], "left")
    minimum = quality.minimum_coverage
    daily = add_breadth(daily, minimum, "expected_eligible_count")
    daily = add_liquidity(daily, windows, keys, minimum, "expected_eligible_count")
    return add_profit_effect(daily, limit_day_counts(flags, keys), next_day, keys, minimum, "expected_eligible_count", cfg)


def score_factors(raw: DataFrame, stretch: DataFrame, warnings: DataFrame, quality: Quality = Quality(), pct: Percentile = Percentile(), cfg: Degenerate = Degenerate(), keys: Sequence[str] = ("market",)) -> DataFrame:
    """Factor table plus per-benchmark stretch factors to graded temperature."""
    scored = score_liquidity(score_profit_effect(score_breadth(raw, keys, pct, cfg), keys, pct, cfg), keys, pct, cfg)
    merged = scored.join(score_stretch(stretch, keys, pct), [*keys, "trade_date"], "full_outer").join(warnings, list(keys), "left")
    return add_quality_grade(add_integrity_gate(add_temperature(merged), quality, keys), quality)


def market_temperature(
    panel: DataFrame,
    limits: DataFrame,
    index_bars: DataFrame,
    windows: Windows = Windows(),
    quality: Quality = Quality(),
    pct: Percentile = Percentile(),
    cfg: Degenerate = Degenerate(),
    keys: Sequence[str] = ("market",),
    dedupe: bool = True,
) -> DataFrame:
    profile = hand_off(panel_profile(panel, keys))
    raw = hand_off(raw_factors(panel, limits, windows, quality, cfg, keys, dedupe, profile))
    stretch = add_stretch(prepare_index(index_bars, [*keys, "benchmark"]), windows, [*keys, "benchmark"])
    assessment = None
    if quality.production:
        coverage = raw.select(
            *keys, "trade_date", "expected_eligible_count", "observed_universe", F.col("observed_universe").alias("valid_price_count"), F.col("valid_amount_observed").alias("valid_amount_count"), F.col("market_coverage_ratio").alias("coverage_ratio")
        )
        assessment = assess_market_coverage(coverage, panel, quality, keys, profile)
    warnings = dataset_warnings(panel, limits, assessment, quality, keys, profile)
    return score_factors(raw, stretch, warnings, quality, pct, cfg, keys)


def intraday_temperature(
    panel: DataFrame,
    limits: DataFrame,
    index_bars: DataFrame,
    history: DataFrame,
    stretch_history: DataFrame,
    target_date: str,
    windows: Windows = Windows(),
    quality: Quality = Quality(production=True),
    pct: Percentile = Percentile(),
    cfg: Degenerate = Degenerate(),
    keys: Sequence[str] = ("market",),
    dedupe: bool = True,
) -> DataFrame:
    """Score only ``target_date``: raw factors are computed from the recent ``panel``, older ones come
    from the persisted ``history`` tables, and both go through the same scoring as the daily run."""
    day = F.lit(target_date).cast("date")
    profile = hand_off(panel_profile(panel, keys))
    live = raw_factors(panel, limits, windows, quality, cfg, keys, dedupe, profile).filter(F.col("trade_date") == day)
    live_stretch = add_stretch(prepare_index(index_bars, [*keys, "benchmark"]), windows, [*keys, "benchmark"]).filter(F.col("trade_date") == day)
    past = history.filter(F.col("trade_date") < day)
    past_stretch = stretch_history.filter(F.col("trade_date") < day)
    warnings = dataset_warnings(panel, limits, None, quality, keys, profile)
    scored = score_liquidity(
        score_profit_effect(score_breadth(past.unionByName(live, allowMissingColumns=True), keys, pct, cfg), keys, pct, cfg), keys, pct, cfg
    ).filter(F.col("trade_date") == day)
    stretch = score_stretch(past_stretch.unionByName(live_stretch, allowMissingColumns=True), keys, pct).filter(F.col("trade_date") == day)
    merged = scored.join(stretch, [*keys, "trade_date"], "full_outer").join(warnings, list(keys), "left")
    return add_quality_grade(add_integrity_gate(add_temperature(merged), quality, keys), quality)
