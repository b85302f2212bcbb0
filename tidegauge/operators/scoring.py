"""Percentile scores, missing-aware weighted composites and the module scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import degenerate_mask, mid_rank_percentile, running
from ..params import BREADTH_WEIGHTS, LIQUIDITY_WEIGHTS, MODULE_WEIGHTS, PROFIT_WEIGHTS, STRETCH_WEIGHTS, Degenerate, Percentile


def _sum(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def weighted_score(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of score times weight, renormalised over the scores that are present; NULL if none is."""
    used = [(scores[n], float(w)) for n, w in weights.items() if w > 0]
    if not used:
        return F.lit(None).cast("double")
    available = _sum([F.when(s.isNotNull(), w).otherwise(0.0) for s, w in used])
    total = F.nullif(available, F.lit(0.0))
    parts = [F.when(s.isNotNull(), s * (F.lit(w) / total)).otherwise(0.0) for s, w in used]
    return F.when(available > 0, _sum(parts))


def missing_names(scores: Mapping[str, Column]) -> Column:
    return F.concat_ws(",", *[F.when(s.isNull(), F.lit(n)) for n, s in scores.items()])


def effective_weights(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Map of the renormalised weights; ``to_json`` it at the edge."""
    available = _sum([F.when(scores[n].isNotNull(), max(float(w), 0.0)).otherwise(0.0) for n, w in weights.items()])
    total = F.nullif(available, F.lit(0.0))
    pairs: list[Column] = []
    for n in sorted(weights):
        w = max(float(weights[n]), 0.0)
        pairs += [F.lit(n), F.coalesce(F.when(scores[n].isNotNull(), F.lit(w) / total), F.lit(0.0))]
    return F.create_map(*pairs)


def add_composite(df: DataFrame, weights: Mapping[str, float], score: str, prefix: str | None = None, scores: Mapping[str, Column] | None = None) -> DataFrame:
    prefix = prefix or score
    scores = dict(scores or {n: (F.col(n) if n in df.columns else F.lit(None).cast("double")) for n in weights})
    return df.withColumns({score: weighted_score(scores, weights), f"{prefix}_missing_factors": missing_names(scores), f"{prefix}_effective_weights": effective_weights(scores, weights)})


def mask_degenerate(df: DataFrame, pairs: Mapping[str, str], label: str, keys: Sequence[str], cfg: Degenerate = Degenerate()) -> DataFrame:
    """NULL each score (value) whose raw factor (key) is degenerate and list those factors in ``label``."""
    flags = {f"_flat_{raw}": degenerate_mask(raw, keys, cfg.window, cfg.max_unique, cfg.minimum_valid, cfg.variance_floor) for raw in pairs}
    out = df.withColumns(flags)
    out = out.withColumns({score: F.when(~F.col(f"_flat_{raw}"), F.col(score)) for raw, score in pairs.items()})
    return out.withColumn(label, F.concat_ws(",", *[F.when(F.col(f"_flat_{raw}"), F.lit(raw)) for raw in pairs])).drop(*flags)


def _score_module(df: DataFrame, raw: Mapping[str, str], weights: Mapping[str, float], module: str, keys: Sequence[str], pct: Percentile, cfg: Degenerate, bearish: Sequence[str] = (), masked: Sequence[str] | None = None) -> DataFrame:
    """``raw`` maps factor name to raw column. Scores live in ``s_<factor>`` columns."""
    out = df.withColumns({f"s_{f}": mid_rank_percentile(c, keys, pct.lookback, pct.min_periods, f in bearish) for f, c in raw.items()})
    masked = list(raw) if masked is None else list(masked)
    out = mask_degenerate(out, {raw[f]: f"s_{f}" for f in masked}, f"{module}_degenerate_factors", keys, cfg)
    return add_composite(out, weights, f"{module}_score", module, {f: F.col(f"s_{f}") for f in weights})


def score_breadth(df: DataFrame, keys: Sequence[str] = ("market",), pct: Percentile = Percentile(), cfg: Degenerate = Degenerate(), weights: Mapping[str, float] = BREADTH_WEIGHTS) -> DataFrame:
    return _score_module(df, {f: f for f in BREADTH_WEIGHTS}, weights, "breadth", keys, pct, cfg)


def score_profit_effect(df: DataFrame, keys: Sequence[str] = ("market",), pct: Percentile = Percentile(), cfg: Degenerate = Degenerate(), weights: Mapping[str, float] = PROFIT_WEIGHTS) -> DataFrame:
    return _score_module(df, {f: f for f in PROFIT_WEIGHTS}, weights, "profit_effect", keys, pct, cfg, bearish=("limit_down_rate", "failed_limit_rate"))


def score_liquidity(df: DataFrame, keys: Sequence[str] = ("market",), pct: Percentile = Percentile(), cfg: Degenerate = Degenerate(), weights: Mapping[str, float] = LIQUIDITY_WEIGHTS) -> DataFrame:
    """Only the signed intensity can be masked as degenerate; the turnover percentile never is."""
    raw = {"turnover_percentile": "total_market_turnover", "signed_turnover_intensity": "signed_turnover_intensity"}
    return _score_module(df, raw, weights, "liquidity", keys, pct, cfg, masked=("signed_turnover_intensity",))


def score_stretch(stretch: DataFrame, keys: Sequence[str] = ("market",), pct: Percentile = Percentile(), weights: Mapping[str, float] = STRETCH_WEIGHTS) -> DataFrame:
    """Percentile per benchmark and factor, averaged over benchmarks, then combined."""
    series = [*keys, "benchmark"]
    scored = stretch.select(*series, "trade_date", *[mid_rank_percentile(f, series, pct.lookback, pct.min_periods).alias(f) for f in STRETCH_WEIGHTS])
    averaged = scored.groupBy(*keys, "trade_date").agg(*[F.avg(f).alias(f"s_{f}") for f in STRETCH_WEIGHTS])
    out = add_composite(averaged, weights, "stretch_score", "stretch", {f: F.col(f"s_{f}") for f in weights})
    return out.withColumn("stretch_quality", F.when(F.col("stretch_score").isNotNull(), "VALID").otherwise("INVALID"))


def add_temperature(df: DataFrame, weights: Mapping[str, float] = MODULE_WEIGHTS) -> DataFrame:
    """Weighted temperature over the available modules, with the missing-factor summary."""
    out = df if "options_score" in df.columns else df.withColumn("options_score", F.lit(None).cast("double"))
    out = add_composite(out, weights, "raw_market_temperature", "market_temperature")
    gaps = [F.when(F.col(f"{m}_score").isNull(), F.lit(f"{m}_score")) for m in ("breadth", "profit_effect", "liquidity", "stretch")]
    return out.withColumns(
        {
            "available_factors": F.lit("breadth,profit_effect,liquidity,stretch"),
            "missing_factors": F.concat_ws(",", F.lit("options,failed_limit_rate,margin_buy_ratio"), *gaps),
        }
    )


def distribution(df: DataFrame, value: str, keys: Sequence[str] = ("market",)) -> DataFrame:
    quantiles = F.percentile(F.col(value), F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), quantiles.alias("_q"), F.max(value).alias("max")
    ).select(*keys, "n", "mean", "std", "min", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p5", "p25", "median", "p75", "p95"))], "max")


def version_summary(daily: DataFrame, version: str, keys: Sequence[str] = ("market",)) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.lit(version).alias("version"),
        F.max("symbol_count").alias("max_symbols"),
        F.count_if(F.col("market_temperature_quality") == "INVALID").alias("invalid_days"),
        F.count_if(F.col("limit_down_count") > 0).alias("nonzero_limit_down_days"),
    )


def nearest_date(df: DataFrame, targets: Sequence[str], columns: Sequence[str], keys: Sequence[str] = ("market",)) -> DataFrame:
    """For each target day the row closest in calendar distance (earlier row on a tie)."""
    grid = df.select(*keys, "trade_date", *columns, F.explode(F.array(*[F.lit(t).cast("date") for t in targets])).alias("target_date"))
    distance = F.struct(F.abs(F.date_diff("trade_date", "target_date")), F.col("trade_date"))
    return grid.groupBy(*keys, "target_date").agg(F.min_by(F.struct("trade_date", *columns), distance).alias("r")).select(*keys, "target_date", "r.*")


def rebased(index: DataFrame, start: str, end: str, keys: Sequence[str] = ("market", "benchmark")) -> DataFrame:
    """Close as a percentage of the first close in the range."""
    ranged = index.filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    first = F.first("close").over(running(keys))
    return ranged.withColumn("rebased", F.col("close") / first * 100.0)


def in_period(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    return df


def latest(df: DataFrame, keys: Sequence[str] = ("market",), valid: Column | None = None) -> DataFrame:
    """Newest row per key, optionally the newest that satisfies ``valid``."""
    rest = [c for c in df.columns if c not in keys]
    source = df if valid is None else df.filter(valid)
    return source.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trade_date").alias("r")).select(*keys, "r.*").select(*df.columns)
