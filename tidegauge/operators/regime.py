"""Regime indicators: causal smoothing over valid observations, module deltas, extreme anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import add_valid_ema, flag, valid_extreme, valid_lag
from ..params import MODULES, Variant

SMOOTHING = ("smoothed_temperature", "temperature_shock", "slope1", "slope3", "rolling_high_10", "rolling_low_10", "recovery_from_low", "drop_from_high")


def add_variants(daily: DataFrame, variants: Sequence[Variant]) -> DataFrame:
    """Attach every parameter set to every row as ``variant_id`` and a ``p`` struct.

    The parameter sets are a literal array exploded in place, so the grid multiplies the small daily
    table (never the panel) without a join.
    """
    sets = F.array(
        *[
            F.struct(
                F.lit(v.variant_id).alias("variant_id"),
                F.lit(v.parameter).alias("parameter"),
                F.lit(float(v.value)).alias("value"),
                *[F.lit(x).alias(n) for n, x in v.settings().items()],
            )
            for v in variants
        ]
    )
    out = daily.withColumn("p", F.explode(sets))
    return out.withColumns({"variant_id": F.col("p.variant_id")})


def mark_valid(daily: DataFrame) -> DataFrame:
    """Normalise quality and blank the temperature and modules of invalid days."""
    source = "raw_temperature" if "raw_temperature" in daily.columns else "raw_market_temperature"
    label = "market_temperature_quality" if "market_temperature_quality" in daily.columns else "quality"
    raw = F.col(source).cast("double")
    quality = F.upper(F.col(label)) if label in daily.columns else F.lit("A")
    valid = flag(quality != "INVALID") & raw.isNotNull()
    given = F.col("confidence") if "confidence" in daily.columns else F.when(quality == "A", "HIGH").when(quality == "B", "MEDIUM").when(quality == "C", "LOW")
    scores = {f"{m}_score": F.when(valid, F.col(f"{m}_score").cast("double") if f"{m}_score" in daily.columns else F.lit(None).cast("double")) for m in MODULES}
    return daily.withColumns(
        {
            "raw_temperature": F.when(valid, raw),
            "regime_valid_observation": valid,
            "quality": F.when(valid, quality).otherwise("INVALID"),
            "confidence": F.when(valid, given).otherwise("NONE"),
            **scores,
        }
    )


def add_smoothing(df: DataFrame, keys: Sequence[str], span: int | Column = 3, slope_lookback: int = 3, turning_window: int = 10, raw: str = "raw_temperature") -> DataFrame:
    smoothed = add_valid_ema(df, "smoothed_temperature", raw, keys, span)
    ema = F.col("smoothed_temperature")
    ranged = smoothed.withColumns(
        {
            "temperature_shock": F.col(raw) - ema,
            "slope1": ema - valid_lag(ema, keys, 1),
            "slope3": ema - valid_lag(ema, keys, slope_lookback),
            "rolling_high_10": valid_extreme(ema, keys, turning_window, True),
            "rolling_low_10": valid_extreme(ema, keys, turning_window, False),
        }
    )
    return ranged.withColumns({"recovery_from_low": ema - F.col("rolling_low_10"), "drop_from_high": F.col("rolling_high_10") - ema})


def add_module_deltas(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change of each module against its own third last valid value; a module that is missing on an
    otherwise valid day is skipped for that module only."""
    deltas = df.withColumns({f"{m}_delta3": F.col(f"{m}_score") - valid_lag(f"{m}_score", keys, 3) for m in MODULES})

    def agree(test) -> Column:
        total = F.lit(0)
        for m in MODULES:
            total = total + flag(test(F.col(f"{m}_delta3"))).cast("int")
        return F.when(F.col("regime_valid_observation"), total).otherwise(0)

    return deltas.withColumns({"improving_modules": agree(lambda c: c > 0), "deteriorating_modules": agree(lambda c: c < 0)})


def add_anchor_flags(df: DataFrame, p: str = "p") -> DataFrame:
    """Current-day panic/euphoria anchors from the thresholds in the ``p`` struct."""
    t = lambda name: F.col(f"{p}.{name}")
    usable = F.col("regime_valid_observation") & F.col("raw_temperature").isNotNull() & F.col("smoothed_temperature").isNotNull()

    def extremes(test) -> Column:
        total = F.lit(0)
        for m in MODULES:
            total = total + flag(test(F.col(f"{m}_score"))).cast("int")
        return F.when(usable, total).otherwise(0)

    counted = df.withColumns(
        {
            "panic_module_count": extremes(lambda c: c <= t("module_panic_threshold")),
            "euphoria_module_count": extremes(lambda c: c >= t("module_euphoria_threshold")),
        }
    )
    enough = t("minimum_extreme_modules")
    marked = counted.withColumns(
        {
            "raw_panic_anchor": flag((F.col("raw_temperature") <= t("raw_panic_threshold")) & (F.col("panic_module_count") >= enough)) & usable,
            "smoothed_panic_anchor": flag(F.col("smoothed_temperature") <= t("smoothed_panic_threshold")) & usable,
            "raw_euphoria_anchor": flag((F.col("raw_temperature") >= t("raw_euphoria_threshold")) & (F.col("euphoria_module_count") >= enough)) & usable,
            "smoothed_euphoria_anchor": flag(F.col("smoothed_temperature") >= t("smoothed_euphoria_threshold")) & usable,
        }
    )
    return marked.withColumns(
        {
            "panic_anchor_event": F.col("raw_panic_anchor") | F.col("smoothed_panic_anchor"),
            "euphoria_anchor_event": F.col("raw_euphoria_anchor") | F.col("smoothed_euphoria_anchor"),
        }
    )


def regime_indicators(daily: DataFrame, variants: Sequence[Variant] | None = None, keys: Sequence[str] = ("market",)) -> DataFrame:
    """All numeric inputs of the state machine, for one or many parameter sets in one pass.

    Window frames need literal lengths, so parameter sets are grouped by their frame lengths and each
    distinct length pair is one branch of a union; thresholds and EMA spans ride along as columns.
    """
    variants = list(variants or [Variant()])
    marked = mark_valid(daily)
    by = [*keys, "variant_id"]
    frames: dict[tuple[int, int], list[Variant]] = {}
    for v in variants:
        frames.setdefault((v.machine.slope_lookback, v.machine.turning_window), []).append(v)
    out: DataFrame | None = None
    for (lookback, turning), group in frames.items():
        wide = add_variants(marked, group)
        spans = {v.machine.ema_span for v in group}
        span = group[0].machine.ema_span if len(spans) == 1 else F.col("p.ema_span")
        part = add_smoothing(wide, by, span, lookback, turning)
        out = part if out is None else out.unionByName(part)
    return add_anchor_flags(add_module_deltas(out, by))
