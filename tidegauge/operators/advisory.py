"""Advisory layer: state table to a human-facing daily reference, all as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import changed_from_previous, count_true, flag, ordered, running
from ..functions.text import decimals
from ..params import Anchors
from . import advisory_text as tx

PANIC_FAMILY = ("PANIC_FALLING", "EXTREME_PANIC", "ICE_REVERSAL_WATCH", "ICE_REVERSAL")
HOT_FAMILY = ("HOT", "EUPHORIA_RISING", "HOT_ROLLOVER_WATCH", "HOT_ROLLOVER")
ICE_DIRECTION = PANIC_FAMILY


def state_dimension(spark: SparkSession) -> DataFrame:
    """Eleven fixed rows, one per state."""
    return spark.createDataFrame(list(tx.STATE_TEXT), ", ".join(f"{f} string" for f in tx.FIELDS))


def add_context(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Run lengths and "was extreme" memory from earlier rows only.

    A flag that resets after certain rows is a running maximum inside islands that start after them.
    """
    valid = flag(F.col("state") != "DATA_INVALID") & F.col("raw_temperature").isNotNull() & F.col("smoothed_temperature").isNotNull()
    raw, smooth = F.col("raw_temperature"), F.col("smoothed_temperature")
    w = ordered(keys)
    base = states.withColumns(
        {
            "_valid": valid,
            "_panic": valid & (flag(F.col("recent_panic_episode")) | flag(raw <= 20) | flag(smooth <= 20)),
            "_hot": valid & (flag(F.col("recent_euphoria_episode")) | flag(raw >= 85) | flag(smooth >= 80)),
            "_panic_reset": ~(valid & F.col("state").isin(*PANIC_FAMILY)),
            "_hot_reset": ~(valid & F.col("state").isin(*HOT_FAMILY)),
        }
    )
    after = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False)).cast("int")
    islands = base.withColumns(
        {
            "_new_run": (changed_from_previous("state", keys) | ~F.coalesce(F.lag("_valid").over(w), F.lit(False))).cast("int"),
            "_after_panic": after("_panic_reset"),
            "_after_hot": after("_hot_reset"),
        }
    )
    upto = running(keys)
    islands = islands.withColumns({"_run": F.sum("_new_run").over(upto), "_pi": F.sum("_after_panic").over(upto), "_hi": F.sum("_after_hot").over(upto)})
    inside = lambda island: running([*keys, island])
    days = F.when(F.col("_valid"), F.row_number().over(ordered([*keys, "_run"]))).otherwise(0)
    counted = islands.withColumns({"state_days": days, "panic_was_extreme": F.max("_panic").over(inside("_pi")), "euphoria_was_extreme": F.max("_hot").over(inside("_hi"))})
    return counted.withColumns(
        {"ice_days": F.when(F.col("state") == "ICE_REVERSAL", F.col("state_days")).otherwise(0), "hot_days": F.when(F.col("state") == "HOT_ROLLOVER", F.col("state_days")).otherwise(0)}
    ).drop("_valid", "_panic", "_hot", "_panic_reset", "_hot_reset", "_new_run", "_after_panic", "_after_hot", "_run", "_pi", "_hi")


def _module_names(positive: bool) -> Column:
    test = lambda m: F.col(f"{m}_delta3") > 0 if positive else F.col(f"{m}_delta3") < 0
    return F.array_compact(F.array(*[F.when(test(m), F.lit(label)) for m, label in tx.MODULE_LABELS]))


def add_confirmation(df: DataFrame) -> DataFrame:
    """Modules that confirm the state's direction; the plain count steps in when no names are known."""
    ice = F.col("state").isin(*ICE_DIRECTION)
    named = df.withColumn("_names", F.when(ice, _module_names(True)).otherwise(_module_names(False)))
    fallback = F.least(F.greatest(F.coalesce(F.when(ice, F.col("improving_modules")).otherwise(F.col("deteriorating_modules")), F.lit(0)), F.lit(0)), F.lit(4))
    return named.withColumns({"confirming_modules": F.when(F.size("_names") > 0, F.size("_names")).otherwise(fallback), "confirming_module_names": F.array_join("_names", ";")}).drop("_names")


def add_strength(df: DataFrame) -> DataFrame:
    """The hard-to-trigger strong confirmation and the buy/sell reference levels."""
    both = lambda up: (F.col("breadth_delta3") > 0) & (F.col("profit_effect_delta3") > 0) if up else (F.col("breadth_delta3") < 0) & (F.col("profit_effect_delta3") < 0)
    enough = F.col("confirming_modules") >= 3
    strong_ice = (F.col("state") == "ICE_REVERSAL") & (F.col("ice_days") >= 3) & F.col("panic_was_extreme") & both(True) & (F.col("slope3") > 0) & enough
    strong_hot = (F.col("state") == "HOT_ROLLOVER") & (F.col("hot_days") >= 3) & F.col("euphoria_was_extreme") & both(False) & (F.col("slope3") < 0) & enough
    strong = flag(strong_ice) | flag(strong_hot)
    level = F.when(F.col("strong_confirmation"), "HIGH").otherwise("MEDIUM")
    return df.withColumn("strong_confirmation", strong).withColumns(
        {
            "buy_reference": F.when(F.col("state").isin("ICE_REVERSAL_WATCH", "ICE_REVERSAL"), level).otherwise("LOW"),
            "sell_reference": F.when(F.col("state").isin("HOT_ROLLOVER_WATCH", "HOT_ROLLOVER"), level).otherwise("LOW"),
        }
    )


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def add_confidence(df: DataFrame) -> DataFrame:
    """Clarity of the state identification from five transparent components."""
    q = F.upper("quality")
    invalid = flag(q == "INVALID")
    if "data_quality_status" in df.columns:
        invalid = invalid | flag(F.upper("data_quality_status") == "INVALID")
    quality = F.when(invalid, 0.0).when(q == "A", 1.0).when(q == "B", 0.72).otherwise(0.45)
    modules = F.least(F.greatest(F.col("confirming_modules"), F.lit(0)), F.lit(4))
    smooth = F.coalesce("smoothed_temperature", "raw_temperature")
    st = F.col("state")
    recovery = F.coalesce("recovery_from_post_panic_low", "recovery_from_low", F.lit(0.0))
    distance = (
        F.when((st == "DATA_INVALID") | smooth.isNull(), 0.0)
        .when(st.isin("PANIC_FALLING", "EXTREME_PANIC", "COLD"), _clip((40.0 - smooth) / 40.0))
        .when(st.isin(*HOT_FAMILY), _clip((smooth - 60.0) / 40.0))
        .when(st.isin("ICE_REVERSAL_WATCH", "ICE_REVERSAL"), _clip(recovery / 20.0))
        .otherwise(0.65)
    )
    parts = df.withColumns(
        {
            "c_quality": quality,
            "c_agreement": 0.55 + 0.45 * (modules / 4.0),
            "c_distance": distance,
            "c_slope": F.coalesce(_clip(F.abs("slope3") / 8.0), F.lit(0.0)),
            "c_persistence": _clip(F.col("state_days") / 3.0),
        }
    )
    score = 0.30 * F.col("c_quality") + 0.25 * F.col("c_agreement") + 0.20 * F.col("c_distance") + 0.15 * F.col("c_slope") + 0.10 * F.col("c_persistence")
    return parts.withColumn("confidence_score", score).withColumn(
        "signal_confidence", F.when(F.col("c_quality") <= 0, "LOW").when(F.col("confidence_score") >= 0.70, "HIGH").when(F.col("confidence_score") >= 0.45, "MEDIUM").otherwise("LOW")
    )


def reason_codes(df: DataFrame, anchors: Anchors = Anchors()) -> Column:
    """Ordered, de-duplicated codes: episodes, thresholds, modules, slope, watch/confirm, known warnings."""
    st, raw, smooth, slope = F.col("state"), F.col("raw_temperature"), F.col("smoothed_temperature"), F.col("slope3")
    panic, hot = flag(F.col("recent_panic_episode")), flag(F.col("recent_euphoria_episode"))
    codes = [
        F.when(panic, "PANIC_EPISODE_ACTIVE").when(st.isin(*PANIC_FAMILY), "PANIC_EPISODE_RECENT"),
        F.when(hot, "EUPHORIA_EPISODE_ACTIVE").when(st.isin("EUPHORIA_RISING", "HOT_ROLLOVER_WATCH", "HOT_ROLLOVER"), "EUPHORIA_EPISODE_RECENT"),
        F.when(raw <= anchors.raw_panic_threshold, "RAW_TEMPERATURE_EXTREME_LOW"),
        F.when(raw >= anchors.raw_euphoria_threshold, "RAW_TEMPERATURE_EXTREME_HIGH"),
        F.when(smooth <= anchors.smoothed_panic_threshold, "EMA_EXTREME_LOW"),
        F.when(smooth >= anchors.smoothed_euphoria_threshold, "EMA_EXTREME_HIGH"),
    ]
    for m, _ in tx.MODULE_LABELS:
        score, delta, label = F.col(f"{m}_score"), F.col(f"{m}_delta3"), m.upper()
        codes.append(F.when(score <= 20, f"{label}_EXTREME_LOW").when(score >= 80, f"{label}_EXTREME_HIGH"))
        codes.append(F.when(delta > 0, f"{label}_RECOVERING").when(delta < 0, f"{label}_DETERIORATING"))
    codes.append(F.when(slope > 0, "EMA_RECOVERING").when(slope < 0, "EMA_DETERIORATING"))
    codes.append(F.when(st == "ICE_REVERSAL_WATCH", "ICE_WATCH").when(st == "ICE_REVERSAL", "ICE_CONFIRMED").when(st == "HOT_ROLLOVER_WATCH", "HOT_WATCH").when(st == "HOT_ROLLOVER", "HOT_CONFIRMED"))
    given = [F.col(c) for c in ("data_quality_warnings", "integrity_warnings", "warnings") if c in df.columns]
    words = F.transform(F.split(F.translate(F.concat_ws(";", *given), ",", ";"), ";"), lambda x: F.upper(F.trim(x)))
    known = F.filter(words, lambda x: x.isin(*tx.KNOWN_WARNINGS))
    missing_column = next((c for c in ("market_temperature_missing_factors", "missing_factors") if c in df.columns), None)
    missing = F.lower(F.coalesce(F.col(missing_column), F.lit(""))) if missing_column else F.lit("")
    absent = F.array_compact(
        F.array(*[F.when(missing.contains(k), F.lit(c)) for k, c in (("options_score", "OPTIONS_UNAVAILABLE"), ("margin_buy_ratio", "MARGIN_OPTIONAL"), ("failed_limit_rate", "FAILED_LIMIT_RATE_UNAVAILABLE"))])
    )
    return F.when(st == "DATA_INVALID", F.array(F.lit("DATA_INVALID"))).otherwise(F.array_distinct(F.concat(F.array_compact(F.array(*codes)), known, absent)))


def _one_decimal(c: str) -> Column:
    return F.coalesce(decimals(c, 1), F.lit("N/A"))


def what_changed() -> Column:
    part = lambda label, up: F.when(F.size(_module_names(up)) > 0, F.concat(F.lit(label), F.array_join(_module_names(up), tx.JOIN)))
    slope = F.when(F.col("slope3") > 0, tx.SLOPE_UP).when(F.col("slope3") < 0, tx.SLOPE_DOWN).when(F.col("slope3").isNotNull(), tx.SLOPE_FLAT)
    text = F.concat_ws(tx.FRAGMENT_JOIN, part(tx.IMPROVING, True), part(tx.WEAKENING, False), slope)
    return F.when(text == "", tx.NO_DIRECTION).otherwise(text)


def _fill(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def advisory_frame(states: DataFrame, keys: Sequence[str] = ("market",), anchors: Anchors = Anchors()) -> DataFrame:
    """One advisory record per day. The only join is against the eleven-row state dimension."""
    spark = states.sparkSession
    built = add_confidence(add_strength(add_confirmation(add_context(states, keys))))
    built = built.withColumns({"_codes": reason_codes(states, anchors), "what_changed": what_changed(), "_raw": _one_decimal("raw_temperature"), "_smooth": _one_decimal("smoothed_temperature")})
    joined = built.join(F.broadcast(state_dimension(spark)), "state", "left")
    values = {"raw": F.col("_raw"), "smooth": F.col("_smooth"), "changed": F.col("what_changed")}
    texts = joined.withColumns({"why": _fill(F.col("why_template"), values), "current_condition": _fill(F.lit(tx.CURRENT_TEMPLATE), values)})
    details = F.to_json(
        F.struct(
            F.col("advisory_signal").alias("advisory"), "current_condition", F.lit(tx.DISCLAIMER).alias("decision_support_disclaimer"), "what_changed", F.col("meaning").alias("what_it_means"), "what_to_watch_next", "why"
        )
    )
    st = F.col("state")
    extra = [k for k in keys if k != "market"]
    return texts.select(
        "market", *extra,
        F.col("trade_date").alias("date"), "trade_date",
        F.col("raw_temperature").alias("market_temperature"), "smoothed_temperature", F.col("raw_temperature").alias("temperature"), F.col("smoothed_temperature").alias("ema_temperature"),
        "state", F.col("signal").alias("state_signal"), "advisory_signal", "buy_reference", "sell_reference", "risk_level", "expected_horizon", "reference_horizon",
        "signal_confidence", F.col("signal_confidence").alias("confidence"), "confidence_score", "research_evidence", F.col("confirming_modules").cast("bigint").alias("confirming_modules"), "confirming_module_names",
        F.array_join("_codes", ";").alias("reason_codes"), "headline", "summary", "why", "what_to_watch_next", F.col("summary").alias("human_explanation"), details.alias("details"),
        "current_condition", "what_changed", F.col("meaning").alias("what_it_means"),
        "advisory_regime", "short_term_evidence", "medium_term_evidence",
        st.isin("ICE_REVERSAL_WATCH", "ICE_REVERSAL").alias("short_term_warning"), st.isin("HOT_ROLLOVER_WATCH", "HOT_ROLLOVER").alias("not_exact_top"), st.isin("ICE_REVERSAL", "HOT_ROLLOVER").alias("active_advisory_window"),
        "state_days", "ice_days", "hot_days", "panic_was_extreme", "euphoria_was_extreme", "strong_confirmation", "c_quality", "c_agreement", "c_distance", "c_slope", "c_persistence",
    )


HISTORY = (
    "date", "temperature", "ema_temperature", "market_temperature", "smoothed_temperature", "state", "signal", "advisory_regime", "advisory_signal", "buy_reference", "sell_reference", "risk_level",
    "expected_horizon", "reference_horizon", "signal_confidence", "research_evidence", "confirming_modules", "headline", "reason_codes", "short_term_evidence", "medium_term_evidence", "short_term_warning", "not_exact_top",
)


def advisory_history(advisory: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    return advisory.withColumn("signal", F.col("state_signal")).select(*keys, *HISTORY)


def select_advisory(advisory: DataFrame, date: str | None = None, start: str | None = None, end: str | None = None, keys: Sequence[str] = ("market",)) -> DataFrame:
    """The requested day, or the newest valid day of the range (newest of any kind if none is valid)."""
    out = advisory
    if start:
        out = out.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    if date:
        return out.filter(F.col("trade_date") == F.lit(date).cast("date"))
    rest = [c for c in advisory.columns if c not in keys]
    order = F.struct((F.col("advisory_signal") != "DATA_INVALID").alias("v"), F.col("trade_date"))
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def audit_checks(advisory: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """State-to-signal consistency, the invalid-day gate and vocabulary membership, per market."""
    expected = F.create_map(*[F.lit(x) for row in tx.STATE_TEXT for x in (row[0], row[1])])
    s = F.col("advisory_signal")
    hot = F.col("state").isin(*HOT_FAMILY)
    filled = F.lit(True)
    for c in ("headline", "why", "what_to_watch_next", "buy_reference", "sell_reference", "risk_level", "expected_horizon", "signal_confidence", "research_evidence"):
        filled = filled & flag(F.trim(c) != "")
    return advisory.groupBy(*keys).agg(
        F.bool_and(s.eqNullSafe(expected[F.col("state")])).alias("state_signal_consistent"),
        F.coalesce(F.bool_and(F.when(hot, s.eqNullSafe(expected[F.col("state")]))), F.lit(False)).alias("hot_rollover_semantics"),
        (F.coalesce(F.bool_and(F.when(F.col("state") == "DATA_INVALID", s == "DATA_INVALID")), F.lit(False))).alias("data_invalid_hard_gate"),
        F.bool_and(flag(s.isin(*tx.ADVISORY_SIGNALS))).alias("vocabulary_ok"),
        (count_true(F.col("reason_codes").contains("DATA_QUALITY_WARNING")) == 0).alias("warning_semantics_clear"),
        F.bool_and(filled).alias("card_complete"),
    )
