"""Validation, coverage audit, expected universe, integrity gate and quality grade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import before, count_true, flag, ordered, ratio, running
from ..functions.text import decimals
from ..params import Quality
from .panel import keep_last, valid_price

RATIO_COLUMNS = (
    "adv_ratio",
    "above_ma20_ratio",
    "above_ma60_ratio",
    "limit_up_rate",
    "limit_down_rate",
    "failed_limit_rate",
    "breadth_coverage",
    "profit_effect_coverage",
    "liquidity_coverage",
)


class DataValidationError(ValueError):
    """Strict validation found a blocking issue."""


class InsufficientMarketCoverage(RuntimeError):
    """The latest day covers too little of the market to score."""


class UnavailableMarketFactor(RuntimeError):
    """A required input is only approximate."""


def validate_timeseries(df: DataFrame, keys: Sequence[str] = ("market",), code: str = "ts_code", outlier_return: float = 0.80, date_column: str = "trade_date") -> DataFrame:
    """Issue rows ``(code, message, rows, severity)`` per market.

    Row checks are one conditional aggregation. Duplicates and return outliers work on a table of one row
    per security and day (copies merge before the shuffle), so a security with a huge number of copies
    never lands whole in one window; an outlier compares with the previous day of the same security.
    """
    keys = list(keys)
    newest = F.max_by("close", "row_seq") if "row_seq" in df.columns else F.max("close")
    per_day = df.groupBy(*keys, code, date_column).agg(F.count("*").alias("_copies"), newest.alias("close"))
    w = Window.partitionBy(*keys, code, F.col(date_column).isNull()).orderBy(date_column)
    stepped = per_day.withColumn("_previous", F.when(F.col(date_column).isNotNull(), F.lag("close").over(w)))
    prices = [c for c in ("open", "high", "low", "close") if c in df.columns]
    bad_price = {c: count_true(flag(F.col(c) <= 0) | F.col(c).isNull()) for c in prices}
    jump = F.abs(F.col("close") / F.nullif(F.col("_previous"), F.lit(0.0)) - 1.0) > outlier_return
    checks: list[tuple[str, str, str, Column]] = [("INVALID_DATES", "Some trade dates cannot be parsed", "error", count_true(F.col(date_column).isNull()))]
    checks += [("IMPOSSIBLE_PRICES", f"Invalid values in {c}", "error", bad_price[c]) for c in prices]
    if {"high", "low"} <= set(df.columns):
        checks.append(("INCONSISTENT_PRICE_RANGE", "High price is below low price", "error", count_true(F.col("high") < F.col("low"))))
        checks.append(("CLOSE_OUTSIDE_RANGE", "Close price is above high", "error", count_true(F.col("close") > F.col("high"))))
        checks.append(("CLOSE_OUTSIDE_RANGE", "Close price is below low", "error", count_true(F.col("close") < F.col("low"))))
    if "volume" in df.columns:
        checks.append(("NEGATIVE_VOLUME", "Negative values in volume", "error", count_true(F.col("volume") < 0)))

    counted = df.groupBy(*keys).agg(*[c.alias(f"_n{i}") for i, (*_, c) in enumerate(checks)])
    by_day = stepped.groupBy(*keys).agg(F.sum(F.col("_copies") - 1).alias("d"), count_true(jump).alias("o"))
    named = F.array(
        F.struct(F.lit("DUPLICATE_DATES").alias("code"), F.lit("Duplicate trade dates found").alias("message"), F.col("d").alias("rows"), F.lit("error").alias("severity")),
        F.struct(F.lit("OUTLIER_RETURNS").alias("code"), F.lit(f"Absolute close-to-close returns exceed {outlier_return:.0%}").alias("message"), F.col("o").alias("rows"), F.lit("warning").alias("severity")),
    )
    series_issues = by_day.select(*keys, F.explode(named).alias("issue")).select(*keys, "issue.*")
    issue = F.explode(
        F.array(*[F.struct(F.lit(k).alias("code"), F.lit(m).alias("message"), F.col(f"_n{i}").alias("rows"), F.lit(s).alias("severity")) for i, (k, m, s, _) in enumerate(checks)])
    )
    return counted.select(*keys, issue.alias("issue")).select(*keys, "issue.*").unionByName(series_issues).filter("rows > 0")


def validate_strict(issues: DataFrame) -> None:
    """Raise when any issue is an error; only the distinct error codes reach the driver."""
    codes = [r["code"] for r in issues.filter("severity = 'error'").select("code").distinct().orderBy("code").collect()]
    if codes:
        raise DataValidationError("; ".join(codes))


def missing_members(expected: DataFrame, present: DataFrame, keys: Sequence[str] = ("market",), code: str = "ts_code") -> DataFrame:
    """Expected universe members without a row in the snapshot, counted per market."""
    absent = expected.select(*keys, code).distinct().join(present.select(*keys, code).distinct(), [*keys, code], "left_anti")
    return absent.groupBy(*keys).agg(F.count("*").alias("rows")).select(
        *keys, F.lit("MISSING_UNIVERSE_MEMBERS").alias("code"), F.format_string("%d expected universe members are absent", "rows").alias("message"), "rows", F.lit("warning").alias("severity")
    )


def panel_profile(panel: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """A row per security and a row per trading day (``is_day``), from one reading of the panel by grouping sets.

    It holds what the expected universe, the coverage assessment and the standing warnings ask of the raw panel. Partials
    merge map-side, so the shuffle carries a row per security and day and input partition; the table has as many rows as
    there are securities and days, and may be handed off where several readers want it. Columns that the panel lacks count
    as null.
    """
    keys = list(keys)
    known = F.col("trade_date").isNotNull() & F.col("ts_code").isNotNull()
    given = lambda name, kind: F.col(name).alias(f"_{name}") if name in panel.columns else F.lit(None).cast(kind).alias(f"_{name}")
    narrow = panel.select(
        *keys, "ts_code", "trade_date", F.when(known, F.col("trade_date")).alias("_day"),
        given("list_date", "date"), given("delist_date", "date"), given("is_st", "int"), given("universe_count", "bigint"),
    )
    dated = lambda name: F.when(F.col(name).isNotNull(), F.col("_day"))
    grouped = narrow.groupingSets([[*keys, "ts_code"], [*keys, "trade_date"]], *keys, "ts_code", "trade_date").agg(
        F.grouping("ts_code").cast("int").alias("is_day"),
        F.min("_day").alias("first_seen"),
        F.min_by("_list_date", dated("_list_date")).alias("list_date"),
        F.min_by("_delist_date", dated("_delist_date")).alias("delist_date"),
        F.max(F.when(F.col("_day").isNotNull(), F.col("_universe_count"))).cast("bigint").alias("declared"),
        F.count("_list_date").alias("listed_rows"),
        F.count("_delist_date").alias("delisted_rows"),
        F.count("_is_st").alias("st_rows"),
    )
    return grouped.select(*keys, "is_day", F.col("first_seen"), *[F.when(F.col("is_day") == 0, F.col(c)).alias(c) for c in ("list_date", "delist_date", "listed_rows", "delisted_rows", "st_rows")], F.when(F.col("is_day") == 1, F.col("declared")).alias("declared"))


def expected_universe_daily(panel: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    return expected_from_profile(panel_profile(panel, keys), keys)


def expected_from_profile(profile: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """As-of count of listed securities per trading day.

    Each security contributes +1 on the day it is both seen and listed and -1 the day after delisting;
    a running sum over day-level deltas replaces any day-by-security product.
    """
    keys = list(keys)
    start = F.greatest("first_seen", "list_date")
    stop = F.date_add("delist_date", 1)
    alive = F.col("delist_date").isNull() | (stop > start)
    has_meta = (F.col("list_date").isNotNull() | F.col("delist_date").isNotNull()).cast("int")

    security = F.col("is_day") == 0

    def event(when: Column, active: int, new: int, meta: Column | int, declared: Column | None = None, is_day: int = 0) -> Column:
        whole = F.lit(None).cast("bigint") if declared is None else declared
        return F.struct(
            when.alias("trade_date"), F.lit(active).cast("bigint").alias("active"), F.lit(new).cast("bigint").alias("new"), (meta if isinstance(meta, Column) else F.lit(meta)).cast("int").alias("meta"),
            whole.alias("declared"), F.lit(is_day).alias("is_day"),
        )

    events = profile.select(
        *keys,
        F.explode(
            F.when(
                security,
                F.array(
                    event(F.col("first_seen"), 0, 1, has_meta),
                    event(F.when(alive, start), 1, 0, 0),
                    event(F.when(alive, stop), -1, 0, 0),
                ),
            ).otherwise(F.array(event(F.col("first_seen"), 0, 0, 0, F.col("declared"), 1)))
        ).alias("e"),
    ).select(*keys, "e.*").filter("trade_date IS NOT NULL")
    merged = events.groupBy(*keys, "trade_date").agg(
        F.sum("active").alias("active"), F.sum("new").alias("new"), F.max("meta").alias("meta"), F.max("declared").alias("declared"), F.max("is_day").alias("is_day")
    )
    w = running(keys)
    swept = merged.withColumns({"listed": F.sum("active").over(w), "cumulative": F.sum("new").over(w), "has_meta": F.max("meta").over(w)}).filter("is_day = 1")
    by_meta = (F.col("listed") > 0) & (F.col("has_meta") == 1)
    by_declared = flag(F.col("declared") > 0)
    return swept.select(
        *keys,
        "trade_date",
        F.when(by_meta, F.col("listed")).when(by_declared, F.col("declared")).otherwise(F.col("cumulative")).alias("expected_eligible_count"),
        F.when(by_meta, "point_in_time_listing_metadata").when(by_declared, "declared_universe_count").otherwise("cumulative_observed_symbols").alias("expected_universe_source"),
    )


def panel_coverage_counts(panel: DataFrame, keys: Sequence[str] = ("market",), dedupe: bool = True) -> DataFrame:
    clean = panel.filter(F.col("trade_date").isNotNull() & F.col("ts_code").isNotNull())
    if dedupe:
        clean = keep_last(clean, [*keys, "ts_code", "trade_date"])
    ok = valid_price(F.col("close"), F.col("pre_close"))
    return clean.groupBy(*keys, "trade_date").agg(
        count_true(ok).alias("observed_universe"), F.count("ts_code").alias("symbol_count"), count_true(flag(F.col("amount_rmb") >= 0)).alias("valid_amount_observed")
    )


def coverage_from_counts(counts: DataFrame, expected: DataFrame, quality: Quality = Quality(), keys: Sequence[str] = ("market",)) -> DataFrame:
    """Auditable expected-versus-observed table. Module coverages, when present as ``*_coverage_in``
    columns, override the overall ratio."""
    e = F.col("expected_eligible_count")
    positive = F.when(e > 0, e)
    joined = counts.join(expected, [*keys, "trade_date"], "left")
    coverage = ratio("observed_universe", positive)
    amount = ratio("valid_amount_observed", positive)

    def module(name: str, fallback: Column) -> Column:
        return F.coalesce(F.col(f"{name}_in"), fallback) if f"{name}_in" in counts.columns else fallback

    low = flag(e < quality.minimum_universe)
    thin = ~flag(coverage >= quality.minimum_coverage)
    warnings = F.array_compact(
        F.array(
            F.when(low, F.concat(F.lit("EXPECTED_UNIVERSE_BELOW_MINIMUM_"), e.cast("string"))),
            F.when(thin, F.concat(F.lit("MARKET_COVERAGE_BELOW_MINIMUM_"), F.coalesce(decimals(coverage, 3), F.lit("nan")))),
        )
    )
    return joined.select(
        *keys,
        "trade_date",
        "observed_universe",
        F.col("symbol_count").alias("observed_symbol_count"),
        F.col("observed_universe").alias("valid_price_count"),
        F.col("valid_amount_observed").alias("valid_amount_count"),
        "expected_eligible_count",
        "expected_universe_source",
        e.alias("known_stocks"),
        F.col("observed_universe").alias("eligible_count"),
        (e - F.col("observed_universe")).alias("missing_close_count"),
        (e - F.col("valid_amount_observed")).alias("missing_amount_count"),
        coverage.alias("coverage_ratio"),
        module("breadth_coverage", coverage).alias("breadth_coverage"),
        module("profit_effect_coverage", coverage).alias("profit_effect_coverage"),
        module("liquidity_coverage", amount).alias("liquidity_coverage"),
        low.alias("expected_universe_below_minimum"),
        F.when(thin, "INVALID").otherwise("VALID").alias("data_quality"),
        F.array_join(warnings, ";").alias("warnings"),
    )


def market_coverage_daily(panel: DataFrame, quality: Quality = Quality(), keys: Sequence[str] = ("market",), dedupe: bool = True) -> DataFrame:
    return coverage_from_counts(panel_coverage_counts(panel, keys, dedupe), expected_universe_daily(panel, keys), quality, keys)


def assess_market_coverage(coverage: DataFrame, panel: DataFrame, quality: Quality = Quality(), keys: Sequence[str] = ("market",), profile: DataFrame | None = None) -> DataFrame:
    """Latest day per market against the production thresholds, with metadata-completeness warnings. The panel is read only
    where its ``profile`` is not given."""
    keys = list(keys)
    latest = coverage.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in coverage.columns if c not in keys]), "trade_date").alias("r"), F.count("*").alias("date_count")).select(*keys, "date_count", "r.*")
    profile = panel_profile(panel, keys) if profile is None else profile
    meta = profile.groupBy(*keys).agg(F.sum("listed_rows").alias("_listed"), F.sum("delisted_rows").alias("_delisted"), F.sum("st_rows").alias("_st"))
    ratio_now = F.coalesce("coverage_ratio", F.lit(0.0))
    enough = F.col("expected_eligible_count") >= quality.minimum_universe
    covered = ratio_now >= quality.minimum_coverage
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_listed") == 0, F.lit("HISTORICAL_LIST_DATE_INCOMPLETE")),
            F.when(F.col("_delisted") == 0, F.lit("HISTORICAL_DELIST_DATE_INCOMPLETE")),
            F.when(F.col("_st") == 0, F.lit("HISTORICAL_ST_STATUS_INCOMPLETE")),
            F.when(~enough, F.concat(F.lit("EXPECTED_UNIVERSE_BELOW_MINIMUM_"), F.col("expected_eligible_count").cast("string"))),
            F.when(~covered, F.concat(F.lit("MARKET_COVERAGE_BELOW_MINIMUM_"), decimals(ratio_now, 3))),
        )
    )
    return latest.join(meta, keys).select(
        *keys,
        F.col("trade_date").alias("latest_date"),
        "date_count",
        "expected_eligible_count",
        "observed_universe",
        "valid_price_count",
        "valid_amount_count",
        ratio_now.alias("latest_coverage_ratio"),
        enough.alias("sufficient_universe"),
        covered.alias("sufficient_coverage"),
        (enough & covered).alias("valid"),
        F.array_join(warnings, ";").alias("warnings"),
    )


def production_gate(assessment: DataFrame, allow_partial: bool = False) -> None:
    """Raise if the latest day of any market fails the thresholds. The error counts all of them; its ``failed`` is the
    table of their rows."""
    failed = assessment.filter(~F.col("valid"))
    if allow_partial:
        return
    n, first = failed.agg(F.count("*"), F.min(assessment.columns[0])).first()
    if n:
        error = InsufficientMarketCoverage(f"the latest day fails the coverage gate in {n} markets, {first} among them")
        error.failed = failed
        raise error


def approximate_sources(limits: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Per market, whether any limit row came from an approximate rule."""
    return limits.groupBy(*keys).agg(F.bool_or(F.coalesce(F.lower("limit_method").contains("approx"), F.lit(False))).alias("approximate"))


def approximate_gate(limits: DataFrame, keys: Sequence[str] = ("market",)) -> None:
    if approximate_sources(limits, keys).filter("approximate").limit(1).count():
        raise UnavailableMarketFactor("limit flags are approximate; production scoring refused")


def ratio_violation(columns: Sequence[str] = RATIO_COLUMNS) -> Column:
    return flag(F.exists(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: F.coalesce((x < 0) | (x > 1), F.lit(False))))


def dataset_warnings(panel: DataFrame, limits: DataFrame, assessment: DataFrame | None = None, quality: Quality = Quality(), keys: Sequence[str] = ("market",), profile: DataFrame | None = None) -> DataFrame:
    """One row per market with the standing warnings of its data set. The panel is read only where its ``profile`` is not
    given."""
    keys = list(keys)
    profile = panel_profile(panel, keys) if profile is None else profile
    symbols = profile.groupBy(*keys).agg(F.count_if(F.col("is_day") == 0).alias("symbols"))
    methods = approximate_sources(limits, keys).withColumn("_has_limits", F.lit(True))
    out = symbols.join(methods, keys, "left")
    extra = F.array().cast("array<string>")
    if assessment is not None:
        out = out.join(assessment.select(*keys, F.col("warnings").alias("_assessment")), keys, "left")
        extra = F.filter(F.split(F.coalesce("_assessment", F.lit("")), ";"), lambda w: w != "")
    items = F.array_distinct(
        F.concat(
            F.array_compact(
                F.array(
                    F.lit("SURVIVORSHIP_BIAS_WARNING") if quality.survivorship_warning else F.lit(None).cast("string"),
                    F.lit("OPTIONS_UNAVAILABLE"),
                    F.lit("MARGIN_OPTIONAL"),
                    F.lit("FAILED_LIMIT_RATE_UNAVAILABLE"),
                    F.lit("LIMIT_STATUS_APPROXIMATE_BAOSTOCK_BOARD_BANDS") if quality.approximate_provider else F.lit(None).cast("string"),
                    F.when(F.col("symbols") < quality.partial_panel_symbols, F.concat(F.lit("PARTIAL_STOCK_PANEL_SYMBOLS_"), F.col("symbols").cast("string"))),
                )
            ),
            extra,
            F.array_compact(
                F.array(
                    F.when(F.col("_has_limits").isNull(), F.lit("LIMIT_DATA_UNAVAILABLE")).when(
                        F.col("approximate"), F.lit("LIMIT_RULES_APPROXIMATE_NOT_PRODUCTION_VALID")
                    )
                )
            ),
        )
    )
    return out.select(*keys, F.array_join(items, ";").alias("data_quality_warnings"))


def add_integrity_gate(daily: DataFrame, quality: Quality = Quality(), keys: Sequence[str] = ("market",)) -> DataFrame:
    """Per-day integrity warnings and the hard ``integrity_invalid`` flag.

    Expects ``expected_eligible_count``, ``observed_universe``, ``market_coverage_ratio`` and the module
    columns. The collapse test compares with the last earlier day that observed anything.
    """
    expected = F.coalesce("expected_eligible_count", F.lit(0)).cast("double")
    observed = F.coalesce("observed_universe", F.lit(0)).cast("double")
    previous = F.last(F.when(observed > 0, observed), ignorenulls=True).over(before(keys))
    violation = ratio_violation([c for c in RATIO_COLUMNS if c in daily.columns])

    def mismatch(column: str) -> Column:
        off = F.abs(F.col(column).cast("double") - expected) / F.nullif(expected, F.lit(0.0)) > quality.max_cross_module_deviation
        return F.when((expected > 0) & flag(off), F.lit(f"CROSS_MODULE_UNIVERSE_MISMATCH_{column}"))

    marked = daily.withColumns({"_previous": previous, "ratio_violation": violation})
    codes = F.array_compact(
        F.array(
            F.when(expected < quality.minimum_universe, F.concat(F.lit("EXPECTED_UNIVERSE_BELOW_MINIMUM_"), expected.cast("bigint").cast("string"))),
            F.when(~flag(F.col("market_coverage_ratio") >= quality.minimum_coverage), F.lit("MARKET_COVERAGE_BELOW_MINIMUM")),
            F.when(flag(observed / F.col("_previous") < quality.minimum_relative_universe), F.lit("MARKET_COVERAGE_COLLAPSE")),
            *[mismatch(c) for c in ("eligible_count", "observed_eligible_count", "valid_amount_count") if c in daily.columns],
            F.when(F.col("ratio_violation"), F.lit("IMPOSSIBLE_RATIO")),
        )
    )
    gated = marked.withColumn("_codes", codes).withColumns({"integrity_warnings": F.array_join("_codes", ";"), "integrity_invalid": F.size("_codes") > 0})
    gate = F.when(F.col("integrity_invalid"), "INVALID").otherwise("PASS") if quality.production else F.lit("RESEARCH")
    base = F.coalesce("data_quality_warnings", F.lit("")) if "data_quality_warnings" in daily.columns else F.lit("")
    both = F.concat_ws(";", F.when(base != "", base), F.when(F.col("integrity_warnings") != "", F.col("integrity_warnings")))
    return gated.withColumns({"data_quality_warnings": both, "production_gate": gate}).drop("_previous", "_codes")


def add_quality_grade(daily: DataFrame, quality: Quality = Quality()) -> DataFrame:
    """Relabel degenerate modules, grade the day, derive confidence and status, void failed days."""
    modules = ("breadth", "profit_effect", "liquidity")
    relabelled = daily.withColumns(
        {
            f"{m}_quality": F.when(F.col(f"{m}_score").isNull() & (F.coalesce(f"{m}_degenerate_factors", F.lit("")) != ""), "DEGENERATE").otherwise(F.col(f"{m}_quality"))
            for m in modules
        }
    )
    grades = F.array(*[F.coalesce(f"{m}_quality", F.lit("INVALID")) for m in modules])
    invalid = F.array_contains(grades, "INVALID")
    degraded = F.arrays_overlap(grades, F.array(F.lit("DEGRADED"), F.lit("DEGENERATE")))
    warned = F.col("data_quality_warnings") != ""
    grade = (
        F.when(F.col("integrity_invalid") | invalid, "INVALID").when(degraded, "C").when(warned, "B").otherwise("A")
    )
    graded = relabelled.withColumn("market_temperature_quality", grade)
    q = F.col("market_temperature_quality")
    status = F.when(q == "INVALID", "INVALID").when(warned, "WARN").otherwise("PASS")
    warnings = F.col("data_quality_warnings")
    if quality.allow_partial:
        warnings = F.when(q == "INVALID", F.concat(warnings, F.lit(";PARTIAL_MARKET_PANEL_NOT_VALID_FOR_TRADING"))).otherwise(warnings)
    out = graded.withColumns(
        {
            "confidence": F.when(q == "A", "HIGH").when(q == "B", "MEDIUM").when(q == "C", "LOW").otherwise("NONE"),
            "data_quality_status": status,
            "data_quality_warnings": warnings,
            "raw_market_temperature": F.when(~F.col("integrity_invalid"), F.col("raw_market_temperature")),
        }
    )
    return out.withColumn("warnings", F.col("data_quality_warnings"))


def limit_cross_check(cached: DataFrame, derived: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Compare two limit panels on three days per market: most limit-downs, the middle day, most limit-ups."""
    keys = list(keys)
    by = [*keys, "trade_date"]
    days = cached.groupBy(*by).agg(count_true(F.col("is_limit_up")).alias("ups"), count_true(F.col("is_limit_down")).alias("downs"))
    w = ordered(keys)
    whole = Window.partitionBy(*keys)
    placed = days.withColumns({"_pos": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    chosen = placed.groupBy(*keys).agg(
        F.max_by("trade_date", F.struct("downs", F.date_diff(F.lit("9999-12-31").cast("date"), "trade_date"))).alias("max_down"),
        F.max(F.when(F.col("_pos") == F.floor(F.col("_n") / 2), F.col("trade_date"))).alias("median"),
        F.max_by("trade_date", F.struct("ups", F.date_diff(F.lit("9999-12-31").cast("date"), "trade_date"))).alias("max_up"),
    )
    picks = chosen.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("trade_date")) for n in ("max_down", "median", "max_up")])).alias("p"),
    ).select(*keys, "p.*")

    days_wanted = picks.select(*by).distinct()

    def members(df: DataFrame, name: str) -> DataFrame:
        return df.join(days_wanted, by, "left_semi").groupBy(*by, "ts_code").agg(F.bool_or("is_limit_up").alias(f"{name}_up"), F.bool_or("is_limit_down").alias(f"{name}_down"))

    paired = members(cached, "a").join(members(derived, "b"), [*by, "ts_code"], "full_outer")

    def counts(side: str) -> Column:
        a, b = flag(F.col(f"a_{side}")), flag(F.col(f"b_{side}"))
        found = {"cached_count": a, "derived_count": b, "only_cached": a & ~b, "only_derived": b & ~a, "_both": a & b, "_any": a | b}
        return F.struct(F.lit(side).alias("side"), *[count_true(c).alias(n) for n, c in found.items()])

    merged = paired.groupBy(*by).agg(F.array(counts("up"), counts("down")).alias("_s")).select(*by, F.explode("_s").alias("_s")).select(*by, "_s.*")
    jaccard = F.when(F.col("_any") == 0, 1.0).otherwise(F.col("_both") / F.nullif(F.col("_any").cast("double"), F.lit(0.0)))
    return picks.join(merged, by).select(
        *keys, "reason", "trade_date", "side", "cached_count", "derived_count", "only_cached", "only_derived", jaccard.alias("jaccard"), F.when((F.col("only_cached") == 0) & (F.col("only_derived") == 0), "PASS").otherwise("MISMATCH").alias("status")
    )


def changed_cells(full: DataFrame, prefix: DataFrame, on: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """No-lookahead check: cells of a prefix run that differ from the full run over the same rows."""
    left = prefix.select(*on, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a"))
    right = full.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    joined = left.join(right, list(on), "left")
    types = dict(prefix.dtypes)

    def differs(c: str) -> Column:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        same = a.eqNullSafe(b)
        if types[c] == "double":
            same = same | flag(F.abs(a - b) <= tolerance)
        return ~same

    return joined.agg(
        F.count("*").alias("prefix_rows"),
        F.coalesce(count_true(F.col("_b").isNull()), F.lit(0)).alias("missing_rows"),
        *[count_true(differs(c)).alias(f"changed_{c}") for c in columns],
    )
