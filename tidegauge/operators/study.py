"""Event-study tables: baselines, summaries, intervals, comparators, robustness, readiness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import count_true, flag
from ..params import HORIZONS
from .events import CONFIRMED_SIGNALS, EPISODE_DAYS, EPISODE_STARTS, EVENT_SETS, is_valid_row

BASELINES = ("UNCONDITIONAL", "COLD_REGIME", "HOT_REGIME")
PERIODS = (("development_2022_2024", "2022-01-01", "2024-12-31"), ("holdout_2025_latest", "2025-01-01", "2099-12-31"))
COMPARATORS = (
    *[(CONFIRMED_SIGNALS[i], m) for i in (0, 1) for m in ("raw", "episode")],
    *[(EPISODE_STARTS[i], m) for i in (0, 1) for m in ("raw", "episode")],
    *[(EPISODE_DAYS[i], "raw") for i in (0, 1)],
)


def median(c: str) -> Column:
    return F.percentile(F.col(c), F.lit(0.5))


def baseline_masks(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Flag each day's baseline membership. A regime day counts while its episode is active and before
    the episode's first confirmation."""
    valid = is_valid_row()

    def regime(prefix: str, signal: str) -> Column:
        number = F.col(f"{prefix}_episode_id")
        confirmed = F.min(F.when(F.col("signal") == signal, F.col("trade_date"))).over(Window.partitionBy(*keys, f"{prefix}_episode_id"))
        return valid & F.col(f"recent_{prefix}_episode") & number.isNotNull() & (confirmed.isNull() | flag(F.col("trade_date") < confirmed))

    return states.withColumns({"UNCONDITIONAL": valid, "COLD_REGIME": regime("panic", CONFIRMED_SIGNALS[0]), "HOT_REGIME": regime("euphoria", CONFIRMED_SIGNALS[1])})


def baseline_table(states: DataFrame, outcomes: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Per baseline type, benchmark and horizon: size, mean, median, positive rate, excursions.

    Conditional aggregates cover the three types in one grouping, so an empty regime keeps its N=0 row.
    """
    masks = baseline_masks(states, keys).select(*keys, "trade_date", *BASELINES)
    joined = masks.join(outcomes, [*keys, "trade_date"])
    aggs: list[Column] = []
    for b in BASELINES:
        inside = F.col(b)
        ret, mae, mfe = (F.when(inside, F.col(c)) for c in ("ret", "mae", "mfe"))
        half = F.lit(0.5)
        aggs.append(
            F.struct(
                F.lit(b).alias("baseline_type"), F.count(ret).alias("N"), F.avg(ret).alias("Mean"), F.percentile(ret, half).alias("Median"), F.avg((ret > 0).cast("double")).alias("PositiveRate"),
                F.avg(mae).alias("MAEMean"), F.percentile(mae, half).alias("MAEMedian"), F.avg(mfe).alias("MFEMean"), F.percentile(mfe, half).alias("MFEMedian"),
                F.avg(mae).alias("FutureDrawdownMean"), F.percentile(mae, half).alias("FutureDrawdownMedian"),
            ).alias(b)
        )
    return joined.groupBy(*keys, "benchmark", "horizon").agg(*aggs).select(*keys, "benchmark", "horizon", F.explode(F.array(*[F.col(b) for b in BASELINES])).alias("_b")).select(*keys, "benchmark", "horizon", "_b.*")


def sample_warning(n: Column) -> Column:
    return F.when(n < 10, "VERY_LOW_SAMPLE").when(n < 20, "LOW_SAMPLE").otherwise("MODERATE_SAMPLE")


def evidence_label(n: Column, mean: Column, med: Column, excess: Column, low: Column, high: Column, positive: Column) -> Column:
    """Conservative descriptive label; never a recommendation."""
    sign = flag((positive & (excess > 0)) | (~positive & (excess < 0)))
    agree = flag((mean >= 0) == (med >= 0))
    excludes = flag((low > 0) | (high < 0)) & low.isNotNull() & high.isNotNull()
    return (
        F.when((n < 10) | excess.isNull(), "INCONCLUSIVE").when(~sign, "NEGATIVE").when(excludes & agree & (n >= 20), "STRONG")
        .when(agree & excludes, "MODERATE").when(agree, "WEAK").otherwise("INCONCLUSIVE")
    )


PRIME = 2147483647


def drawn_places(seed: int, samples: np.ndarray, n: int) -> np.ndarray:
    """(samples, n) places 0 .. n - 1: two multiplicative mixes modulo a prime, within 64 bits."""
    first = (seed * 1000003 + samples[:, None] * 69621 + np.arange(n)[None] * 48271 + 1) % PRIME
    second = (first * first % PRIME * 1103515245 + first * 12345 + samples[:, None]) % PRIME
    return second % n


INTERVALS = ("MeanCI95Low", "MeanCI95High", "MedianCI95Low", "MedianCI95High")


def bootstrap_intervals(values: DataFrame, cell: Sequence[str], value: str = "ret", samples: int = 10_000, seed: int = 42, chunk_draws: int = 1 << 22) -> DataFrame:
    """Percentile bootstrap 95 % intervals of mean and median per cell.

    The values of a cell (one per event, so a calendar's length at most) travel as one sorted array. Cells of equal values
    are drawn once, and a large cell is cut into ranges of samples of about ``chunk_draws`` draws. Draws come from (seed,
    sample, draw) by integer arithmetic, so a lost task redraws the same numbers and any engine can repeat them; they
    depend on a cell's size alone, so cells of one size share places and the ranks of medians. A single value is its own
    interval.
    """
    cell = list(cell)
    own = F.struct(*cell)
    packed = values.filter(F.col(value).isNotNull()).groupBy(*cell).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    named = packed.withColumn("_first", F.min(own).over(Window.partitionBy("_v")))
    step = F.greatest(F.lit(1), F.floor(F.lit(chunk_draws) / F.size("_v"))).cast("int")
    parts = named.filter(F.col("_first") == own).select("_first", "_v", step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1), step)).alias("_from"))
    order = [F.size("_v"), "_from"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, places, low, high = None, None, None, None
        for batch in batches:
            means, middles = [], []
            for v, a, some in zip(batch.pop("_v"), batch["_from"], batch.pop("_step"), strict=True):
                v, n = np.asarray(v, float), len(v)
                if known != (n, a):
                    known, places = (n, a), drawn_places(seed, np.arange(a, min(a + some, samples)), n)
                    ranks = np.partition(places, [(n - 1) // 2, n // 2], axis=1)
                    low, high = ranks[:, (n - 1) // 2].copy(), ranks[:, n // 2].copy()
                means.append(v[places].mean(axis=1))
                middles.append((v[low] + v[high]) / 2)
            yield batch.assign(_means=means, _middles=middles)

    def at(ordered: str, share: float) -> Column:
        place = share * (samples - 1)
        before, after = F.col(ordered)[int(place)], F.col(ordered)[min(int(place) + 1, samples - 1)]
        return before + (after - before) * (place - int(place))

    kind = ", ".join(f"`{c}`: {t}" for c, t in packed.select(*cell).dtypes)
    drawn = parts.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, f"_first struct<{kind}>, _from int, _means array<double>, _middles array<double>")
    merged = drawn.groupBy("_first").agg(*[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ("_means", "_middles")])
    bounds = [at(c, share).alias(name) for name, (c, share) in zip(INTERVALS, [(c, q) for c in ("_means", "_middles") for q in (0.025, 0.975)], strict=True)]
    return named.select(*cell, "_first").join(merged.select("_first", *bounds), "_first").drop("_first")


def summarize(attached: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Descriptive statistics of next-open returns and excursions per cell."""
    quantiles = F.percentile("ret", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return attached.groupBy(*cell).agg(
        F.count("ret").alias("N"), F.avg("ret").alias("Mean"), quantiles.alias("_q"), F.stddev_samp("ret").alias("StdDev"), F.avg((F.col("ret") > 0).cast("double")).alias("PositiveRate"),
        F.avg("mfe").alias("MFEMean"), median("mfe").alias("MFEMedian"), F.avg("mae").alias("MAEMean"), median("mae").alias("MAEMedian"),
        F.avg("mae").alias("FutureDrawdownMean"), median("mae").alias("FutureDrawdownMedian"), F.avg("ptdd").alias("PeakToTroughDDMean"), median("ptdd").alias("PeakToTroughDDMedian"),
    ).withColumns({"P25": F.col("_q")[0], "Median": F.col("_q")[1], "P75": F.col("_q")[2]}).drop("_q")


def _grid(markets: DataFrame, pairs: Sequence[tuple[str, str]], benchmarks: Sequence[str], horizons: Sequence[int], names: tuple[str, str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1])) for a, b in pairs])
    return (
        markets.withColumn("_p", F.explode(cells)).select("*", "_p.*").drop("_p")
        .withColumn("benchmark", F.explode(F.array(*[F.lit(b) for b in benchmarks])))
        .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    )


def study_table(sets: DataFrame, outcomes: DataFrame, baselines: DataFrame, pairs: Sequence[tuple[str, str]], benchmarks: Sequence[str], horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("market",), bootstrap_samples: int = 10_000, seed: int = 42) -> DataFrame:
    """Signal x event set x benchmark x horizon with counts, both baselines, intervals and evidence label.

    ``sets`` is :func:`events.event_sets`. All cells come from one grouping; empty cells keep a row.
    """
    from .events import attach_outcomes

    keys = list(keys)
    wanted = F.array(*[F.lit(f"{a}/{b}") for a, b in pairs])
    chosen = sets.filter(F.array_contains(wanted, F.concat_ws("/", "event_type", "event_set")))
    cell = [*keys, "event_type", "event_set", "benchmark", "horizon"]
    attached = attach_outcomes(chosen.select(*keys, "event_type", "event_set", "event_id", "date"), outcomes, benchmarks, horizons, keys)
    stats = summarize(attached, cell)
    counts = sets.groupBy(*keys, "event_type").agg(*[count_true(F.col("event_set") == s).alias(n) for s, n in zip(EVENT_SETS, ("RawN", "DeclusteredN", "EpisodeN"))])
    markets = baselines.select(*keys).distinct()
    table = _grid(markets, pairs, benchmarks, horizons, ("event_type", "event_set")).join(stats, cell, "left").join(counts, [*keys, "event_type"], "left")
    table = table.na.fill(0, ["N", "RawN", "DeclusteredN", "EpisodeN"])
    cold = F.col("event_type").startswith("ICE") | F.col("event_type").startswith("PANIC")
    table = table.withColumn("_regime", F.when(cold, "COLD_REGIME").otherwise("HOT_REGIME"))
    pick = lambda cols, prefix: [F.col(c).alias(f"{prefix}{c}") for c in cols]
    plain = baselines.filter("baseline_type = 'UNCONDITIONAL'").select(*keys, "benchmark", "horizon", *pick(("Mean", "Median"), "Baseline"))
    regime = baselines.select(*keys, "benchmark", "horizon", F.col("baseline_type").alias("_regime"), *pick(("N", "Mean", "Median", "FutureDrawdownMean"), "RegimeBaseline"))
    table = table.join(plain, [*keys, "benchmark", "horizon"], "left").join(regime, [*keys, "benchmark", "horizon", "_regime"], "left")
    if bootstrap_samples:
        table = table.join(bootstrap_intervals(attached, cell, "ret", bootstrap_samples, seed), cell, "left")
    else:
        table = table.withColumns({c: F.lit(None).cast("double") for c in INTERVALS})
    excess = {"ExcessReturn": "Mean", "ExcessCI95Low": "MeanCI95Low", "ExcessCI95High": "MeanCI95High"}
    table = table.withColumns({n: F.col(c) - F.col("BaselineMean") for n, c in excess.items()})
    event_count = F.when(F.col("event_set") == "raw", F.col("RawN")).when(F.col("event_set") == "declustered", F.col("DeclusteredN")).otherwise(F.col("EpisodeN"))
    return table.withColumns(
        {
            "EventCount": event_count,
            "RegimeBaselineN": F.coalesce("RegimeBaselineN", F.lit(0)),
            "SampleWarning": sample_warning(F.col("N")),
            "Evidence": evidence_label(F.col("N"), F.col("Mean"), F.col("Median"), F.col("ExcessReturn"), F.col("ExcessCI95Low"), F.col("ExcessCI95High"), cold),
            "return_definition": F.lit("next_open_forward_return"),
        }
    ).drop("_regime")


PRIMARY = tuple((s, m) for s in CONFIRMED_SIGNALS for m in EVENT_SETS)


def decluster_summary(sets: DataFrame, window: int = 20, keys: Sequence[str] = ("market",)) -> DataFrame:
    found = sets.filter(F.col("event_type").isin(*CONFIRMED_SIGNALS)).groupBy(*keys, "event_type", "event_set").agg(
        F.count("*").alias("event_count"), F.min("date").alias("first_event_date"), F.max("date").alias("last_event_date"), F.count_distinct("episode_id").alias("episode_count")
    )
    markets = sets.select(*keys).distinct()
    cells = F.array(*[F.struct(F.lit(a).alias("event_type"), F.lit(b).alias("event_set")) for a, b in PRIMARY])
    grid = markets.withColumn("_p", F.explode(cells)).select(*keys, "_p.*")
    return grid.join(found, [*keys, "event_type", "event_set"], "left").na.fill(0, ["event_count", "episode_count"]).withColumn("decluster_window_observations", F.lit(window))


def time_split(events: DataFrame, outcomes: DataFrame, baselines: DataFrame, benchmarks: Sequence[str], periods: Sequence[tuple[str, str, str]] = PERIODS, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("market",), bootstrap_samples: int = 10_000, seed: int = 42) -> DataFrame:
    """Confirmed signals by development/holdout period, with intervals of mean and median."""
    from .events import attach_outcomes

    keys = list(keys)
    label = F.coalesce(*[F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in periods])
    confirmed = events.filter(F.col("event_type").isin(*CONFIRMED_SIGNALS)).withColumn("period", label).filter(F.col("period").isNotNull())
    cell = [*keys, "period", "event_type", "benchmark", "horizon"]
    attached = attach_outcomes(confirmed.select(*keys, "event_type", "period", "event_id", "date"), outcomes, benchmarks, horizons, keys)
    stats = summarize(attached, cell).join(bootstrap_intervals(attached, cell, "ret", bootstrap_samples, seed), cell, "left")
    counts = confirmed.groupBy(*keys, "period", "event_type").agg(F.count("*").alias("event_count"))
    pairs = [(n, s) for n, *_ in periods for s in CONFIRMED_SIGNALS]
    plain = baselines.filter("baseline_type = 'UNCONDITIONAL'").select(*keys, "benchmark", "horizon", F.col("Mean").alias("BaselineMean"), F.col("Median").alias("BaselineMedian"))
    table = _grid(baselines.select(*keys).distinct(), pairs, benchmarks, horizons, ("period", "event_type")).join(stats, cell, "left").join(counts, [*keys, "period", "event_type"], "left").join(plain, [*keys, "benchmark", "horizon"], "left")
    return table.na.fill(0, ["N", "event_count"]).withColumns(
        {"ExcessReturn": F.col("Mean") - F.col("BaselineMean"), "assessment": F.when(F.col("N") < 10, "DESCRIPTIVE_ONLY_LOW_SAMPLE").otherwise("DESCRIPTIVE_SPLIT")}
    )


def robustness_table(events: DataFrame, outcomes: DataFrame, baselines: DataFrame, variants: Sequence, benchmarks: Sequence[str], defaults: dict[str, float], horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("market",), bootstrap_samples: int = 10_000, seed: int = 42) -> DataFrame:
    """Confirmed-signal results of every parameter set, with the interval of the mean, and the share of sets that agree in direction with
    the default value. ``events`` carries ``variant_id``; all sets come from one run."""
    from .events import attach_outcomes

    keys = list(keys)
    confirmed = events.filter(F.col("event_type").isin(*CONFIRMED_SIGNALS)).select(*keys, "variant_id", "event_type", "event_id", "date")
    cell = [*keys, "variant_id", "event_type", "benchmark", "horizon"]
    attached = attach_outcomes(confirmed, outcomes, benchmarks, horizons, keys)
    stats = summarize(attached, cell)
    if bootstrap_samples:
        bounds = bootstrap_intervals(attached, cell, "ret", bootstrap_samples, seed)
        stats = stats.join(bounds.select(*cell, F.col("MeanCI95Low").alias("ci_low"), F.col("MeanCI95High").alias("ci_high")), cell, "left")
    else:
        stats = stats.withColumns({c: F.lit(None).cast("double") for c in ("ci_low", "ci_high")})
    counts = confirmed.groupBy(*keys, "variant_id", "event_type").agg(F.count("*").alias("event_count"))
    pairs = [(v.variant_id, s) for v in variants for s in CONFIRMED_SIGNALS]
    plain = baselines.filter("baseline_type = 'UNCONDITIONAL'").select(*keys, "benchmark", "horizon", F.col("Mean").alias("BaselineMean"))
    table = _grid(baselines.select(*keys).distinct(), pairs, benchmarks, horizons, ("variant_id", "event_type")).join(stats, cell, "left").join(counts, [*keys, "variant_id", "event_type"], "left").join(plain, [*keys, "benchmark", "horizon"], "left")
    which = lambda attr: F.coalesce(*[F.when(F.col("variant_id") == v.variant_id, F.lit(getattr(v, attr))) for v in variants])
    table = table.na.fill(0, ["N", "event_count"]).withColumns({"parameter": which("parameter"), "value": which("value"), "ExcessReturn": F.col("Mean") - F.col("BaselineMean")})
    w = Window.partitionBy(*keys, "parameter", "event_type", "benchmark", "horizon")
    is_default = F.coalesce(*[F.when(F.col("parameter") == p, F.col("value") == v) for p, v in defaults.items()], F.lit(False))
    base = F.max(F.when(is_default, F.col("ExcessReturn"))).over(w)
    expected = F.when(F.col("event_type").startswith("ICE"), 1.0).otherwise(-1.0)
    direction = F.signum(F.coalesce(F.nullif(base, F.lit(0.0)), expected))
    return (
        table.withColumn("_dir", direction)
        .withColumn("same_direction_ratio", F.avg((F.signum(F.coalesce("ExcessReturn", F.lit(0.0))) == F.col("_dir")).cast("double")).over(w))
        .withColumns({"parameter_sensitivity_warning": F.when(F.col("same_direction_ratio") < 2.0 / 3.0, "THRESHOLD_SENSITIVE").otherwise("DIRECTION_STABLE"), "sample_warning": sample_warning(F.col("N"))})
        .drop("_dir")
    )


def readiness(primary: DataFrame, comparator: DataFrame, robustness: DataFrame, horizon: int = 20, keys: Sequence[str] = ("market",), persistence_from_all_sets: bool = False) -> DataFrame:
    """One row per market and confirmed signal with gate results and reason codes.

    The published gate looks for the declustered and episode rows after keeping only raw ones, so
    persistence never holds; ``persistence_from_all_sets`` checks the evident intent instead.
    """
    keys = list(keys)
    by = [*keys, "event_type"]
    at = primary.filter((F.col("horizon") == horizon) & F.col("event_type").isin(*CONFIRMED_SIGNALS))
    up = F.col("event_type").startswith("ICE")
    excess, mean, med = F.col("ExcessReturn"), F.col("Mean"), F.col("Median")
    raw = at.filter("event_set = 'raw'")
    big = F.col("N") >= 10
    effect = flag(F.when(up, excess > 0).otherwise(excess < 0))
    deeper = flag(F.col("FutureDrawdownMean") < F.col("RegimeBaselineFutureDrawdownMean"))
    agree = flag(F.when(up, (mean >= 0) == (med >= 0)).otherwise((mean <= 0) == (med <= 0)))
    main = raw.groupBy(*by).agg(
        F.bool_or(big).alias("sample_ok"), F.coalesce(F.bool_or(big & effect), F.lit(False)).alias("_effect"), F.coalesce(F.bool_or(big & deeper), F.lit(False)).alias("_deeper"), F.coalesce(F.bool_and(F.when(big, agree)), F.lit(False)).alias("direction_ok")
    ).withColumn("effect_ok", F.col("_effect") & (up | F.col("_deeper")))
    if persistence_from_all_sets:
        signs = at.groupBy(*by, "benchmark").agg(F.count_distinct(F.signum("ExcessReturn")).alias("_k"), F.count("ExcessReturn").alias("_n"), F.min(F.signum("ExcessReturn")).alias("_s"))
        persist = signs.groupBy(*by).agg(F.bool_or((F.col("_k") == 1) & (F.col("_n") == len(EVENT_SETS)) & (F.col("_s") != 0)).alias("persistence_ok"))
        main = main.join(persist, by, "left")
    else:
        main = main.withColumn("persistence_ok", F.lit(False))
    robust = robustness.filter(F.col("horizon") == horizon).groupBy(*by).agg(F.bool_or(F.col("same_direction_ratio") >= 2.0 / 3.0).alias("robustness_ok"))
    comp = comparator.filter((F.col("event_set") == "raw") & (F.col("horizon") == horizon))
    start = F.when(F.col("event_type") == EPISODE_STARTS[0], CONFIRMED_SIGNALS[0]).when(F.col("event_type") == EPISODE_STARTS[1], CONFIRMED_SIGNALS[1])
    paired = comp.withColumn("_sig", F.coalesce(start, F.col("event_type"))).filter(F.col("_sig").isin(*CONFIRMED_SIGNALS)).groupBy(*keys, F.col("_sig").alias("event_type"), "benchmark").agg(
        F.max(F.when(F.col("event_type") == F.col("_sig"), mean)).alias("_m"), F.max(F.when(F.col("event_type") != F.col("_sig"), mean)).alias("_c")
    )
    better = flag(F.when(up, F.col("_m") > F.col("_c")).otherwise(F.col("_m") < F.col("_c")))
    added = paired.groupBy(*by).agg(F.bool_or(better).alias("comparator_ok"))
    joined = main.join(robust, by, "left").join(added, by, "left").na.fill(False, ["persistence_ok", "robustness_ok", "comparator_ok"])
    gates = (
        ("sample_ok", "SAMPLE_TOO_SMALL"), ("effect_ok", "NO_CLEAR_ECONOMIC_EFFECT"), ("direction_ok", "MEAN_MEDIAN_CONTRADICTION"), ("persistence_ok", "DECLUSTER_OR_EPISODE_NOT_STABLE"),
        ("robustness_ok", "NEIGHBORING_PARAMETER_SENSITIVE"), ("comparator_ok", "CONFIRMATION_ADDS_NO_CLEAR_VALUE"),
    )
    reasons = F.concat_ws(",", *[F.when(~F.col(g), F.lit(r)) for g, r in gates])
    ready = F.col("sample_ok")
    for g, _ in gates[1:]:
        ready = ready & F.col(g)
    return joined.select(*by, *[g for g, _ in gates], ready.alias("ready"), F.when(ready, "ALL_DESCRIPTIVE_GATES_PASSED").otherwise(reasons).alias("reasons"))


def yearly_counts(states: DataFrame, column: str, keys: Sequence[str] = ("market",)) -> DataFrame:
    counts = states.groupBy(*keys, F.year("trade_date").alias("year"), F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "year")))


def month_slice(attached: DataFrame, start: str, end: str, event_type: str = CONFIRMED_SIGNALS[0], horizons: Sequence[int] = (1, 5, 20, 60), keys: Sequence[str] = ("market",)) -> DataFrame:
    """Case study of a date range: per benchmark and horizon the size, mean and median of the events."""
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("event_type") == event_type)
    return attached.filter(inside & F.col("horizon").isin(*horizons)).groupBy(*keys, "benchmark", "horizon").agg(F.count("ret").alias("N"), F.avg("ret").alias("Mean"), median("ret").alias("Median"))


def testing_tally(robustness: DataFrame) -> DataFrame:
    return robustness.agg(
        F.count_distinct("benchmark").alias("benchmarks"), F.count_distinct("horizon").alias("horizons"), F.count_distinct("event_type").alias("primary_signal_types"),
        F.count_distinct("parameter", "value").alias("robustness_parameter_values"), count_true(F.col("parameter_sensitivity_warning") == "THRESHOLD_SENSITIVE").alias("threshold_sensitive_cells"),
    )


def self_checks(states: DataFrame, attached: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Invalid days reset, entries follow the signal day, no interpolated prices."""
    reset = states.filter("state = 'DATA_INVALID'").groupBy(*keys).agg(F.bool_and((F.col("signal") == "NONE") & F.col("smoothed_temperature").isNull()).alias("invalid_date_state_reset"))
    entries = attached.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.col("entry_date") > F.col("date")), F.lit(True)).alias("entry_after_signal_close"), F.bool_and(F.col("price_status") != "INTERPOLATED").alias("no_price_interpolation")
    )
    return entries.join(reset, list(keys), "left").na.fill(True, ["invalid_date_state_reset"])
