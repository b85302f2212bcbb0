"""Event catalog, de-clustering and causal forward outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import ahead, flag, ordered
from ..params import HORIZONS
from .panel import keep_first

CONFIRMED_SIGNALS = ("ICE_REVERSAL_CONFIRMED", "HOT_ROLLOVER_CONFIRMED")
WATCH_SIGNALS = ("ICE_REVERSAL_WATCH", "HOT_ROLLOVER_WATCH")
EPISODE_STARTS = ("PANIC_EPISODE_START", "EUPHORIA_EPISODE_START")
EPISODE_DAYS = ("PANIC_EPISODE_DAY", "EUPHORIA_EPISODE_DAY")
EVENT_SETS = ("raw", "declustered", "episode")
DRAWDOWN_HORIZONS = (20, 60)


def is_valid_row() -> Column:
    return flag(F.upper("quality") != "INVALID") & F.col("raw_temperature").isNotNull() & F.col("trade_date").isNotNull()


def event_catalog(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Signal, episode-start and episode-day events of valid rows.

    A day emits its events in place (one explode), so the state table is read once. Days are unique per
    series, so ``TYPE:date`` never repeats and its running number is always 0.
    """
    keys = list(keys)
    valid = is_valid_row()
    placed = states.withColumn("_valid", valid).withColumn("date_position", F.row_number().over(ordered([*keys, "_valid"])) - 1).filter("_valid")

    def event(when: Column, kind: Column, direction: str, number: str) -> Column:
        return F.when(when, F.struct(kind.alias("event_type"), F.lit(direction).alias("direction"), F.col(number).cast("string").alias("episode_id")))

    signal = F.col("signal")
    options = [event(signal.isin(s), signal, "ICE" if s.startswith("ICE") else "HOT", "panic_episode_id" if s.startswith("ICE") else "euphoria_episode_id") for s in (*CONFIRMED_SIGNALS, *WATCH_SIGNALS)]
    for prefix, direction, start, day in (("panic", "ICE", EPISODE_STARTS[0], EPISODE_DAYS[0]), ("euphoria", "HOT", EPISODE_STARTS[1], EPISODE_DAYS[1])):
        active = F.col(f"recent_{prefix}_episode") & F.col(f"{prefix}_episode_id").isNotNull()
        options.append(event(active & (F.col(f"{prefix}_episode_age") == 1), F.lit(start), direction, f"{prefix}_episode_id"))
        options.append(event(active, F.lit(day), direction, f"{prefix}_episode_id"))
    exploded = placed.withColumn("_e", F.explode(F.array_compact(F.array(*options))))
    return exploded.select(
        *keys,
        F.concat(F.col("_e.event_type"), F.lit(":"), F.date_format("trade_date", "yyyy-MM-dd"), F.lit(":0")).alias("event_id"),
        "_e.event_type",
        "_e.direction",
        "_e.episode_id",
        F.col("trade_date").alias("date"),
        F.col("date_position").cast("bigint").alias("date_position"),
        signal.alias("original_signal"),
        F.col("_e.event_type").alias("signal"),
        "raw_temperature",
        "smoothed_temperature",
        "state",
        "quality",
        "confidence",
        F.lit("frozen_state_table").alias("event_source"),
    )


FOLD_BLOCK = 64


def _kept_flags(positions: Column, window: int) -> Column:
    """Greedy scan of sorted positions: one is kept when it lies more than ``window`` after the last kept, or equals it.
    A flag for each, gathered block by block, so that no growing array is copied at every row."""
    flags = F.array().cast("array<boolean>")
    begin = lambda last, nested: F.struct(last.alias("last"), F.array().cast(nested).alias("kept"))

    def merge(acc: Column, p: Column) -> Column:
        take = acc["last"].isNull() | (p - acc["last"] > window)
        return F.struct(F.when(take, p).otherwise(acc["last"]).alias("last"), F.concat(acc["kept"], F.array(flag(take | (p == acc["last"])))).alias("kept"))

    def block(acc: Column, k: Column) -> Column:
        done = F.aggregate(F.slice(positions, k * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)), begin(acc["last"], "array<boolean>"), merge)
        return F.struct(done["last"].alias("last"), F.concat(acc["kept"], F.array(done["kept"])).alias("kept"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(positions) - 1) / FOLD_BLOCK).cast("int"))
    scanned = F.aggregate(blocks, begin(F.lit(None).cast("bigint"), "array<array<boolean>>"), block, lambda acc: F.flatten(acc["kept"]))
    return F.when(F.size(positions) > 0, scanned).otherwise(flags)


def decluster_events(events: DataFrame, mode: str = "raw", window: int = 20, by: Sequence[str] = ("market", "direction")) -> DataFrame:
    """Raw, greedily de-clustered, or first-per-episode events. Positions of one series and direction are
    folded together; there is at most one per trading day and type."""
    if mode not in EVENT_SETS:
        raise ValueError("mode must be raw, declustered or episode")
    if window < 0:
        raise ValueError("window must be non-negative")
    if mode == "raw":
        return events
    order = [F.col("date_position"), F.col("date"), F.col("event_type")]
    if mode == "episode":
        w = Window.partitionBy(*by, "episode_id").orderBy(*order)
        return events.filter(F.col("episode_id").isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    placed = events.groupBy(*by).agg(F.array_sort(F.collect_set("date_position")).alias("at"))
    kept = placed.select(*by, F.explode(F.arrays_zip("at", _kept_flags(F.col("at"), window).alias("kept"))).alias("e")).filter("e.kept").select(*by, F.col("e.at").alias("date_position"))
    first = Window.partitionBy(*by, "date_position").orderBy("date", "event_type")
    return events.join(kept, [*by, "date_position"], "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def event_sets(events: DataFrame, window: int = 20, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Every event once per set it belongs to (raw, declustered, episode), within its event type."""
    by = [*keys, "event_type"]
    rest = [c for c in events.columns if c not in by]
    w = Window.partitionBy(*by, "episode_id").orderBy("date_position")
    firsts = events.withColumn("_first", F.col("episode_id").isNotNull() & (F.row_number().over(w) == 1))
    packed = firsts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("date_position").alias("at"), F.struct(*rest, "_first").alias("r")))).alias("rows"))
    spread = packed.select(*by, F.explode(F.arrays_zip("rows", _kept_flags(F.col("rows.at"), window).alias("kept"))).alias("e")).select(*by, F.col("e.kept").alias("_kept"), "e.rows.r.*")
    sets = F.array_compact(F.array(F.lit("raw"), F.when(F.col("_kept"), F.lit("declustered")), F.when(F.col("_first"), F.lit("episode"))))
    return spread.withColumn("event_set", F.explode(sets)).drop("_kept", "_first").select(*events.columns, "event_set")


def prepare_benchmark(bars: DataFrame, keys: Sequence[str] = ("market", "benchmark")) -> DataFrame:
    """Typed OHLC with missing values left missing; first row per day stays."""
    clean = bars.filter(F.col("trade_date").isNotNull()).withColumns({c: F.col(c).cast("double") if c in bars.columns else F.lit(None).cast("double") for c in ("open", "high", "low", "close")})
    return keep_first(clean, [*keys, "trade_date"]) if "row_seq" in bars.columns else clean


def forward_outcomes(benchmark: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("market", "benchmark")) -> DataFrame:
    """Outcomes of a signal on each benchmark day, computed once per day for all events and variants.

    Entry is the next row's open. A horizon whose window is short or has a missing price stays NULL;
    ``price_status`` is the first problem met in horizon order.
    """
    w = ordered(keys)
    nxt = benchmark.withColumns({"entry_date": F.lead("trade_date").over(w), "entry_price": F.lead("open").over(w)})
    cols: dict[str, Column] = {}
    for h in horizons:
        span = ahead(keys, h)
        cols[f"_rows{h}"] = F.count("*").over(span)
        cols[f"_full{h}"] = (F.count("high").over(span) == h) & (F.count("low").over(span) == h) & (F.count("close").over(span) == h)
        cols[f"_close{h}"] = F.lead("close", h).over(w)
        cols[f"_high{h}"] = F.max("high").over(span)
        cols[f"_low{h}"] = F.min("low").over(span)
        if h in DRAWDOWN_HORIZONS:
            cols[f"_path{h}"] = F.collect_list(F.struct("high", "low")).over(span)
    wide = nxt.withColumns(cols)
    entry, close = F.col("entry_price"), F.col("close")
    priced = entry.isNotNull() & close.isNotNull()
    problems: list[Column] = [
        F.when(F.col("entry_date").isNull(), F.lit("TRUNCATED_HORIZON")),
        F.when(~priced, F.lit("MISSING_PRICE")),
    ]
    results = []
    for h in horizons:
        short = F.col(f"_rows{h}") < h
        problems.append(F.when(short, F.lit("TRUNCATED_HORIZON")).when(~F.col(f"_full{h}"), F.lit("MISSING_PRICE")))
        ok = priced & ~short & F.col(f"_full{h}")
        worst = peak_to_trough(F.col(f"_path{h}")) if h in DRAWDOWN_HORIZONS else F.lit(None).cast("double")
        results.append(
            F.struct(
                F.lit(h).alias("horizon"),
                F.when(ok, F.col(f"_close{h}") / entry - 1.0).alias("ret"),
                F.when(ok, F.col(f"_close{h}") / close - 1.0).alias("close_ret"),
                F.when(ok, F.col(f"_high{h}") / entry - 1.0).alias("mfe"),
                F.when(ok, F.col(f"_low{h}") / entry - 1.0).alias("mae"),
                F.when(ok, worst).alias("ptdd"),
            )
        )
    status = F.coalesce(*problems, F.lit("OK"))
    return wide.select(
        *keys, "trade_date", "entry_date", F.when(F.col("entry_date").isNotNull(), entry).alias("entry_price"),
        F.when(F.col("entry_date").isNotNull(), close).alias("signal_close_price"), status.alias("price_status"), F.explode(F.array(*results)).alias("_o"),
    ).select(*keys, "trade_date", "entry_date", "entry_price", "signal_close_price", "price_status", "_o.*")


def peak_to_trough(path: Column) -> Column:
    """Deepest low against the running high of a bounded forward path."""
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(None).cast("double").alias("worst"))

    def merge(acc: Column, bar: Column) -> Column:
        peak = F.greatest(acc["peak"], bar["high"])
        return F.struct(peak.alias("peak"), F.least(acc["worst"], bar["low"] / peak - 1.0).alias("worst"))

    return F.aggregate(path, start, merge, lambda acc: acc["worst"])


def attach_outcomes(events: DataFrame, outcomes: DataFrame, benchmarks: Sequence[str], horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Events with the outcomes of each benchmark; a day the benchmark lacks is MISSING_PRICE with NULLs."""
    grid = events.withColumn("benchmark", F.explode(F.array(*[F.lit(b) for b in benchmarks]))).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    joined = grid.join(outcomes.withColumnRenamed("trade_date", "date"), [*keys, "benchmark", "date", "horizon"], "left")
    return joined.withColumn("price_status", F.coalesce("price_status", F.lit("MISSING_PRICE")))


def wide_outcomes(attached: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("market",)) -> DataFrame:
    """One row per event and benchmark with suffixed columns per horizon."""
    by = [*keys, "event_id", "event_type", "benchmark", "date", "entry_date", "entry_price", "signal_close_price", "price_status"]
    names = {"ret": "return", "close_ret": "signal_close_forward_return", "mfe": "mfe", "mae": "mae"}
    cells = [F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{n}_{h}d") for h in horizons for c, n in names.items()]
    cells += [F.max(F.when(F.col("horizon") == h, F.col("mae"))).alias(f"future_drawdown_{h}d") for h in horizons]
    cells += [F.max(F.when(F.col("horizon") == h, F.col("ptdd"))).alias(f"future_peak_to_trough_dd_{h}d") for h in DRAWDOWN_HORIZONS if h in horizons]
    return attached.groupBy(*by).agg(*cells)


def future_paths(events: DataFrame, benchmark: DataFrame, benchmarks: Sequence[str], horizon: int = 60, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Closes after each event, next open = 100, as far as the series goes and never padded."""
    by = [*keys, "benchmark"]
    path = F.collect_list(F.struct("close")).over(ahead(by, horizon))
    forward = benchmark.select(*by, F.col("trade_date").alias("date"), F.lead("open").over(ordered(by)).alias("_entry"), path.alias("_path")).filter(F.col("_entry").isNotNull())
    spread = events.withColumn("benchmark", F.explode(F.array(*[F.lit(b) for b in benchmarks]))).join(forward, [*by, "date"])
    return spread.select(*events.columns, "benchmark", "_entry", F.posexplode("_path").alias("_i", "_bar")).select(
        *events.columns, "benchmark", (F.col("_i") + 1).alias("observation"), (F.col("_bar.close") / F.col("_entry") * 100.0).alias("normalized_close")
    )


def median_path(paths: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    return paths.groupBy(*keys, "event_type", "benchmark", "observation").agg(F.count("normalized_close").alias("n"), F.percentile("normalized_close", F.lit(0.5)).alias("median_close"))
