"""Column builders for trailing, valid-observation-only and forward windows.

All of them are native expressions over ``Window.partitionBy(*keys).orderBy(order)``. A series holds one
row per key and trading day, so a window partition is bounded by the length of the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str | Column]


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ordered(keys: Keys, order: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(keys: Keys, n: int, order: str = "trade_date") -> WindowSpec:
    return ordered(keys, order).rowsBetween(-(n - 1), 0)


def ahead(keys: Keys, n: int, order: str = "trade_date") -> WindowSpec:
    return ordered(keys, order).rowsBetween(1, n)


def running(keys: Keys, order: str = "trade_date") -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys: Keys, order: str = "trade_date") -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def flag(condition: Column) -> Column:
    """A comparison that is false, not NULL, when an operand is missing."""
    return F.coalesce(condition, F.lit(False))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Division with NULL for a zero denominator."""
    return col(numerator) / F.nullif(col(denominator).cast("double"), F.lit(0.0))


def count_true(condition: Column) -> Column:
    return F.count_if(condition)


def rolling(agg: Callable[[Column], Column], value: str | Column, n: int, keys: Keys, order: str = "trade_date", min_periods: int | None = None) -> Column:
    """Trailing aggregate over ``n`` rows, NULL until ``min_periods`` non-null values are present."""
    window = trailing(keys, n, order)
    value = col(value)
    enough = F.count(value).over(window) >= (n if min_periods is None else min_periods)
    return F.when(enough, agg(value).over(window))


def mid_rank_percentile(value: str | Column, keys: Keys, lookback: int, min_periods: int, bearish: bool = False, order: str = "trade_date") -> Column:
    """Trailing percentile in 0..100 of the current value, ties at mid-rank; no later row is read."""
    value = col(value)
    seen = F.collect_list(value).over(trailing(keys, lookback, order))
    less = F.size(F.filter(seen, lambda v: v < value))
    ties = F.size(F.filter(seen, lambda v: v == value))
    n = F.size(seen)
    score = (less + 0.5 * ties) / n * 100.0
    score = 100.0 - score if bearish else score
    return F.when(value.isNotNull() & (n >= min_periods), score)


def trailing_winsorize(value: str | Column, keys: Keys, lookback: int, min_periods: int, lower: float, upper: float, order: str = "trade_date") -> Column:
    """Clip to trailing linear-interpolated quantiles."""
    if not 0 <= lower < upper <= 1:
        raise ValueError("winsorization limits must satisfy 0 <= lower < upper <= 1")
    value = col(value)
    seen = F.array_sort(F.collect_list(value).over(trailing(keys, lookback, order)))
    n = F.size(seen)

    def quantile(p: float) -> Column:
        position = F.lit(p) * (n - 1)
        low = F.floor(position)
        high = F.least(low + 1, n - 1)
        left, right = F.get(seen, low.cast("int")), F.get(seen, high.cast("int"))
        return left + (right - left) * (position - low)

    enough = n >= min_periods
    bounded = F.least(F.greatest(value, F.when(enough, quantile(lower))), F.when(enough, quantile(upper)))
    return F.when(value.isNotNull(), bounded)


def degenerate_mask(value: str | Column, keys: Keys, window: int, max_unique: int, minimum_valid: int, variance_floor: float, order: str = "trade_date") -> Column:
    """True where the trailing window is too empty or too flat to carry weight."""
    value = col(value)
    w = trailing(keys, window, order)
    return (
        (F.count(value).over(w) < minimum_valid)
        | (F.size(F.collect_set(value).over(w)) <= max_unique)
        | (F.coalesce(F.var_pop(value).over(w), F.lit(0.0)) <= variance_floor)
    )


BLOCK = 64
"""Rows that one fold of ``recursive_scan`` reaches over."""

Step = Callable[[Column, Column], Column]


def recursive_scan(df: DataFrame, steps: Mapping[str, tuple[Column, Step]], keys: Sequence[str], order: str = "trade_date") -> DataFrame:
    """Adds y = step(y', x) for each name of ``steps`` (x, step), a double; y' is the series' row before, NULL at its start.

    A series is walked once, from block to block of ``BLOCK`` rows, to find what each block starts with; then a row folds the
    rows of its block up to itself. So the work is linear in the series, and each value is rounded as a loop would round it,
    which matters to ranks, where equal values must stay equal. A series' inputs are held as one array, a row each.
    """
    row, block, start = "_scan_row", "_scan_block", "_scan_start"
    inputs = F.struct(*[x.alias(n) for n, (x, _) in steps.items()])
    numbered = df.withColumns({row: F.row_number().over(ordered(keys, order)) - 1, "_scan_x": inputs})
    numbered = numbered.withColumn(block, F.floor(F.col(row) / BLOCK).cast("int"))
    none = F.struct(*[F.lit(None).cast("double").alias(n) for n in steps])

    def advance(values: Column, at: Column) -> Column:
        return F.aggregate(values, at, lambda y, x: F.struct(*[step(y[n], x[n]).cast("double").alias(n) for n, (_, step) in steps.items()]))

    series = numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(row, "_scan_x"))).alias("_scan_rows"))
    walk = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size("_scan_rows") - 1) / BLOCK).cast("int")),
        F.struct(none.alias("y"), F.array().cast(f"array<struct<{', '.join(f'{n}: double' for n in steps)}>>").alias("starts")),
        lambda s, k: F.struct(advance(F.transform(F.slice("_scan_rows", k * BLOCK + 1, F.lit(BLOCK)), lambda r: r["_scan_x"]), s["y"]).alias("y"), F.concat(s["starts"], F.array(s["y"])).alias("starts")),
    )
    starts = series.select(*keys, F.posexplode(walk["starts"]).alias(block, start))
    own = [F.col(f"_scan_key_{i}") for i in range(len(keys))]
    named = starts.select(*[F.col(k).alias(f"_scan_key_{i}") for i, k in enumerate(keys)], F.col(block).alias("_scan_at"), start)
    same = F.col(block) == F.col("_scan_at")
    for k, other in zip(keys, own, strict=True):
        same = same & F.col(k).eqNullSafe(other)
    seen = numbered.withColumn("_scan_seen", F.collect_list("_scan_x").over(running([*keys, block], order))).join(named, same)
    found = seen.withColumn("_scan_y", advance(F.col("_scan_seen"), F.col(start)))
    return found.withColumns({n: F.col(f"_scan_y.{n}") for n in steps}).drop(row, block, start, "_scan_x", "_scan_at", "_scan_seen", "_scan_y", *[f"_scan_key_{i}" for i in range(len(keys))])


def add_valid_ema(df: DataFrame, name: str, value: str | Column, keys: Sequence[str], span: int | Column, order: str = "trade_date") -> DataFrame:
    """EMA over non-null observations; a null row stays null and does not touch the filter.

    The null flag joins the partition keys, so valid rows form their own gap-free series. ``span`` may be a column that is
    constant per key (a parameter grid).
    """
    if not isinstance(span, Column) and span < 1:
        raise ValueError("span must be >= 1")
    alpha = F.lit(2.0) / (span + 1.0) if isinstance(span, Column) else F.lit(2.0 / (span + 1.0))
    value = col(value).cast("double")
    flagged = df.withColumns({"_valid": value.isNotNull(), "_alpha": alpha})
    x = F.struct(value.alias("v"), F.col("_alpha").alias("alpha"))
    scanned = recursive_scan(flagged, {name: (x, lambda y, x: F.when(y.isNull(), x["v"]).otherwise(x["alpha"] * x["v"] + (F.lit(1.0) - x["alpha"]) * y))}, [*keys, "_valid"], order)
    return scanned.withColumn(name, F.when(F.col("_valid"), F.col(name))).drop("_valid", "_alpha")


def valid_lag(value: str | Column, keys: Keys, periods: int, valid: Column | None = None, order: str = "trade_date") -> Column:
    """The value ``periods`` valid observations ago; NULL on an invalid row."""
    value = col(value)
    valid = value.isNotNull() if valid is None else valid
    return F.when(valid, F.lag(value, periods).over(ordered([*keys, valid], order)))


def valid_extreme(value: str | Column, keys: Keys, n: int, maximum: bool, order: str = "trade_date") -> Column:
    """Rolling high or low over the last ``n`` valid observations (shorter at the start)."""
    value = col(value)
    agg = F.max if maximum else F.min
    return F.when(value.isNotNull(), agg(value).over(trailing([*keys, value.isNull()], n, order)))


def add_wilder_means(df: DataFrame, means: Mapping[str, tuple[str, int]], position: str, keys: Sequence[str], order: str = "trade_date") -> DataFrame:
    """Wilder averages, each of a column over a window: row ``window`` (0-based) is the mean of rows 1..window, then a 1/window
    update. A missing value after the seed, or an all-missing seed, leaves the rest of the series NULL. No row is forgotten: a ratio of
    two averages needs old rows even where each average alone does not."""
    at, upto = F.col(position), running(keys, order)
    extra: dict[str, Column] = {}
    for name, (value, window) in means.items():
        x = F.col(value)
        extra[f"_seed_{name}"] = F.avg(F.when((at >= 1) & (at <= window), x)).over(upto)
        extra[f"_broken_{name}"] = F.max(F.when(at > window, x.isNull()).otherwise(False)).over(upto)
    seeded = df.withColumns(extra)

    def step(name: str, value: str, window: int) -> tuple[Column, Step]:
        x = F.struct(at.alias("at"), F.when(at == window, F.col(f"_seed_{name}")).otherwise(F.col(value).cast("double")).alias("v"))
        return x, lambda y, x: F.when(x["at"] == window, x["v"]).when(x["at"] > window, (y * (window - 1.0) + x["v"]) / float(window))

    scanned = recursive_scan(seeded, {name: step(name, value, window) for name, (value, window) in means.items()}, keys, order)
    known = {name: (at >= window) & ~F.col(f"_broken_{name}") & F.col(f"_seed_{name}").isNotNull() for name, (_, window) in means.items()}
    return scanned.withColumns({name: F.when(known[name], F.col(name)) for name in means}).drop(*extra)


def island_id(changed: Column, keys: Keys, order: str = "trade_date") -> Column:
    """Number of the run a row belongs to, given a flag for the first row of each run."""
    return F.sum(changed.cast("int")).over(running(keys, order))


def changed_from_previous(value: str | Column, keys: Keys, order: str = "trade_date") -> Column:
    value = col(value)
    return ~value.eqNullSafe(F.lag(value).over(ordered(keys, order)))
