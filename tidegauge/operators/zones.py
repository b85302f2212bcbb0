"""Temperature zones with hysteresis as composed daily maps.

A day turns each zone of the day before into one of its own, so it is a map of {HOT, NORMAL, COLD} to itself, and a stretch of
days is the composition of its maps. Maps compose in any grouping: the days of a series are cut into blocks of calendar days
that different tasks take, and only one map a block is walked in order. Native expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import flag

ZONES = ("HOT", "NORMAL", "COLD")
HOT, NORMAL, COLD = range(3)
BLOCK_DAYS = 64
LAST_BLOCK = 2**31 - 1
"""Rows without a day come after all others."""


def _map(hot: Column | int, normal: Column | int, cold: Column | int) -> Column:
    return F.array(*[F.lit(z) if isinstance(z, int) else z for z in (hot, normal, cold)])


def _then(earlier: Column, later: Column) -> Column:
    return F.transform(earlier, lambda zone: F.get(later, zone))


def _composed(maps: Column) -> Column:
    return F.aggregate(maps, _map(HOT, NORMAL, COLD), _then)


def zone_map(value: Column, cool: Column, warm: Column, band: Column) -> Column:
    """The zone after a day with ``value``, for each zone before it; the band makes the exit wider than the entry."""
    high, low = value >= warm, value <= cool
    return _map(
        F.when(value >= warm - band, HOT).when(low, COLD).otherwise(NORMAL),
        F.when(high, HOT).when(low, COLD).otherwise(NORMAL),
        F.when(value <= cool + band, COLD).when(high, HOT).otherwise(NORMAL),
    )


def compose_maps(df: DataFrame, name: str, daily: Column, keys: Sequence[str], start: int, order: str = "trade_date") -> DataFrame:
    """Adds the place that ``start`` has come to after each row's map ``daily``, in order of the day, days missing last.

    A row composes the maps of its block up to itself (``BLOCK_DAYS`` rows at most where days are unique); a block's last map
    stands for the block, and a series' blocks are walked once.
    """
    block, upto, at, begin = "_map_block", "_map_upto", "_map_at", "_map_begin"
    number = F.floor(F.date_diff(F.col(order), F.lit("1970-01-01").cast("date")) / BLOCK_DAYS).cast("int")
    inside = Window.partitionBy(*keys, block).orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    mapped = df.withColumns({block: F.coalesce(number, F.lit(LAST_BLOCK)), upto: daily})
    rows = mapped.withColumns({upto: _composed(F.collect_list(upto).over(inside)), at: F.row_number().over(inside)})
    whole = rows.groupBy(*keys, block).agg(F.max_by(upto, at).alias("m"))
    series = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(block, "m"))).alias("blocks"))
    walk = F.aggregate(
        "blocks",
        F.struct(F.lit(start).alias("z"), F.array().cast(f"array<struct<{block}: int, {begin}: int>>").alias("begins")),
        lambda s, b: F.struct(F.get(b["m"], s["z"]).alias("z"), F.concat(s["begins"], F.array(F.struct(b[block].alias(block), s["z"].alias(begin)))).alias("begins")),
    )
    begins = series.select(*[F.col(k).alias(f"_map_key_{i}") for i, k in enumerate(keys)], F.explode(walk["begins"]).alias("b"))
    begins = begins.select(*[f"_map_key_{i}" for i in range(len(keys))], F.col(f"b.{block}").alias("_map_own"), F.col(f"b.{begin}").alias(begin))
    same = F.col(block) == F.col("_map_own")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_map_key_{i}"))
    placed = rows.join(begins, same).withColumn(name, F.get(upto, F.col(begin)))
    return placed.select(*df.columns, name)


def add_zones(indicators: DataFrame, keys: Sequence[str] = ("market",), p: str = "p") -> DataFrame:
    """``zone_state`` of every row of the regime indicators, each series with the thresholds of its own ``p`` struct.

    Invalid days (no raw or smoothed temperature) are DATA_INVALID and keep the zone for the next valid day. A series begins in
    no zone, which acts as NORMAL. An empty table gives no rows; a null key is a series of its own.
    """
    t = lambda name: F.col(f"{p}.{name}")
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    valid = flag(F.col("regime_valid_observation")) & ~missing("raw_temperature") & ~missing("smoothed_temperature")
    own = zone_map(F.col("smoothed_temperature"), t("cool_threshold"), t("warm_threshold"), t("zone_hysteresis"))
    daily = F.when(valid, own).otherwise(_map(HOT, NORMAL, COLD))
    found = compose_maps(indicators, "_zone", daily, [*keys, "variant_id"], NORMAL)
    return found.withColumn("zone_state", F.when(valid, F.get(F.array(*[F.lit(z) for z in ZONES]), F.col("_zone"))).otherwise("DATA_INVALID")).drop("_zone")
