"""Canonical tables derived from the TPC-H-style test tables.

Supplier = security, region = market, order week = trading day. Prices are ``10 + l_quantity`` and
amounts are summed in integer cents, so extremes and sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import mid_rank_percentile, ratio, trailing
from ..params import Percentile, Quality, Windows
from .tables import read_panel, stage_table

# Parameters scaled to about 345 weekly observations.
WINDOWS = Windows(ma_short=4, ma_long=12, high_low=12, turnover_z=12, rsi=14, atr=14, index_ma=4, short_return=5, long_return=20, exclude_recent=2)
PERCENTILE = Percentile(lookback=104, min_periods=26)
QUALITY = Quality(minimum_universe=10, minimum_coverage=0.60, max_cross_module_deviation=0.45, minimum_relative_universe=0.70)
BENCHMARKS = ("IDX0", "IDX1")
HORIZONS = (1, 3, 5, 10, 20, 40, 60)


# Declared schemas spare every read its footer inference.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_panel(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the date of their order and its week, which is worked out once an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("sk"), "l_linenumber", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.date_trunc("week", "o_orderdate").cast("date").alias("trade_date"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def as_ticks(lines: DataFrame) -> DataFrame:
    return lines.select(
        "sk",
        "trade_date",
        (F.lit(10.0) + F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("ord"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its security and trading week."""
    return as_ticks(order_lines(spark, sf_dir))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market of each security."""
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sk"), F.col("r_name").alias("market"))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly OHLCV per security. The lines go by security and week as they are: a bar has about two lines, far apart in the
    order table, so merging before that shuffle would sort all lines, merge next to none and move buffers of twice their
    size. The market is attached to bars, not lines."""
    weekly = (
        as_ticks(order_lines(spark, sf_dir).repartition("sk", "trade_date"))
        .groupBy("sk", "trade_date")
        .agg(
            F.min_by("px", "ord").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "ord").alias("close"),
            F.sum("qty").alias("volume"),
            (F.sum("cents").cast("double") / 100.0).alias("amount_rmb"),
        )
    )
    return weekly.join(venues(spark, sf_dir), "sk").select("market", "sk", "trade_date", "open", "high", "low", "close", "volume", "amount_rmb")


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_bars`` as a stored table, for queries that derive several tables from it."""
    return stage_table(raw_bars(spark, sf_dir), "bars")


def bars(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    by_code = Window.partitionBy("market", "sk")
    return (raw_bars(spark, sf_dir) if raw is None else raw).select(
        "market",
        F.col("sk").cast("string").alias("ts_code"),
        "sk",
        "trade_date",
        "open",
        "high",
        "low",
        "close",
        F.when(F.col("sk") % 13 != 0, F.lag("close").over(by_code.orderBy("trade_date"))).alias("pre_close"),
        "volume",
        "amount_rmb",
        F.lit(None).cast("double").alias("pct_chg"),
        F.when(F.col("sk") % 23 == 0, F.concat(F.lit("*ST "), F.col("sk").cast("string"))).otherwise(F.concat(F.lit("S"), F.col("sk").cast("string"))).alias("name"),
        F.when(F.col("sk") % 17 == 0, 1).otherwise(0).alias("is_st"),
        F.min("trade_date").over(by_code).alias("list_date"),
        F.when(F.col("sk") % 10 == 0, F.lit("2000-06-30").cast("date")).alias("delist_date"),
        F.lit(None).cast("int").alias("universe_count"),
        F.lit(1).cast("bigint").alias("row_seq"),
    )


def bars_with_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars plus an earlier, superseded copy of every fourth security's rows; both copies come of one computation."""
    final = bars(spark, sf_dir)
    copies = F.when(F.col("sk") % 4 == 0, F.array(F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.array(F.lit(1).cast("bigint")))
    return final.withColumn("row_seq", F.explode(copies)).withColumn("close", F.when(F.col("row_seq") == 0, F.col("open")).otherwise(F.col("close")))


def limits(panel: DataFrame) -> DataFrame:
    """Limit moves: a close at least doubled or at most halved against the previous close."""
    move = F.col("close") / F.nullif(F.col("pre_close"), F.lit(0.0)) - 1
    flagged = panel.filter((F.col("pre_close") > 0) & ((move >= 1.0) | (move <= -0.5)))
    up, down = move >= 1.0, move <= -0.5
    return flagged.select(
        "market",
        "ts_code",
        "trade_date",
        up.alias("is_limit_up"),
        down.alias("is_limit_down"),
        F.lit("price_move").alias("limit_method"),
        F.when(F.col("sk") % 2 == 0, "pool_a").otherwise("").alias("limit_up_source"),
        F.when(F.col("sk") % 3 == 0, "pool_b").alias("limit_down_source"),
        F.when(up, "REAL_ROWS").alias("limit_up_status"),
        F.when(down & (F.col("sk") % 5 != 0), "REAL_ROWS").when(down, "APPROX_LIST").alias("limit_down_status"),
        F.col("sk").alias("row_seq"),
    )


def index_bars(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """Two benchmarks per market: the average bar of even and of odd securities."""
    return (
        (raw_bars(spark, sf_dir) if panel is None else panel)
        .groupBy("market", F.concat(F.lit("IDX"), (F.col("sk") % 2).cast("string")).alias("benchmark"), "trade_date")
        .agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")])
    )


def regime_daily(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """A compact temperature table for the regime, advisory and event layers.

    Each module is the trailing percentile of a three-week ratio of integer sums; the raw temperature is
    the trailing percentile of the module average. A week that trades far fewer securities than the best
    of the last twelve is INVALID.
    """
    keys = ["market"]
    by_code = Window.partitionBy("market", "sk").orderBy("trade_date")
    moved = (raw_bars(spark, sf_dir) if raw is None else raw).select("market", "sk", "trade_date", "close", "volume", F.lag("close").over(by_code).alias("pre"))
    weekly = (
        moved.filter(F.col("pre").isNotNull())
        .groupBy("market", "trade_date")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("close") > F.col("pre")).alias("up"),
            F.count_if(F.col("close") < F.col("pre")).alias("down"),
            F.count_if(F.col("close") >= F.col("pre") * 1.5).alias("jump"),
            F.sum("volume").alias("vol"),
            F.sum("close").alias("c"),
            F.sum("pre").alias("p"),
        )
    )
    w3 = trailing(keys, 3)
    three = weekly.select(
        "market",
        "trade_date",
        "n",
        F.max("n").over(trailing(keys, 12)).alias("best"),
        *[F.sum(c).over(w3).alias(c + "3") for c in ("n", "up", "down", "jump", "vol", "c", "p")],
    ).select(
        "market",
        "trade_date",
        "n",
        "best",
        ratio("up3", F.col("up3") + F.col("down3")).alias("f_breadth"),
        ratio("jump3", "n3").alias("f_profit"),
        F.col("vol3").cast("double").alias("f_liquidity"),
        ratio("c3", "p3").alias("f_stretch"),
    )
    scored = three.select(
        "market",
        "trade_date",
        "n",
        "best",
        *[
            mid_rank_percentile(f, keys, 104, 13).alias(name)
            for f, name in (
                ("f_breadth", "breadth_score"),
                ("f_profit", "profit_effect_score"),
                ("f_liquidity", "liquidity_score"),
                ("f_stretch", "stretch_score"),
            )
        ],
    ).withColumn("mean_score", (F.col("breadth_score") + F.col("profit_effect_score") + F.col("liquidity_score") + F.col("stretch_score")) / 4.0)
    quality = F.when(F.col("n") * 4 < F.col("best") * 3, "INVALID").when(F.col("n") == F.col("best"), "A").when(F.col("n") * 10 >= F.col("best") * 9, "B").otherwise("C")
    return scored.select(
        "market",
        "trade_date",
        mid_rank_percentile("mean_score", keys, 104, 13).alias("raw_market_temperature"),
        "breadth_score",
        "profit_effect_score",
        "liquidity_score",
        "stretch_score",
        quality.alias("market_temperature_quality"),
        F.when(quality == "A", "").otherwise("SURVIVORSHIP_BIAS_WARNING;OPTIONS_UNAVAILABLE").alias("data_quality_warnings"),
        F.col("n").cast("bigint").alias("observed_universe"),
        F.col("best").cast("bigint").alias("expected_eligible_count"),
    )


# Polls of a live week: clock time, and how many days of the week have traded by then. The first brings the week before's quotes.
POLLS = (("09:40:00", 0), ("12:00:00", 4), ("15:05:00", 7))


def live_polls(spark: SparkSession, sf_dir: str, week: str, panel: DataFrame | None = None) -> DataFrame:
    """Quotes as a vendor would land them during ``week``, taken as one trading day: each poll has every security's prices
    and accumulated turnover so far, stamped a minute (at lunch half an hour) before. The first poll still has the stamps and prices of the
    week before, and at every poll a second source repeats each third security."""
    day = F.lit(week).cast("date")
    at = {n: F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(clock))) for n, (clock, _) in enumerate(POLLS)}
    own = ticks(spark, sf_dir).filter((F.col("trade_date") == day) | (F.col("trade_date") == F.date_sub(day, 7)))
    reach = F.when(F.col("trade_date") < day, F.array(F.lit(0))).otherwise(
        F.filter(F.array(*[F.lit(n) for n in range(1, len(POLLS))]), lambda n: F.array(*[F.lit(days) for _, days in POLLS])[n] > F.weekday(F.col("ord.o_orderdate")))
    )
    seen = own.withColumn("poll", F.explode(reach)).groupBy("sk", "poll").agg(
        F.min_by("px", "ord").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "ord").alias("close"), F.sum("qty").alias("volume"), (F.sum("cents").cast("double") / 100.0).alias("amount_rmb"),
    )
    before = (bars(spark, sf_dir) if panel is None else panel).filter(F.col("trade_date") == day).select("sk", "pre_close")
    landed = F.coalesce(*[F.when(F.col("poll") == n, t) for n, t in at.items()])
    stamp = F.when(F.col("poll") == 0, F.to_timestamp(F.concat(F.date_sub(day, 7).cast("string"), F.lit(" 15:00:00")))).when(F.col("poll") == 1, landed - F.expr("INTERVAL 31 MINUTES")).otherwise(landed - F.expr("INTERVAL 1 MINUTE"))
    rows = seen.join(venues(spark, sf_dir), "sk").join(before, "sk", "left").select(
        landed.alias("landed_at"), stamp.alias("quote_time"), "market", F.col("sk").cast("string").alias("ts_code"), F.lit(None).cast("string").alias("name"), "open", "high", "low", "close", "pre_close", "volume", "amount_rmb",
        F.explode(F.when(F.col("sk") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("source_rank"), "poll",
    )
    return rows.withColumn("source", F.when(F.col("source_rank") == 0, "first").otherwise("second"))
