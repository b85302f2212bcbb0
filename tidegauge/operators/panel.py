"""Panel preparation: de-duplication, previous close, eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import flag
from ..functions.text import is_st_name
from ..params import Windows
from ..schemas import require


def keep_last(df: DataFrame, keys: Sequence[str], order: str | Column = "row_seq") -> DataFrame:
    """Newest row per key. An aggregate, not a window: copies of one key merge before the shuffle, so a
    key with a huge number of copies never lands whole in one task."""
    rest = [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: str | Column = "row_seq") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def valid_price(close: Column, pre_close: Column) -> Column:
    """Row-level validity before any carry-over of closes: positive prices and volume, not ST."""
    return (
        flag(close > 0)
        & flag(pre_close > 0)
        & (F.coalesce(F.col("volume"), F.lit(0.0)) > 0)
        & ~is_st_name("name")
        & (F.coalesce(F.col("is_st"), F.lit(0)) != 1)
    )


def prepare_stock_panel(panel: DataFrame, windows: Windows = Windows(), keys: Sequence[str] = ("market",), dedupe: bool = True) -> DataFrame:
    """One row per (keys, ts_code, trade_date) with filled ``pre_close``/``pct_chg`` and ``is_eligible``.

    ``price_valid`` keeps the row-level validity of the delivered ``pre_close`` for the coverage audit, so
    the panel is walked once. ``next_close``/``next_date`` give each row its successor in the same security.
    """
    require(panel, {"ts_code", "trade_date", "close"}, "stock panel")
    keys = list(keys)
    if dedupe:
        panel = keep_last(panel, [*keys, "ts_code", "trade_date"])
    w = Window.partitionBy(*keys, "ts_code").orderBy("trade_date")
    stepped = panel.withColumns(
        {
            "price_valid": valid_price(F.col("close"), F.col("pre_close")),
            "_lag_close": F.lag("close").over(w),
            "next_close": F.lead("close").over(w),
            "next_date": F.lead("trade_date").over(w),
            "_age": F.row_number().over(w) - 1,
        }
    )
    filled = stepped.withColumn("pre_close", F.coalesce("pre_close", "_lag_close"))
    recent = F.col("_age") < windows.exclude_recent if windows.exclude_recent > 0 else F.lit(False)
    eligible = (
        valid_price(F.col("close"), F.col("pre_close"))
        & (F.col("list_date").isNull() | flag(F.col("trade_date") >= F.col("list_date")))
        & (F.col("delist_date").isNull() | flag(F.col("trade_date") <= F.col("delist_date")))
        & ~recent
    )
    change = (F.col("close") / F.nullif(F.col("pre_close"), F.lit(0.0)) - 1.0) * 100
    return filled.withColumns({"recent_ipo_excluded": recent, "is_eligible": eligible, "pct_chg": F.coalesce("pct_chg", change)}).drop("_lag_close", "_age")


def trading_dates(panel: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Distinct trading days with the following one."""
    days = panel.select(*keys, "trade_date").filter(F.col("trade_date").isNotNull()).distinct()
    return days.withColumn("next_market_date", F.lead("trade_date").over(Window.partitionBy(*keys).orderBy("trade_date")))
