"""Canonical table schemas and the ``conform`` step that every raw table passes once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import parse_trade_date



BARS = (
    "market string, ts_code string, trade_date date, open double, high double, low double, close double, "
    "pre_close double, volume double, amount_rmb double, pct_chg double, name string, exchange string, board string, "
    "is_st int, list_date date, delist_date date, universe_count int, row_seq bigint"
)
LIMITS = (
    "market string, ts_code string, trade_date date, is_limit_up boolean, is_limit_down boolean, limit_method string, "
    "limit_up_source string, limit_down_source string, limit_up_status string, limit_down_status string, row_seq bigint"
)
INDEX_BARS = "market string, benchmark string, trade_date date, open double, high double, low double, close double, row_seq bigint"
QUOTES = (
    "quote_time timestamp, market string, ts_code string, name string, open double, high double, low double, close double, "
    "pre_close double, volume double, amount_rmb double"
)
SECURITIES = "market string, ts_code string, name string, exchange string, list_status string, list_date date, delist_date date, row_seq bigint"


def fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(",")]


def _typed(column: str, kind: str) -> Column:
    value = F.col(column)
    if kind == "date":
        return parse_trade_date(value)
    if kind == "double":
        number = value.try_cast("double")
        return F.when(~F.isnan(number), number)
    return value.try_cast(kind)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Cast to the canonical schema: missing optional columns become typed NULL, NaN becomes NULL,
    unparsable text becomes NULL. A column already of the target type passes through untouched, so
    filters still reach the scan."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = []
    for name, kind in fields(ddl):
        if name not in have:
            out.append(F.lit(None).cast(kind).alias(name))
        elif have[name] == kind and kind != "double":
            out.append(F.col(name))
        else:
            out.append(_typed(name, kind).alias(name))
    return df.select(*out)


def require(df: DataFrame, columns: set[str], what: str) -> None:
    missing = columns - set(df.columns)
    if missing:
        raise ValueError(f"{what} is missing columns: {sorted(missing)}")
