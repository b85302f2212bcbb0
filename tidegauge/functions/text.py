"""Expressions for vendor dates, security codes and typed parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .series import col, flag

# Board prefixes, limit bands and the ST marker used by the exchanges.
SH_PREFIXES = ("600", "601", "603", "605", "688", "689")
SZ_PREFIXES = ("000", "001", "002", "003", "300", "301")
BJ_PREFIXES = ("4", "8", "92")
STAR_PREFIXES = ("688", "689")
CHINEXT_PREFIXES = ("300", "301")
ST_PATTERN = r"(?i)\*?ST"


def starts_with_any(value: str | Column, prefixes: tuple[str, ...]) -> Column:
    return col(value).rlike("^(" + "|".join(prefixes) + ")")


def is_st_name(name: str | Column) -> Column:
    return flag(col(name).rlike(ST_PATTERN))


def parse_trade_date(raw: str | Column) -> Column:
    """Vendor day: yyyyMMdd (text, integer or ``20200101.0``), ISO, slashes or a timestamp text; else NULL."""
    text = F.trim(col(raw).cast("string"))
    digits = F.regexp_replace(F.regexp_replace(text, r"\.0$", ""), r"[-/]", "")
    compact = F.when(digits.rlike(r"^\d{8}$"), digits)
    return F.coalesce(
        F.to_date(F.try_to_timestamp(compact, F.lit("yyyyMMdd"))),
        F.to_date(F.try_to_timestamp(F.regexp_replace(text, "/", "-"))),
    )


def number(raw: str | Column) -> Column:
    """Numeric text to double; anything unparsable, NaN included, becomes NULL."""
    value = col(raw).try_cast("double")
    return F.when(~F.isnan(value), value)


def six_digits(code: str | Column) -> Column:
    code = col(code).cast("string")
    return F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)


def board_of(code: str | Column) -> Column:
    code = six_digits(code)
    return (
        F.when(starts_with_any(code, STAR_PREFIXES), "STAR")
        .when(starts_with_any(code, CHINEXT_PREFIXES), "ChiNext")
        .when(starts_with_any(code, BJ_PREFIXES), "BSE")
        .otherwise("MAIN")
    )


def limit_pct(ts_code: str | Column) -> Column:
    code = six_digits(F.split(col(ts_code), r"\.")[0])
    return (
        F.when(starts_with_any(code, CHINEXT_PREFIXES + STAR_PREFIXES), 20.0)
        .when(starts_with_any(code, BJ_PREFIXES), 30.0)
        .otherwise(10.0)
    )


def decimals(value: str | Column, places: int) -> Column:
    """Fixed-point text, exact ties to even (as printf does on the binary value)."""
    return F.call_function("format_number", col(value), F.lit("0." + "0" * places))
