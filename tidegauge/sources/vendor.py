"""Landed vendor payloads to canonical rows: daily files, JSON arrays, quote text, limit pools, universes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import flag
from ..functions.text import BJ_PREFIXES, SH_PREFIXES, SZ_PREFIXES, board_of, is_st_name, limit_pct, number, parse_trade_date, six_digits, starts_with_any
from ..operators.panel import keep_first, keep_last

# Vendor field names and positions.
HEADER_NAMES = {
    "日期": "trade_date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount", "振幅": "amplitude", "涨跌幅": "pct_chg", "涨跌额": "change", "换手率": "turnover_rate",
}
HISTORY_NAMES = {"date": "trade_date", "preclose": "pre_close", "pctChg": "pct_chg", "turn": "turnover_rate", "isST": "is_st"}
SNAPSHOT_FIELDS = {
    "f2": "close", "f3": "pct_chg", "f5": "volume", "f6": "amount_rmb", "f8": "turnover_rate", "f12": "code", "f13": "venue", "f14": "name", "f15": "high", "f16": "low", "f17": "open", "f18": "pre_close", "f124": "quote_time",
}
KLINE_FIELDS = ("trade_date", "open", "close", "high", "low", "volume", "amount_rmb", "amplitude", "pct_chg", "change", "turnover_rate")
QUOTE_PATTERN = r'v_((?:sh|sz)\d+)="([^"]*)"'
QUOTE_POSITIONS = {"name": 1, "close": 3, "pre_close": 4, "open": 5, "volume": 6, "quote_time": 30, "pct_chg": 32, "high": 33, "low": 34}
DAY_POSITIONS = {"open": 1, "close": 2, "high": 3, "low": 4, "volume": 5, "pct_chg": 7, "amount_rmb": 8}
EMPTY_STATS = ("", "NAN", "NONE", "NA", "N/A", "0", "0.0")
PRICE_TOLERANCE = 1e-8
BAND_TOLERANCE = 0.20
MARKET_TIMEZONE = "Asia/Shanghai"


def normalize_daily(df: DataFrame) -> DataFrame:
    """Vendor daily rows: ``vol`` becomes ``volume``; ``amount`` (thousands) becomes ``amount_rmb``."""
    out = df.withColumnRenamed("vol", "volume").withColumn("trade_date", parse_trade_date("trade_date"))
    return out.withColumn("amount_rmb", number("amount") * 1000.0) if "amount" in df.columns else out


def drop_suspended(df: DataFrame) -> DataFrame:
    """Remove zero-activity rows that only carry the last close."""
    zero = lambda c: flag(number(c) == 0)
    idle = zero("open") & zero("high") & zero("low") & zero("volume") & zero("amount") & flag(number("close") > 0)
    return df.filter(~idle)


def enrich_with_universe(panel: DataFrame, master: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Attach name, exchange and listing dates of the security master; rows outside it drop out.

    The master holds one row per security; the planner broadcasts it only below its size threshold.
    """
    size = master.groupBy(*keys).agg(F.count("*").cast("int").alias("universe_count"))
    slim = master.select(*keys, "ts_code", "name", "exchange", "list_date", "delist_date").join(size, list(keys))
    kept = panel.drop("name", "exchange", "list_date", "delist_date", "universe_count", "is_st")
    return kept.join(slim, [*keys, "ts_code"]).withColumn("is_st", is_st_name("name").cast("int"))


def join_daily_basic(prices: DataFrame, basics: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Left join of daily indicators; columns both sides have get a ``_basic`` suffix."""
    on = [*keys, "ts_code", "trade_date"]
    clashes = {c: f"{c}_basic" for c in basics.columns if c in prices.columns and c not in on}
    return prices.join(basics.withColumnsRenamed(clashes), on, "left")


def security_universe(raw: DataFrame, statuses: Sequence[str] = ("L",), include_beijing: bool = False, exclude_st: bool = True, max_symbols: int | None = None, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Investable universe per market. Where the exchange field is useless for a whole market, the code
    suffix decides instead."""
    listed = raw.filter(F.col("list_status").isin(*statuses))
    latest = keep_last(listed, [*keys, "ts_code"])
    allowed = ["SSE", "SZSE", *(["BSE"] if include_beijing else [])]
    by_exchange = flag(F.col("exchange").isin(*allowed))
    by_suffix = flag(F.col("ts_code").rlike(r"\.(SH|SZ" + ("|BJ" if include_beijing else "") + ")$"))
    usable = latest.groupBy(*keys).agg(F.bool_or(by_exchange).alias("_usable"))
    chosen = latest.join(usable, list(keys)).filter(F.when(F.col("_usable"), by_exchange).otherwise(by_suffix) & flag(F.col("ts_code").rlike(r"\.(SH|SZ|BJ)$"))).drop("_usable")
    if exclude_st:
        chosen = chosen.filter(~is_st_name("name"))
    if max_symbols is not None:
        w = Window.partitionBy(*keys).orderBy("ts_code")
        chosen = chosen.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_symbols).drop("_n")
    return chosen


def board_universe(raw: DataFrame, basics: DataFrame | None = None, include_beijing: bool = False, exclude_st: bool = True, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Universe from ``venue.code`` identifiers by board prefix, active rows only."""
    text = F.lower("vendor_code")
    venue, code = F.regexp_extract(text, r"^([^.]+)\.(\d+)$", 1), six_digits(F.regexp_extract(text, r"^([^.]+)\.(\d+)$", 2))
    allowed = ((venue == "sh") & starts_with_any(code, SH_PREFIXES)) | ((venue == "sz") & starts_with_any(code, SZ_PREFIXES))
    if include_beijing:
        allowed = allowed | ((venue == "bj") & starts_with_any(code, BJ_PREFIXES))
    kept = raw.filter(allowed & (F.coalesce(number("trade_status"), F.lit(1.0)) == 1))
    if exclude_st:
        kept = kept.filter(~is_st_name("name"))
    shaped = kept.select(
        *keys, F.concat(code, F.lit("."), F.upper(venue)).alias("ts_code"), text.alias("vendor_code"), code.alias("code"), venue.alias("venue"),
        F.when(venue == "sh", "SSE").when(venue == "sz", "SZSE").when(venue == "bj", "BSE").alias("exchange"), "name", board_of(code).alias("board"), "row_seq",
    )
    if basics is not None:
        extra = basics.select(*keys, F.lower("vendor_code").alias("vendor_code"), F.col("name").alias("_name"), parse_trade_date("list_date").alias("list_date"), parse_trade_date("delist_date").alias("delist_date"))
        shaped = shaped.join(extra, [*keys, "vendor_code"], "left").withColumn("name", F.coalesce("name", "_name")).drop("_name")
    else:
        shaped = shaped.withColumns({c: F.lit(None).cast("date") for c in ("list_date", "delist_date")})
    return keep_first(shaped, [*keys, "ts_code"])


def normalize_history(df: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Vendor history columns to canonical ones; the change is derived for securities that never report it."""
    out = df.withColumnsRenamed(HISTORY_NAMES)
    numeric = [c for c in ("open", "high", "low", "close", "pre_close", "volume", "amount", "turnover_rate", "pct_chg", "is_st") if c in out.columns]
    out = out.withColumns({**{c: number(c) for c in numeric}, "trade_date": parse_trade_date("trade_date")})
    if "pct_chg" not in out.columns:
        out = out.withColumn("pct_chg", F.lit(None).cast("double"))
    reported = F.count("pct_chg").over(Window.partitionBy(*keys, "ts_code"))
    change = (F.col("close") / F.nullif(F.col("pre_close"), F.lit(0.0)) - 1.0) * 100.0
    return out.withColumn("_n", reported).withColumns({"pct_chg": F.when(F.col("_n") == 0, change).otherwise(F.col("pct_chg")), "amount_rmb": F.col("amount")}).drop("_n")


def _previous_close() -> Column:
    return F.col("close") / F.nullif(1.0 + F.col("pct_chg") / 100.0, F.lit(0.0))


def parse_kline_csv(landed: DataFrame, payload: str = "payload", keys: Sequence[str] = ("market", "ts_code")) -> DataFrame:
    """JSON with an array of comma-separated bars to typed rows."""
    doc = F.from_json(payload, "data struct<klines: array<string>>")
    parts = landed.select(*keys, F.explode(doc["data"]["klines"]).alias("_k")).withColumn("_p", F.split("_k", ","))
    typed = parts.select(*keys, parse_trade_date(F.get("_p", F.lit(0))).alias("trade_date"), *[number(F.get("_p", F.lit(i))).alias(n) for i, n in enumerate(KLINE_FIELDS) if i])
    return typed.withColumn("pre_close", _previous_close())


def parse_quote_text(landed: DataFrame, payload: str = "payload", fallback_date: str | None = None, keys: Sequence[str] = ("market",)) -> DataFrame:
    """``v_sh600000="…~…"`` lines to quotes; entries with fewer than 36 fields are skipped."""
    symbols = F.regexp_extract_all(payload, F.lit(QUOTE_PATTERN), F.lit(1))
    bodies = F.regexp_extract_all(payload, F.lit(QUOTE_PATTERN), F.lit(2))
    pairs = landed.select(*keys, F.explode(F.arrays_zip(symbols.alias("s"), bodies.alias("b"))).alias("q")).select(*keys, F.col("q.s").alias("_s"), F.split("q.b", "~").alias("_f")).filter(F.size("_f") >= 36)
    at = lambda i: F.get("_f", F.lit(i))
    venue = F.when(F.col("_s").startswith("sh"), "SH").otherwise("SZ")
    stamp = F.to_date(F.try_to_timestamp(F.substring(at(30), 1, 8), F.lit("yyyyMMdd")))
    turnover = F.split(at(35), "/")
    quotes = pairs.select(
        *keys, F.coalesce(stamp, F.lit(fallback_date).cast("date")).alias("trade_date"), F.concat(F.substring("_s", 3, 6), F.lit("."), venue).alias("ts_code"), F.when(venue == "SH", "SSE").otherwise("SZSE").alias("exchange"), at(QUOTE_POSITIONS["name"]).alias("name"),
        *[number(at(QUOTE_POSITIONS[c])).alias(c) for c in ("close", "pre_close", "open", "volume", "high", "low", "pct_chg")], number(F.get(turnover, F.lit(2))).alias("amount_rmb"), at(QUOTE_POSITIONS["quote_time"]).alias("quote_time"),
    )
    return quotes.filter(~is_st_name("name"))


def parse_daily_json(landed: DataFrame, start: str, end: str, payload: str = "payload", keys: Sequence[str] = ("market", "ts_code")) -> DataFrame:
    """``data.<symbol>.day|qfqday|hfqday`` arrays to bars within the range."""
    doc = F.from_json(payload, "data map<string, struct<day: array<array<string>>, qfqday: array<array<string>>, hfqday: array<array<string>>>>")
    series = F.explode(F.map_values(doc["data"]))
    rows = landed.select(*keys, series.alias("_v")).select(*keys, F.explode(F.coalesce("_v.day", "_v.qfqday", "_v.hfqday")).alias("_r")).filter(F.size("_r") >= 9)
    at = lambda i: F.get("_r", F.lit(i))
    typed = rows.select(*keys, parse_trade_date(at(0)).alias("trade_date"), *[number(at(i)).alias(n) for n, i in DAY_POSITIONS.items()])
    bounded = typed.filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return bounded.withColumn("pre_close", _previous_close())


def parse_snapshot_list(landed: DataFrame, payload: str = "payload", keys: Sequence[str] = ("market",), exclude_st: bool = True) -> DataFrame:
    """Quote-list records to canonical quotes, newest record per security."""
    record = "struct<" + ", ".join(f"{f}: string" for f in SNAPSHOT_FIELDS) + ">"
    items = landed.select(*keys, F.posexplode(F.from_json(payload, f"array<{record}>")).alias("_i", "_q"))
    named = items.select(*keys, "_i", *[F.col(f"_q.{f}").alias(n) for f, n in SNAPSHOT_FIELDS.items()])
    code = six_digits("code")
    venue = number("venue")
    seconds = number("quote_time")
    stamp = F.from_utc_timestamp(F.timestamp_seconds(seconds), MARKET_TIMEZONE)
    typed = named.withColumns(
        {
            **{c: number(c) for c in ("open", "high", "low", "close", "pre_close", "volume", "amount_rmb", "pct_chg", "turnover_rate")},
            "exchange": F.when(venue == 0, "SZSE").when(venue == 1, "SSE"),
            "ts_code": F.concat(code, F.lit("."), F.when(venue == 0, "SZ").when(venue == 1, "SH").otherwise("")),
            "quote_time": stamp,
            "is_st": F.lit(False),
        }
    ).filter(F.col("exchange").isNotNull() & flag(F.col("close") > 0))
    if exclude_st:
        typed = typed.filter(~is_st_name("name"))
    return keep_last(typed, [*keys, "ts_code"], F.struct(F.col("quote_time"), F.col("_i"))).drop("_i", "code", "venue")


def rename_headers(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(HEADER_NAMES)


def limit_flags_from_pool(pool: DataFrame, assume: str | None = None, keys: Sequence[str] = ("market", "trade_date")) -> DataFrame:
    """Direction flags of a limit-pool delivery: explicit fields first, the pool's own side when a
    delivery (``keys``: one market's day) has no direction fields at all, and price against limit price on top."""
    have = set(pool.columns)
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("")
    positive = pool.filter(flag(number("close") > 0)) if "close" in have else pool
    kind, up, down = F.upper(text("limit_type")), F.upper(text("up_stat")), F.upper(text("down_stat"))
    is_up = (kind == "U") | ~up.isin(*EMPTY_STATS)
    is_down = (kind == "D") | ~down.isin(*EMPTY_STATS)
    marked = positive
    if assume:
        explicit = positive.groupBy(*keys).agg(F.bool_or((text("limit_type") != "") | (text("up_stat") != "") | (text("down_stat") != "")).alias("_explicit"))
        marked = positive.join(explicit, list(keys))
        guess = ~F.col("_explicit")
        is_up, is_down = (is_up | guess, is_down) if assume.upper() == "U" else (is_up, is_down | guess)
    if {"close", "up_limit"} <= have:
        is_up = is_up | flag(number("close") >= number("up_limit") - PRICE_TOLERANCE)
    if {"close", "down_limit"} <= have:
        is_down = is_down | flag(number("close") <= number("down_limit") + PRICE_TOLERANCE)
    out = marked.withColumns({"is_limit_up": is_up, "is_limit_down": is_down, "limit_method": F.lit("limit_list_d")})
    return out.drop("_explicit")


def limit_flags_from_prices(limit_prices: DataFrame, closes: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    joined = limit_prices.join(closes.select(*keys, "ts_code", "trade_date", "close"), [*keys, "ts_code", "trade_date"], "left")
    up = flag(F.col("close") >= F.col("up_limit") - PRICE_TOLERANCE)
    down = flag(F.col("close") <= F.col("down_limit") + PRICE_TOLERANCE)
    status = lambda c: F.when(c, "REAL_ROWS").otherwise("REAL_ZERO")
    return joined.withColumns(
        {
            "is_limit_up": up, "is_limit_down": down, "limit_method": F.lit("stk_limit"), "limit_up_source": F.lit("stk_limit"), "limit_down_source": F.lit("stk_limit"), "limit_up_status": status(up), "limit_down_status": status(down),
        }
    )


def limit_flags_board_band(panel: DataFrame, exclude_st: bool = True) -> DataFrame:
    """Approximate flags from the board's price band; tagged so that production scoring can refuse them."""
    base = panel.filter(F.coalesce(F.col("is_st"), F.lit(0)) != 1) if exclude_st else panel
    band = limit_pct("ts_code")
    up, down = flag(F.col("pct_chg") >= band - BAND_TOLERANCE), flag(F.col("pct_chg") <= -band + BAND_TOLERANCE)
    return base.withColumns({"limit_pct": band, "is_limit_up": up, "is_limit_down": down, "limit_method": F.lit("baostock_board_band_approximation")}).filter(F.col("is_limit_up") | F.col("is_limit_down"))


def merge_limit_pools(up_pool: DataFrame, down_pool: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Union of both pools: flags are OR-ed per security and day, metadata comes from the first row."""
    on = [*keys, "ts_code", "trade_date"]
    both = up_pool.unionByName(down_pool, allowMissingColumns=True)
    meta = [c for c in both.columns if c not in (*on, "is_limit_up", "is_limit_down")]
    return both.groupBy(*on).agg(
        F.bool_or(flag(F.col("is_limit_up"))).alias("is_limit_up"), F.bool_or(flag(F.col("is_limit_down"))).alias("is_limit_down"), F.min_by(F.struct(*meta), "row_seq").alias("_m")
    ).select(*on, "is_limit_up", "is_limit_down", "_m.*")


def pool_status(pool: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Per day and side: REAL_ROWS when any row is flagged, else a real zero."""
    status = lambda c: F.when(F.bool_or(flag(F.col(c))), "REAL_ROWS").otherwise("REAL_ZERO")
    return pool.groupBy(*keys, "trade_date").agg(status("is_limit_up").alias("limit_up_status"), status("is_limit_down").alias("limit_down_status"))
