"""Source, sink and ingest-normalisation queries (IN). Landed payloads are built from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import board_of, limit_pct, parse_trade_date
from ..schemas import conform
from ..sources import tables as tb
from ..sources import testdata as td
from ..sources import vendor as vd
from ..sources.snapshots import SnapshotTable
from .base import cte, register

SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
register("in1_read_panel", lambda s, d: tb.read_panel(s, f"{d}/supplier.parquet", SUPPLIER), "s_suppkey:n s_name s_acctbal:f", "supplier")


def saved(spark, d):
    """Full save, then one market delivered again with doubled volumes."""
    table = SnapshotTable(spark, tb.scratch_path(spark, "bars"))
    table.replace(td.bars(spark, d).select("market", "ts_code", "trade_date", "close", "volume"))
    table.replace_where(table.read().filter("market = 'ASIA'").withColumn("volume", F.col("volume") * 2), ["market"])
    return table.read()


register("in2_save_dataset", saved, "market ts_code trade_date close:f volume:f", "(SELECT * REPLACE (CASE WHEN market = 'ASIA' THEN volume * 2 ELSE volume END AS volume) FROM bars)")


def batches(spark, d):
    """An older and a newer batch, cut from bars that are stored once."""
    bars = tb.stage_table(td.bars(spark, d).select("market", "ts_code", "trade_date", "close", "row_seq"), "bars")
    cut = F.lit("2000-01-03").cast("date")
    old = bars.filter(F.col("trade_date") <= F.lit("2000-06-26").cast("date"))
    new = bars.filter(F.col("trade_date") >= cut).withColumn("close", F.col("close") + 1000)
    return old, new


cte("upserted", "SELECT market, ts_code, trade_date, CASE WHEN trade_date >= DATE '2000-01-03' THEN close + 1000 ELSE close END AS close FROM bars")
register("in3_upsert", lambda s, d: tb.upsert(*batches(s, d), ["market", "ts_code", "trade_date"]), "market ts_code trade_date close:f", "upserted")


def upsert_files(spark, d):
    path = tb.scratch_path(spark, "upsert")
    old, new = batches(spark, d)
    year = F.year("trade_date").alias("yr")
    tb.save_dataset(old.select("*", year), path, ["yr"])
    tb.upsert_partitions(spark, path, new.select("*", year), ["market", "ts_code", "trade_date"], "yr")
    return spark.read.parquet(path)


def upsert_deltas(spark, d):
    """The newer rows arrive as three deltas, the last of them twice; the table is read over its deltas, untouched rows as
    they were first written."""
    old, new = batches(spark, d)
    table = SnapshotTable(spark, tb.scratch_path(spark, "upsert"), ["market", "ts_code", "trade_date"], "row_seq")
    table.replace(old)
    for number, (low, high) in enumerate((("2000-01-01", "2000-04-01"), ("2000-04-01", "2000-08-01"), ("2000-08-01", "2100-01-01"))):
        part = new.filter((F.col("trade_date") >= F.lit(low).cast("date")) & (F.col("trade_date") < F.lit(high).cast("date")))
        table.upsert(part, "delivery", number)
    table.upsert(part.withColumn("close", F.lit(-1.0)), "delivery", number)
    return table.read()


register("in3_upsert_deltas", upsert_deltas, "market ts_code trade_date close:f", "upserted")
register("in3_upsert_partitions", upsert_files, "market ts_code trade_date close:f", "upserted")
register("in4_dataset_metadata", lambda s, d: tb.dataset_metadata(td.bars(s, d), "bars", "1", "weekly", ["market"]), "market date_start date_end symbol_count:n row_count:n source version notes",
         "(SELECT market, min(trade_date) AS date_start, max(trade_date) AS date_end, count(DISTINCT ts_code) AS symbol_count, count(*) AS row_count, 'bars' AS source, '1' AS version, 'weekly' AS notes FROM bars GROUP BY market)")
register("in5_incremental_start", lambda s, d: tb.incremental_start(td.bars(s, d), "1999-01-01"), "market start_date", "(SELECT market, greatest(DATE '1999-01-01', max(trade_date) - 5) AS start_date FROM bars GROUP BY market)")


def csv_round_trip(spark, d):
    path = tb.scratch_path(spark, "csv")
    tb.write_csv(td.index_bars(spark, d), path)
    return tb.read_csv(spark, path, "market string, benchmark string, trade_date date, open double, high double, low double, close double")


register("in6_csv_round_trip", csv_round_trip, "market benchmark trade_date open:f close:f", "index_bars")


def vendor_dates(spark, d):
    o = td.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % 6
    style = lambda p: F.date_format("o_orderdate", p)
    raw = F.when(k == 0, style("yyyyMMdd")).when(k == 1, style("yyyy-MM-dd")).when(k == 2, style("yyyy/MM/dd")).when(k == 3, F.concat(style("yyyyMMdd"), F.lit(".0"))).when(k == 4, style("yyyy-MM-dd HH:mm:ss")).otherwise("not a date")
    return o.select("o_orderkey", raw.alias("raw")).withColumn("trade_date", parse_trade_date("raw"))


register("in7_normalize_trade_date", vendor_dates, "o_orderkey:n trade_date", "(SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS date) END AS trade_date FROM orders)")


def daily_files(spark, d):
    return td.bars(spark, d).select("market", "ts_code", F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), F.col("volume").alias("vol"), (F.col("amount_rmb") / 1000).cast("string").alias("amount"))


register("in8_normalize_daily", lambda s, d: vd.normalize_daily(daily_files(s, d)), "market ts_code trade_date volume:f amount_rmb:f", "bars")


def with_halts(spark, d):
    halted = (F.col("sk") % 5 == 0) & (F.col("close") < 20)
    zero = lambda c: F.when(halted, 0.0).otherwise(F.col(c)).alias(c)
    return td.bars(spark, d).select("market", "ts_code", "trade_date", zero("open"), zero("high"), zero("low"), "close", zero("volume"), F.when(halted, 0.0).otherwise(F.col("amount_rmb")).alias("amount"))


register("in9_drop_suspended", lambda s, d: vd.drop_suspended(with_halts(s, d)), "market ts_code trade_date close:f", "bars WHERE NOT (sk % 5 = 0 AND close < 20)")


def master(spark, d):
    """Security master with one row per supplier."""
    venue = td.table(spark, d, "supplier").join(td.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(td.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return venue.select(
        F.col("r_name").alias("market"), F.col("s_suppkey").cast("string").alias("ts_code"), F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("*st"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("N"), F.col("s_suppkey").cast("string"))).alias("name"),
        F.col("n_name").alias("exchange"), F.lit("1995-01-01").cast("date").alias("list_date"), F.lit(None).cast("date").alias("delist_date"),
    )


cte("master", "SELECT r.r_name AS market, CAST(s_suppkey AS varchar) AS ts_code, s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN '*st' || s_suppkey ELSE 'N' || s_suppkey END AS name, n.n_name AS exchange FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
register("in10_enrich_with_universe", lambda s, d: vd.enrich_with_universe(td.bars(s, d), master(s, d)), "market ts_code trade_date name exchange universe_count:n is_st:n",
         "(SELECT b.market, b.ts_code, b.trade_date, m.name, m.exchange, CASE WHEN b.sk % 9 = 0 THEN 1 ELSE 0 END AS is_st, c.n AS universe_count FROM bars b JOIN master m USING (market, ts_code) JOIN (SELECT market, count(*) AS n FROM master GROUP BY market) c ON c.market = b.market)")


def basics(spark, d):
    return td.bars(spark, d).filter(F.col("sk") % 3 == 0).select("market", "ts_code", "trade_date", (F.col("volume") / 100).alias("turnover_rate"), (F.col("close") + 0.5).alias("close"))


register("in11_join_daily_basic", lambda s, d: vd.join_daily_basic(td.bars(s, d).select("market", "ts_code", "trade_date", "close"), basics(s, d)), "market ts_code trade_date close:f turnover_rate:f close_basic:f",
         "(SELECT market, ts_code, trade_date, close, CASE WHEN sk % 3 = 0 THEN volume / 100 END AS turnover_rate, CASE WHEN sk % 3 = 0 THEN close + 0.5 END AS close_basic FROM bars)")

_PREFIX = ("600", "000", "300", "688", "830", "920", "601", "900")
_SUFFIX = ("SH", "SZ", "SZ", "SH", "BJ", "BJ", "SH", "XX")
_VENUE = ("sh", "sz", "sz", "sh", "bj", "bj", "sh", "xx")


def securities(spark, d):
    """Security list from customers: eight boards, repeated codes, three listing statuses, two markets
    whose exchange field is useless."""
    c = td.table(spark, d, "customer")
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % 8 + 1).cast("int"))
    code = F.concat(pick(_PREFIX), F.lpad((k % 997).cast("string"), 3, "0"))
    exchange = F.when(pick(_SUFFIX) == "SH", "SSE").when(pick(_SUFFIX) == "SZ", "SZSE").otherwise("BSE")
    return c.select(
        F.col("c_mktsegment").alias("market"), k.alias("ck"), code.alias("code"), F.concat(code, F.lit("."), pick(_SUFFIX)).alias("ts_code"), F.concat(pick(_VENUE), F.lit("."), code).alias("vendor_code"),
        F.when(k % 13 == 0, F.concat(F.lit("*ST"), k.cast("string"))).otherwise(F.concat(F.lit("C"), k.cast("string"))).alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", None).when(F.col("c_mktsegment") == "MACHINERY", "OTHER").otherwise(exchange).alias("exchange"),
        F.when(k % 5 == 0, "D").when(k % 7 == 0, "P").otherwise("L").alias("list_status"), F.when(k % 11 == 0, "0").otherwise("1").alias("trade_status"),
        F.lit(None).cast("date").alias("list_date"), F.lit(None).cast("date").alias("delist_date"), k.alias("row_seq"),
    )


_at = lambda values: "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
cte("sec0", f"SELECT c_mktsegment AS market, c_custkey AS ck, {_at(_PREFIX)} || lpad(CAST(c_custkey % 997 AS varchar), 3, '0') AS code, {_at(_SUFFIX)} AS suffix, {_at(_VENUE)} AS venue FROM customer")
cte("sec_list", """
SELECT market, ck, code, suffix, venue, code || '.' || suffix AS ts_code, CASE WHEN ck % 13 = 0 THEN '*ST' || ck ELSE 'C' || ck END AS name,
  CASE WHEN market = 'BUILDING' THEN NULL WHEN market = 'MACHINERY' THEN 'OTHER' WHEN suffix = 'SH' THEN 'SSE' WHEN suffix = 'SZ' THEN 'SZSE' ELSE 'BSE' END AS exchange,
  CASE WHEN ck % 5 = 0 THEN 'D' WHEN ck % 7 = 0 THEN 'P' ELSE 'L' END AS list_status, CASE WHEN ck % 11 = 0 THEN 0 ELSE 1 END AS trade_status FROM sec0
""")
cte("universe", """
SELECT * FROM (SELECT *, bool_or(coalesce(exchange IN ('SSE', 'SZSE'), false)) OVER (PARTITION BY market) AS usable FROM (SELECT * FROM sec_list WHERE list_status IN ('L', 'D') QUALIFY row_number() OVER (PARTITION BY market, ts_code ORDER BY ck DESC) = 1))
WHERE CASE WHEN usable THEN coalesce(exchange IN ('SSE', 'SZSE'), false) ELSE suffix IN ('SH', 'SZ') END AND suffix <> 'XX' AND NOT regexp_matches(name, '(?i)\\*?ST')
""")
register("in12_security_universe", lambda s, d: vd.security_universe(securities(s, d), ("L", "D")), "market ts_code name exchange", "universe")
register("in12_security_universe_top", lambda s, d: vd.security_universe(securities(s, d), ("L", "D"), max_symbols=20), "market ts_code name", "(SELECT * FROM universe QUALIFY row_number() OVER (PARTITION BY market ORDER BY ts_code) <= 20)")
cte("boards", "SELECT *, CASE WHEN starts_with(code, '688') THEN 'STAR' WHEN starts_with(code, '300') THEN 'ChiNext' WHEN starts_with(code, '8') OR starts_with(code, '92') THEN 'BSE' ELSE 'MAIN' END AS board, CASE WHEN starts_with(code, '688') OR starts_with(code, '300') THEN 20 WHEN starts_with(code, '8') OR starts_with(code, '92') THEN 30 ELSE 10 END AS band FROM sec_list")
cte("board_universe", """
SELECT market, ts_code, name, board, CASE venue WHEN 'sh' THEN 'SSE' WHEN 'sz' THEN 'SZSE' ELSE 'BSE' END AS exchange, CASE WHEN ck % 2 = 0 THEN DATE '1999-12-31' END AS list_date FROM boards
WHERE venue IN ('sh', 'sz', 'bj') AND trade_status = 1 AND NOT regexp_matches(name, '(?i)\\*?ST') QUALIFY row_number() OVER (PARTITION BY market, ts_code ORDER BY ck) = 1
""")


def board_basics(spark, d):
    """Listing dates for the first even-keyed holder of each code."""
    return (
        securities(spark, d).groupBy("market", "vendor_code").agg(F.min("ck").alias("ck"))
        .select("market", F.upper("vendor_code").alias("vendor_code"), F.lit(None).cast("string").alias("name"), F.lit("1999-12-31").alias("list_date"), F.lit(None).cast("string").alias("delist_date"))
    )


register("in13_board_universe", lambda s, d: vd.board_universe(securities(s, d), board_basics(s, d), include_beijing=True), "market ts_code name board exchange list_date", "(SELECT * REPLACE (DATE '1999-12-31' AS list_date) FROM board_universe)")
register("in14_board_and_limit", lambda s, d: securities(s, d).withColumns({"board": board_of("code"), "band": limit_pct("ts_code")}), "market ck:n code board band:f", "boards")


def history_rows(spark, d):
    b = td.bars(spark, d)
    reported = F.when(F.col("sk") % 2 == 0, F.when(F.col("close") > 30, "1.25").otherwise("n/a"))
    return b.select("market", "ts_code", F.date_format("trade_date", "yyyy-MM-dd").alias("date"), F.col("close").cast("string").alias("close"), F.col("pre_close").cast("string").alias("preclose"), F.col("amount_rmb").cast("string").alias("amount"), reported.alias("pctChg"), F.col("is_st").cast("string").alias("isST"))


register("in15_normalize_history", lambda s, d: vd.normalize_history(history_rows(s, d)), "market ts_code trade_date close:f pre_close:f pct_chg:f amount_rmb:f is_st:f",
         "(SELECT * REPLACE (CASE WHEN reported > 0 THEN p ELSE (close / nullif(pre_close, 0) - 1) * 100 END AS pct_chg) FROM (SELECT *, count(p) OVER (PARTITION BY market, ts_code) AS reported FROM (SELECT *, CASE WHEN sk % 2 = 0 AND close > 30 THEN 1.25 END AS p FROM bars)))")

# Landed arrays hold one security's series each; the change is quoted with two decimals.
_PCT = "round((close / pre_close - 1) * 100, 2)"


def quoted(spark, d):
    return td.bars(spark, d).withColumn("pct", F.round((F.col("close") / F.col("pre_close") - 1) * 100, 2))


def kline_payloads(spark, d):
    text = F.concat_ws(",", F.date_format("trade_date", "yyyy-MM-dd"), "open", "close", "high", "low", "volume", "amount_rmb", F.lit("0"), F.coalesce(F.col("pct").cast("string"), F.lit("-")), F.lit("0"), F.lit("1.5"))
    return quoted(spark, d).groupBy("market", "ts_code").agg(F.to_json(F.struct(F.struct(F.collect_list(text).alias("klines")).alias("data"))).alias("payload"))


register("in16_parse_kline_csv", lambda s, d: vd.parse_kline_csv(kline_payloads(s, d)), "market ts_code trade_date open:f close:f high:f low:f volume:f amount_rmb:f pct_chg:f pre_close:f turnover_rate:f",
         f"(SELECT market, ts_code, trade_date, open, close, high, low, volume, amount_rmb, {_PCT} AS pct_chg, close / (1 + {_PCT} / 100) AS pre_close, 1.5 AS turnover_rate FROM bars)")


def quote_payloads(spark, d):
    """One text per security and year; every ninth security sends a short record."""
    b = quoted(spark, d)
    pad = [F.lit("0")] * 23
    fields = [F.lit("1"), F.col("name"), F.col("ts_code"), F.col("close"), F.coalesce(F.col("pre_close").cast("string"), F.lit("-")), F.col("open"), F.col("volume"), *pad, F.date_format("trade_date", "yyyyMMdd150000"), F.lit("0"), F.coalesce(F.col("pct").cast("string"), F.lit("")), F.col("high"), F.col("low"), F.concat_ws("/", "close", "volume", "amount_rmb")]
    body = F.when(F.col("sk") % 9 == 0, F.lit("1~short~record")).otherwise(F.concat_ws("~", *[f.cast("string") for f in fields]))
    entry = F.concat(F.lit("v_"), F.when(F.col("sk") % 2 == 0, "sh").otherwise("sz"), F.lpad("ts_code", 6, "0"), F.lit('="'), body, F.lit('";'))
    return b.groupBy("market", "ts_code", F.year("trade_date").alias("yr")).agg(F.array_join(F.collect_list(entry), "\n").alias("payload")).select("market", "payload")


register("in17_parse_quote_text", lambda s, d: vd.parse_quote_text(quote_payloads(s, d)), "market ts_code trade_date exchange name close:f pre_close:f open:f volume:f high:f low:f pct_chg:f amount_rmb:f quote_time",
         f"(SELECT market, lpad(ts_code, 6, '0') || CASE WHEN sk % 2 = 0 THEN '.SH' ELSE '.SZ' END AS ts_code, trade_date, CASE WHEN sk % 2 = 0 THEN 'SSE' ELSE 'SZSE' END AS exchange, name, close, pre_close, open, volume, high, low, {_PCT} AS pct_chg, amount_rmb, strftime(trade_date, '%Y%m%d') || '150000' AS quote_time FROM bars WHERE sk % 9 <> 0 AND sk % 23 <> 0)")


def day_payloads(spark, d):
    row = F.array(*[c.cast("string") for c in (F.col("trade_date"), F.col("open"), F.col("close"), F.col("high"), F.col("low"), F.col("volume"), F.lit("x"), F.coalesce(F.col("pct").cast("string"), F.lit("")), F.col("amount_rmb"))])
    short = F.when(F.col("close") == F.col("open"), F.slice(row, 1, 5)).otherwise(row)
    series = quoted(spark, d).groupBy("market", "ts_code", "sk").agg(F.collect_list(short).alias("rows"))
    k = F.col("sk") % 3
    body = F.struct(F.when(k == 0, F.col("rows")).alias("day"), F.when(k == 1, F.col("rows")).alias("qfqday"), F.when(k == 2, F.col("rows")).alias("hfqday"))
    return series.select("market", "ts_code", F.to_json(F.struct(F.create_map(F.concat(F.lit("sh"), F.col("ts_code")), body).alias("data"))).alias("payload"))


register("in18_parse_daily_json", lambda s, d: vd.parse_daily_json(day_payloads(s, d), "1996-01-01", "1999-12-31"), "market ts_code trade_date open:f close:f high:f low:f volume:f pct_chg:f amount_rmb:f pre_close:f",
         f"(SELECT market, ts_code, trade_date, open, close, high, low, volume, {_PCT} AS pct_chg, amount_rmb, close / (1 + {_PCT} / 100) AS pre_close FROM bars WHERE close <> open AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')")


def snapshot_payloads(spark, d):
    """Quote lists per market and week in pages of a hundred securities; a security repeats across weeks and
    the newest record must win."""
    b = td.bars(spark, d)
    record = F.struct(
        F.when(F.col("sk") % 31 == 0, "-").otherwise(F.col("close").cast("string")).alias("f2"), F.lit("1.5").alias("f3"), F.col("volume").cast("string").alias("f5"), F.col("amount_rmb").cast("string").alias("f6"), F.lit("0.7").alias("f8"), F.col("ts_code").alias("f12"),
        (F.col("sk") % 3).cast("string").alias("f13"), F.col("name").alias("f14"), F.col("high").cast("string").alias("f15"), F.col("low").cast("string").alias("f16"), F.col("open").cast("string").alias("f17"), F.col("pre_close").cast("string").alias("f18"), F.unix_timestamp(F.col("trade_date").cast("timestamp")).cast("string").alias("f124"),
    )
    return b.groupBy("market", "trade_date", F.floor(F.col("sk") / 100).alias("page")).agg(F.to_json(F.collect_list(record)).alias("payload"))


register("in19_parse_snapshot_list", lambda s, d: vd.parse_snapshot_list(snapshot_payloads(s, d)).withColumn("local_time", F.date_format("quote_time", "yyyy-MM-dd HH:mm")), "market ts_code exchange name close:f open:f high:f low:f volume:f amount_rmb:f local_time",
         "(SELECT market, lpad(ts_code, 6, '0') || CASE WHEN sk % 3 = 0 THEN '.SZ' ELSE '.SH' END AS ts_code, CASE WHEN sk % 3 = 0 THEN 'SZSE' ELSE 'SSE' END AS exchange, name, close, open, high, low, volume, amount_rmb, strftime(trade_date, '%Y-%m-%d') || ' 08:00' AS local_time FROM bars WHERE sk % 3 < 2 AND sk % 31 <> 0 AND sk % 23 <> 0 QUALIFY row_number() OVER (PARTITION BY market, sk ORDER BY trade_date DESC) = 1)")
register("in20_header_mapping", lambda s, d: vd.rename_headers(td.index_bars(s, d).withColumnsRenamed({"trade_date": "日期", "open": "开盘", "high": "最高", "low": "最低", "close": "收盘"})), "market benchmark trade_date open:f high:f low:f close:f", "index_bars")


def pool(spark, d):
    b = td.bars(spark, d)
    k = F.col("sk") % 7
    known = F.col("market") != "ASIA"
    return b.select(
        "market", "ts_code", "trade_date", F.when(k == 0, 0.0).otherwise(F.col("close")).alias("close"), F.when(known & (k == 1), "u").when(known & (k == 2), "D").otherwise("").alias("limit_type"), F.when(known & (k == 3), "2/3").when(known & (k == 4), "nan").otherwise("").alias("up_stat"),
        F.when(known & (k == 5), "1").otherwise("0").alias("down_stat0"), (F.col("open") * 2).alias("up_limit"), (F.col("open") / 2).alias("down_limit"), "row_seq",
    ).withColumn("down_stat", F.when(F.col("down_stat0") == "1", "1").otherwise("")).drop("down_stat0")


_UP = "close >= open * 2 - 1e-8"
_DOWN = "close <= open / 2 + 1e-8"
_POOL = "SELECT *, market <> 'ASIA' AND sk % 7 IN (1, 3) AS up, market <> 'ASIA' AND sk % 7 IN (2, 5) AS down, NOT bool_or(market <> 'ASIA' AND sk % 7 <= 5) OVER (PARTITION BY market, trade_date) AS guess FROM bars WHERE sk % 7 <> 0"
cte("pool_u", f"SELECT market, ts_code, trade_date, up OR guess OR {_UP} AS is_limit_up, down OR {_DOWN} AS is_limit_down FROM ({_POOL})")
cte("pool_d", f"SELECT market, ts_code, trade_date, up OR {_UP} AS is_limit_up, down OR guess OR {_DOWN} AS is_limit_down FROM ({_POOL} AND close > 30)")
register("in21_limit_flags_from_pool", lambda s, d: vd.limit_flags_from_pool(pool(s, d), "U"), "market ts_code trade_date is_limit_up is_limit_down", "pool_u")


def limit_prices(spark, d):
    return td.bars(spark, d).filter(F.col("sk") % 4 != 0).select("market", "ts_code", "trade_date", (F.col("pre_close") * 1.5).alias("up_limit"), (F.col("pre_close") * 0.5).alias("down_limit"))


register("in22_limit_flags_from_prices", lambda s, d: vd.limit_flags_from_prices(limit_prices(s, d), td.bars(s, d).filter(F.col("sk") % 6 != 1)), "market ts_code trade_date is_limit_up is_limit_down limit_up_status limit_down_status limit_method",
         "(SELECT market, ts_code, trade_date, u AS is_limit_up, v AS is_limit_down, CASE WHEN u THEN 'REAL_ROWS' ELSE 'REAL_ZERO' END AS limit_up_status, CASE WHEN v THEN 'REAL_ROWS' ELSE 'REAL_ZERO' END AS limit_down_status, 'stk_limit' AS limit_method FROM (SELECT *, coalesce(sk % 6 <> 1 AND close >= pre_close * 1.5 - 1e-8, false) AS u, coalesce(sk % 6 <> 1 AND close <= pre_close * 0.5 + 1e-8, false) AS v FROM bars WHERE sk % 4 <> 0))")


def band_panel(spark, d):
    """Codes with board prefixes and changes scaled to the price bands."""
    b = td.bars(spark, d)
    code = F.element_at(F.array(*[F.lit(p) for p in ("600", "300", "830")]), (F.col("sk") % 3 + 1).cast("int"))
    return b.withColumns({"ts_code": F.concat(code, F.lpad("ts_code", 6, "0")), "pct_chg": (F.col("close") / F.col("pre_close") - 1) * 40})


register("in23_limit_flags_board_band", lambda s, d: vd.limit_flags_board_band(band_panel(s, d)), "market ts_code trade_date is_limit_up is_limit_down limit_pct:f limit_method",
         "(SELECT *, p >= band - 0.20 AS is_limit_up, p <= -band + 0.20 AS is_limit_down, band AS limit_pct, 'baostock_board_band_approximation' AS limit_method FROM (SELECT market, CASE sk % 3 WHEN 0 THEN '600' WHEN 1 THEN '300' ELSE '830' END || lpad(ts_code, 6, '0') AS ts_code, trade_date, (close / pre_close - 1) * 40 AS p, CASE sk % 3 WHEN 0 THEN 10.0E0 WHEN 1 THEN 20.0E0 ELSE 30.0E0 END AS band FROM bars WHERE is_st <> 1) WHERE p >= band - 0.20 OR p <= -band + 0.20)")


def both_pools(spark, d):
    up = vd.limit_flags_from_pool(pool(spark, d), "U").withColumn("pool", F.lit("U"))
    down = vd.limit_flags_from_pool(pool(spark, d).filter("close > 30"), "D").withColumns({"pool": F.lit("D"), "row_seq": F.col("row_seq") + 1})
    return vd.merge_limit_pools(up, down)


cte("merged_pools", "SELECT u.market, u.ts_code, u.trade_date, u.is_limit_up OR coalesce(d.is_limit_up, false) AS is_limit_up, u.is_limit_down OR coalesce(d.is_limit_down, false) AS is_limit_down, 'U' AS pool FROM pool_u u JOIN bars b USING (market, ts_code, trade_date) LEFT JOIN pool_d d USING (market, ts_code, trade_date)")
register("in24_merge_limit_pools", both_pools, "market ts_code trade_date is_limit_up is_limit_down pool", "merged_pools")
register("in25_pool_status", lambda s, d: vd.pool_status(vd.limit_flags_from_pool(pool(s, d), "U")), "market trade_date limit_up_status limit_down_status",
         "(SELECT market, trade_date, CASE WHEN bool_or(is_limit_up) THEN 'REAL_ROWS' ELSE 'REAL_ZERO' END AS limit_up_status, CASE WHEN bool_or(is_limit_down) THEN 'REAL_ROWS' ELSE 'REAL_ZERO' END AS limit_down_status FROM pool_u GROUP BY market, trade_date)")


def ranked_sources(spark, d):
    """Source 0 stops early for some markets, source 1 is complete, source 2 a fallback."""
    b = tb.stage_table(td.bars(spark, d).select("market", "ts_code", "trade_date", "close"), "sources")
    first = b.filter(F.col("market").isin("ASIA", "EUROPE") | (F.col("trade_date") < F.lit("2000-01-01").cast("date"))).withColumn("source_rank", F.lit(0))
    second = b.filter(F.col("market") != "AFRICA").withColumns({"source_rank": F.lit(1), "close": F.col("close") + 1})
    third = b.withColumns({"source_rank": F.lit(2), "close": F.col("close") + 2})
    return first.unionByName(second).unionByName(third)


register("in26_select_source", lambda s, d: tb.select_source(ranked_sources(s, d), "1996-01-01", "2001-06-01"), "market ts_code trade_date close:f source_rank:n",
         "(SELECT market, ts_code, trade_date, close + r AS close, r AS source_rank FROM (SELECT *, CASE WHEN market IN ('ASIA', 'EUROPE') THEN 0 WHEN market = 'AFRICA' THEN 2 ELSE 1 END AS r FROM bars))")


def exchange_calendar(spark, d):
    o = td.table(spark, d, "orders")
    return o.select(F.date_format("o_orderdate", "yyyyMMdd").alias("cal_date"), F.when(F.dayofweek("o_orderdate").isin(1, 7), "0").otherwise("1").alias("is_open"))


register("in27_trading_calendar", lambda s, d: tb.trading_calendar(exchange_calendar(s, d)), "trade_date", "(SELECT DISTINCT CAST(o_orderdate AS date) AS trade_date FROM orders WHERE isodow(o_orderdate) <= 5)")
register("in27_business_days", lambda s, d: tb.business_days(td.bars(s, d).groupBy("market").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"))), "market trade_date",
         "(SELECT * FROM (SELECT market, CAST(unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY)) AS date) AS trade_date FROM bars GROUP BY market) WHERE isodow(trade_date) <= 5)")
MARGIN = "market string, trade_date date, margin_balance double, margin_buy double, short_balance double"
register("in28_margin_observations", lambda s, d: tb.load_observations(td.index_bars(s, d).select("market", F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), F.when(F.col("close") > 35, F.lit(float("nan"))).otherwise(F.col("close")).alias("margin_balance")), MARGIN),
         "market trade_date margin_balance:f margin_buy:f short_balance:f", "(SELECT market, trade_date, CASE WHEN close <= 35 THEN close END AS margin_balance, CAST(NULL AS double) AS margin_buy, CAST(NULL AS double) AS short_balance FROM index_bars)")


def first_existing(spark, d):
    older = tb.scratch_path(spark, "state-old")
    tb.save_dataset(td.index_bars(spark, d), older)
    return tb.load_first_existing(spark, [tb.scratch_path(spark, "state-new"), older])


register("in29_load_first_existing", first_existing, "market benchmark trade_date close:f", "index_bars")
