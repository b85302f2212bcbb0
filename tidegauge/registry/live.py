"""Live and streaming queries (ST)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import factors as fx
from ..operators.regime import regime_indicators
from ..plans.temperature import raw_factors, score_factors
from ..operators.quality import dataset_warnings
from ..sources import tables as tb
from ..sources import testdata as td
from ..sources.snapshots import SnapshotTable
from ..streaming import chain as ch
from ..streaming import gate as gt
from ..streaming import live as lv
from ..streaming import quotes as qt
from .base import cte, register
from .factors import IDX, KEYS, W, panel
from .quality import Q
from .scoring import LIVE_DAY

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def as_quotes(events):
    """Replay events as quotes: user = security, event type = market, value = price."""
    return events.select(
        F.col("ts").cast("timestamp").alias("quote_time"), F.col("event_type").alias("market"), F.col("user_id").cast("string").alias("ts_code"), F.col("value").alias("close"), F.col("event_id"), F.get_json_object("props", "$.k").cast("double").alias("volume"), (F.col("value") * 1000).alias("amount_rmb")
    )


def quotes(spark, d):
    return as_quotes(td.table(spark, d, "events"))


cte("quotes", "SELECT CAST(ts AS timestamp) AS quote_time, event_type AS market, CAST(user_id AS varchar) AS ts_code, value AS close, event_id, CAST(json_extract_string(props, '$.k') AS double) AS volume, value * 1000 AS amount_rmb, CAST(ts AS date) AS trade_date, user_id FROM events")
cte("latest_quotes", "SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY market, ts_code, trade_date ORDER BY quote_time DESC, event_id DESC) = 1")
def _order():
    return F.struct("quote_time", "event_id")


_Q = "market ts_code trade_date close:f volume:f event_id:n"


FILES = 4
"""Files of a landed range, and files that a trigger takes."""


def landed(spark, frame, name, edges, at="quote_time", files=FILES):
    """``frame`` in one folder, ``files`` files for each range of times, in the order of the ranges, so that a stream of as many
    files per trigger takes them as micro-batches."""
    folder = tb.scratch_path(spark, name)
    for low, high in zip(edges, edges[1:]):
        part = frame.filter((F.col(at) >= F.lit(low).cast("timestamp")) & (F.col(at) < F.lit(high).cast("timestamp")))
        part.repartition(files).write.mode("append").parquet(folder)
    return folder


def streamed_quotes(spark, d):
    """The same table built by the stream over four micro-batches: file source, watermark, deltas by batch. The ranges split
    days, so later batches bring newer quotes of keys that the table already holds."""
    source = quotes(spark, d)
    ends = source.agg(F.min("quote_time").alias("low"), F.max("quote_time").alias("high")).first()
    step = (ends.high - ends.low) / 4
    folder = landed(spark, source, "landed-quotes", [ends.low, ends.low + step, ends.low + 2 * step, ends.low + 3 * step, ends.high + step])
    stream = qt.read_quotes(spark, folder, source.schema, "parquet", FILES)
    target = tb.scratch_path(spark, "latest")
    qt.run_latest_quotes(spark, stream, target, tb.scratch_path(spark, "ckpt"), order=_order()).awaitTermination()
    return SnapshotTable(spark, target).read()


register("st1_latest_quotes", lambda s, d: qt.latest_quotes(quotes(s, d), order=_order()), _Q, "latest_quotes")
register("st1_latest_quotes_streamed", streamed_quotes, _Q, "latest_quotes")
_T = "strftime(quote_time, '%H:%M:%S.%f')"
_MIN = "(hour(quote_time) * 60 + minute(quote_time))"
cte("clock", f"""
SELECT *, CASE WHEN t < '09:30:00.000000' THEN 'PREOPEN' WHEN t <= '11:30:00.000000' THEN 'OPEN' WHEN t < '13:00:00.000000' THEN 'LUNCH' WHEN t <= '15:00:00.000000' THEN 'OPEN' ELSE 'CLOSED' END AS market_status,
  CASE WHEN t < '09:30:00.000000' THEN 0.0E0 WHEN t <= '11:30:00.000000' THEN greatest(0.0E0, least(1.0E0, ({_MIN} - 570) / 240.0E0)) WHEN t < '13:00:00.000000' THEN 0.5E0 WHEN t <= '15:00:00.000000' THEN greatest(0.5E0, least(1.0E0, (120 + {_MIN} - 780) / 240.0E0)) ELSE 1.0E0 END AS fraction
FROM (SELECT *, {_T} AS t FROM quotes)
""")
register("st2_market_clock", lambda s, d: quotes(s, d).withColumns({"market_status": qt.session_status(F.col("quote_time")), "fraction": qt.session_fraction(F.col("quote_time"))}), "event_id:n market_status fraction:f", "clock")

# The poll time depends on the market, so every session phase occurs.
_POLL = {"click": "10:30:00", "view": "12:00:00", "purchase": "16:00:00", "error": "14:00:00"}


def polled(spark, d):
    q = quotes(spark, d).withColumn("trade_date", F.col("quote_time").cast("date"))
    at = F.coalesce(F.create_map(*[F.lit(x) for kv in _POLL.items() for x in kv])[F.col("market")], F.lit("09:00:00"))
    now = F.to_timestamp(F.concat_ws(" ", F.col("trade_date").cast("string"), at))
    return q.withColumn("poll", now).filter(F.col("quote_time") <= F.col("poll"))


cte("polled", "SELECT * FROM (SELECT *, CAST(trade_date AS timestamp) + CAST(CASE market " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _POLL.items()) + " ELSE '09:00:00' END AS interval) AS poll FROM quotes) WHERE quote_time <= poll")
cte("gate", """
SELECT *, reason IS NULL AS accepted FROM (SELECT *, CASE WHEN status = 'OPEN' AND epoch_us(poll) - epoch_us(as_of) > 180000000 THEN 'STALE' WHEN status = 'LUNCH' AND strftime(as_of, '%H:%M:%S') < '11:25:00' THEN 'LUNCH_TIMESTAMP' WHEN status = 'CLOSED' AND strftime(as_of, '%H:%M:%S') < '14:55:00' THEN 'CLOSE_TIMESTAMP' END AS reason
  FROM (SELECT market, trade_date, max(quote_time) AS as_of, max(poll) AS poll, CASE WHEN strftime(max(poll), '%H:%M') < '09:30' THEN 'PREOPEN' WHEN strftime(max(poll), '%H:%M') <= '11:30' THEN 'OPEN' WHEN strftime(max(poll), '%H:%M') < '13:00' THEN 'LUNCH' WHEN strftime(max(poll), '%H:%M') <= '15:00' THEN 'OPEN' ELSE 'CLOSED' END AS status FROM polled GROUP BY market, trade_date))
""")
register("st3_freshness_gate", lambda s, d: qt.freshness_gate(polled(s, d), F.col("poll"), ["market", "trade_date"]).withColumnRenamed("market_status", "status"), "market trade_date status reason accepted", "gate")
GATE_LATENESS = 10
"""Days; the replayed quotes span a month."""


def gated_stream(spark, d):
    """The quotes, dealt over three polls whatever their time, pass the stateful gate as three micro-batches after the last
    day's close. The source ``error`` delivers in the first only and falls silent."""
    source = quotes(spark, d)
    close = F.to_timestamp(F.concat(F.lit(str(source.agg(F.max(F.to_date("quote_time"))).first()[0])), F.lit(" 16:00:00")))
    taken = source.withColumn("poll", F.when(F.col("market") == "error", 0).otherwise(F.col("event_id") % 3).cast("int")).withColumn("landed_at", close + F.expr("make_interval(0, 0, 0, 0, 0, 10 * poll, 0)"))
    first = taken.agg(F.min("landed_at")).first()[0]
    cores = max(FILES, min(spark.sparkContext.defaultParallelism, 32))
    folder = landed(spark, taken, "gate", [first + dt.timedelta(minutes=m) for m in (0, 10, 20, 30)], "landed_at", cores)
    accepted, rejected = (SnapshotTable(spark, tb.scratch_path(spark, name)) for name in ("accepted", "rejected"))
    status = SnapshotTable(spark, tb.scratch_path(spark, "status"), ["market"], "since")
    gt.run_gate(spark, qt.read_quotes(spark, folder, taken.schema, "parquet", cores), accepted, rejected, status, tb.scratch_path(spark, "ckpt"), ["market"], lateness=f"{GATE_LATENESS} days", partitions=cores)
    counts = accepted.read().groupBy("market").agg(F.count("*").alias("accepted"))
    refused = rejected.read().groupBy("market").agg(F.count_if(F.col("reason") == "LATE").alias("late"), F.count_if(F.col("reason") != "LATE").alias("refused"))
    given = taken.groupBy("market").agg(F.count("*").alias("given"))
    whole = given.join(counts, "market", "left").join(refused, "market", "left").join(status.read(), "market", "left").fillna(0, ["accepted", "late", "refused"])
    return whole.withColumn("since", F.date_format("since", "HH:mm:ss"))


cte("gate_polls", "SELECT *, CASE WHEN market = 'error' THEN 0 ELSE event_id % 3 END AS poll, max(trade_date) OVER () AS last_day FROM quotes")
cte("gate_newest", "SELECT market, poll, max(quote_time) AS newest, CAST(max(quote_time) AS date) = any_value(last_day) AND strftime(max(quote_time), '%H:%M:%S') >= '14:55:00' AS good FROM gate_polls GROUP BY market, poll")
cte("gate_before", "SELECT a.market, a.poll, a.good, max(b.newest) AS before FROM gate_newest a LEFT JOIN gate_newest b ON b.market = a.market AND b.poll < a.poll AND b.good GROUP BY a.market, a.poll, a.good")
cte("gate_stream", f"""
SELECT market, count(*) AS given, count(*) FILTER (WHERE good AND (before IS NULL OR quote_time >= before - INTERVAL {GATE_LATENESS} DAY)) AS accepted,
  count(*) FILTER (WHERE good AND quote_time < before - INTERVAL {GATE_LATENESS} DAY) AS late, count(*) FILTER (WHERE NOT good) AS refused,
  CASE WHEN NOT bool_or(good) THEN NULL WHEN max(poll) FILTER (WHERE good) < 2 THEN 'STALE' ELSE 'CURRENT' END AS status,
  CASE WHEN NOT bool_or(good) THEN NULL WHEN max(poll) FILTER (WHERE good) < 2 THEN strftime(TIMESTAMP '2000-01-01 16:03:00' + INTERVAL 10 MINUTE * max(poll) FILTER (WHERE good), '%H:%M:%S')
    ELSE strftime(TIMESTAMP '2000-01-01 16:00:00' + INTERVAL 10 MINUTE * min(poll) FILTER (WHERE good), '%H:%M:%S') END AS since
FROM gate_polls JOIN gate_before USING (market, poll) GROUP BY market
""")
register("st3_stream_gate", gated_stream, "market given:n accepted:n late:n refused:n status since", "gate_stream")
register("st4_turnover_projection", lambda s, d: qt.project_turnover(quotes(s, d), F.col("quote_time")), "event_id:n amount_rmb:f amount_rmb_actual:f",
         "(SELECT event_id, amount_rmb AS amount_rmb_actual, CASE WHEN market_status IN ('OPEN', 'LUNCH') THEN amount_rmb / greatest(fraction, 0.08E0) ELSE amount_rmb END AS amount_rmb FROM clock)")


def priced(spark, d):
    b = td.bars(spark, d)
    code = F.concat(F.element_at(F.array(*[F.lit(p) for p in ("600", "300", "688", "000")]), (F.col("sk") % 4 + 1).cast("int")), F.lpad("ts_code", 3, "0"))
    return b.select("market", code.alias("ts_code"), "sk", "trade_date", (F.col("pre_close") + (F.col("close") - F.col("pre_close")) / 4).alias("close"), "pre_close")


register("st5_infer_limits", lambda s, d: qt.infer_limits(priced(s, d)), "market sk:n trade_date is_limit_up is_limit_down limit_up_status",
         "(SELECT *, close >= round_even(pre_close * (1.0E0 + rate), 2) AS is_limit_up, close <= round_even(pre_close * (1.0E0 - rate), 2) AS is_limit_down, 'APPROX_LIST' AS limit_up_status FROM (SELECT market, sk, trade_date, pre_close, pre_close + (close - pre_close) / 4 AS close, CASE WHEN sk % 4 IN (1, 2) THEN 0.20E0 ELSE 0.10E0 END AS rate FROM bars) WHERE close >= round_even(pre_close * (1.0E0 + rate), 2) OR close <= round_even(pre_close * (1.0E0 - rate), 2))")


def live_day(spark, d):
    """The newest day of each market arrives live on top of the earlier history."""
    daily = tb.hand_off(td.regime_daily(spark, d))
    newest = daily.groupBy("market").agg(F.max_by(F.struct(*[c for c in daily.columns if c != "market"]), "trade_date").alias("r")).select("market", "r.*")
    return lv.live_snapshot(daily, newest)


_LAST = "QUALIFY row_number() OVER (PARTITION BY market ORDER BY trade_date DESC) = 1"
register("st6_live_state", lambda s, d: live_day(s, d)[0], "market trade_date smoothed_temperature:f state signal state_duration:n", f"(SELECT * FROM base_state {_LAST})")
register("st6_live_advisory", lambda s, d: live_day(s, d)[1], "market trade_date advisory_signal signal_confidence reason_codes why", f"(SELECT * FROM advisory {_LAST})")


def streamed_states(spark, d):
    """Indicator rows land in three files by date; the stream takes one file per trigger, so the machine's
    memory has to survive between micro-batches."""
    indicators = tb.hand_off(regime_indicators(td.regime_daily(spark, d)).drop("p"))
    landing, target = tb.scratch_path(spark, "indicators"), tb.scratch_path(spark, "states")
    edges = ("1900-01-01", "1997-06-30", "1999-09-30", "2100-01-01")
    for low, high in zip(edges, edges[1:]):
        part = indicators.filter((F.col("trade_date") > F.lit(low).cast("date")) & (F.col("trade_date") <= F.lit(high).cast("date")))
        part.coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(indicators.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    lv.run_stream_states(spark, stream, target, tb.scratch_path(spark, "ckpt"))
    return spark.read.parquet(target)


register("st7_streaming_state_machine", streamed_states, "market trade_date state signal zone_state panic_episode_id:n euphoria_episode_id:n watch_streak:n state_duration:n", "base_state")


def candidates(spark, d):
    q = quotes(spark, d).withColumn("trade_date", F.col("quote_time").cast("date"))
    return q.withColumn("source_rank", F.when((F.dayofmonth("trade_date") % 3 == 0) | (F.col("event_id") % 2 == 0), 1).otherwise(0))


register("st8_live_source_priority", lambda s, d: qt.prefer_source(candidates(s, d), ["market", "trade_date"]), "market trade_date event_id:n source_rank:n",
         "(SELECT * FROM (SELECT *, CASE WHEN day(trade_date) % 3 = 0 OR event_id % 2 = 0 THEN 1 ELSE 0 END AS source_rank FROM quotes) QUALIFY source_rank = min(source_rank) OVER (PARTITION BY market, trade_date))")


def stored_history(spark, d, bars=None):
    """What is stored before the live day: recent bars, limit rows and benchmarks, raw factors, and scored days. Every
    micro-batch reads them, so each is stored by itself."""
    bars = panel(spark, d) if bars is None else bars
    day = F.lit(LIVE_DAY).cast("date")
    past, index = bars.filter(F.col("trade_date") < day), tb.hand_off(td.index_bars(spark, d, bars).filter(F.col("trade_date") < day))
    limits = tb.stage_table(td.limits(past), "limits")
    factors = tb.hand_off(raw_factors(past, limits, W, Q, dedupe=False))
    ratios = tb.hand_off(fx.add_stretch(fx.prepare_index(index), W, IDX))
    daily = score_factors(factors, ratios, dataset_warnings(past, limits, None, Q, KEYS), Q, td.PERCENTILE)
    recent = F.col("trade_date") >= F.date_sub(day, 7 * 30)
    return ch.Stored(tb.stage_table(past.filter(recent), "recent"), limits.filter(recent), index, factors, ratios, tb.hand_off(daily))


def live_index(bars):
    return td.index_bars(bars.sparkSession, "", bars.withColumn("sk", F.col("ts_code").cast("bigint")))


def live_pools(bars):
    return td.limits(bars.withColumn("sk", F.col("ts_code").cast("bigint")))


def live_chain(spark, d):
    """Three polls of the live week land one after the other and pass the whole chain as micro-batches: stale stamps before
    the session, a part of the week at lunch, the whole after the close. Beside each published series stand its quotes, given and refused."""
    bars = panel(spark, d)
    polls = tb.hand_off(td.live_polls(spark, d, LIVE_DAY, bars))
    folder = landed(spark, polls, "landed-polls", [f"{LIVE_DAY} {t}" for t in ("00:00:00", "11:00:00", "13:00:00", "23:59:59")], "landed_at")
    published = SnapshotTable(spark, tb.scratch_path(spark, "live"), ["market", "trade_date"])
    rejected = SnapshotTable(spark, tb.scratch_path(spark, "rejected"))
    stream = qt.read_quotes(spark, folder, polls.schema, "parquet", FILES)
    scoring = ch.Scoring(W, Q, td.PERCENTILE)
    ch.run_live_chain(stream, stored_history(spark, d, bars), live_index, published, rejected, tb.scratch_path(spark, "ckpt"), scoring, live_limits=live_pools).awaitTermination()
    given = polls.groupBy("market").agg(F.count("*").alias("given"))
    refused = rejected.read().groupBy("market").agg(F.count_if(F.col("reason") == "NOT_TODAY").alias("not_today"), F.count_if(F.col("reason") == "SUPERSEDED_SOURCE").alias("superseded"), F.count("*").alias("refused"))
    return published.read().join(given, "market").join(refused, "market")


cte("poll_ticks", f"""
SELECT DISTINCT market, sk, poll FROM tick, (VALUES {', '.join(f"({n}, {days})" for n, (_, days) in enumerate(td.POLLS))}) p(poll, days)
WHERE (poll = 0 AND trade_date = DATE '{LIVE_DAY}' - 7) OR (poll > 0 AND trade_date = DATE '{LIVE_DAY}' AND days > isodow(ord[1]) - 1)
""")
cte("poll_counts", """
SELECT market, count(*) + count(*) FILTER (WHERE sk % 3 = 0) AS given, count(*) FILTER (WHERE poll = 0) AS not_today,
  count(*) FILTER (WHERE sk % 3 = 0) AS superseded, count(*) FILTER (WHERE poll = 0) + count(*) FILTER (WHERE sk % 3 = 0) AS refused
FROM poll_ticks GROUP BY market
""")
# The state layer reads the daily run, cut at the live week, in place of its own compact table.
register("st6_live_chain", live_chain, "market trade_date raw_temperature:f smoothed_temperature:f state signal state_duration:n quality advisory_signal signal_confidence headline why market_status given:n not_today:n superseded:n refused:n",
         f"(SELECT a.*, c.* EXCLUDE (market), 'CLOSED' AS market_status FROM advisory a JOIN poll_counts c USING (market) WHERE trade_date = DATE '{LIVE_DAY}')",
         {"regime_daily": f"SELECT * FROM temperature WHERE trade_date <= DATE '{LIVE_DAY}'"})
