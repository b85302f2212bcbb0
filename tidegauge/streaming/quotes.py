"""Live quotes: stream ingest, market clock, freshness gate, turnover projection, limit inference.

The transformations work on batch and streaming frames alike; the polling loop of a quote snapshot
becomes a Structured Streaming source with a ``foreachBatch`` sink.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.series import flag
from ..functions.text import CHINEXT_PREFIXES, starts_with_any
from ..schemas import QUOTES
from ..sources.snapshots import SnapshotTable, consume

# Session times and limits of the live market.
OPEN_AM, CLOSE_AM, OPEN_PM, CLOSE_PM = "09:30:00.000000", "11:30:00.000000", "13:00:00.000000", "15:00:00.000000"
LUNCH_FLOOR, CLOSE_FLOOR = "11:25:00", "14:55:00"
SESSION_MINUTES, MINIMUM_FRACTION, MAX_STALENESS_SECONDS = 240.0, 0.08, 180
WIDE_BAND_PREFIXES = (*CHINEXT_PREFIXES, "688")


def read_quotes(spark: SparkSession, path: str, ddl: str = QUOTES, fmt: str = "json", per_trigger: int | None = None, file_filter: str | None = None) -> DataFrame:
    """Streaming file source of landed quotes."""
    reader = spark.readStream.schema(ddl).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    return reader.load(path)


def latest_quotes(quotes: DataFrame, keys: Sequence[str] = ("market",), order: str | Column = "quote_time", watermark: str = "3 minutes") -> DataFrame:
    """Newest quote per security and trading day. On a stream the watermark lets finished days leave the
    state; copies of a busy security merge before the shuffle."""
    if quotes.isStreaming:
        quotes = quotes.withWatermark("quote_time", watermark)
    order = F.col(order) if isinstance(order, str) else order
    rest = [c for c in quotes.columns if c not in (*keys, "ts_code")]
    day = F.window("quote_time", "1 day")
    newest = quotes.groupBy(*keys, "ts_code", day).agg(F.max_by(F.struct(*rest), order).alias("_q"))
    return newest.select(*keys, "ts_code", F.col("window.start").cast("date").alias("trade_date"), "_q.*")


def run_latest_quotes(spark: SparkSession, quotes: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("market",), order: str | Column = "quote_time") -> StreamingQuery:
    """Keep a snapshot table of the newest quote per security and day. A micro-batch adds its own keys as a delta under its
    batch id: no other row is written again, a batch that fails leaves the table as it was, and a replay adds nothing."""
    table = SnapshotTable(spark, target, [*keys, "ts_code", "trade_date"], "quote_time")

    def publish(batch: DataFrame, number: int) -> None:
        if table.committed("latest-quotes", number):
            consume(batch)
        else:
            table.upsert(batch, "latest-quotes", number)

    newest = latest_quotes(quotes, keys, order).writeStream.outputMode("update")
    return newest.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_status(at: Column) -> Column:
    t = F.date_format(at, "HH:mm:ss.SSSSSS")
    return F.when(t < OPEN_AM, "PREOPEN").when(t <= CLOSE_AM, "OPEN").when(t < OPEN_PM, "LUNCH").when(t <= CLOSE_PM, "OPEN").otherwise("CLOSED")


def session_fraction(at: Column) -> Column:
    """Share of the 240 trading minutes that has passed."""
    t = F.date_format(at, "HH:mm:ss.SSSSSS")
    minutes = (F.hour(at) * 60 + F.minute(at)).cast("double")
    morning = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (minutes - 570) / SESSION_MINUTES))
    afternoon = F.greatest(F.lit(0.5), F.least(F.lit(1.0), (120 + minutes - 780) / SESSION_MINUTES))
    return F.when(t < OPEN_AM, 0.0).when(t <= CLOSE_AM, morning).when(t < OPEN_PM, 0.5).when(t <= CLOSE_PM, afternoon).otherwise(1.0)


def freshness_gate(quotes: DataFrame, now: Column, keys: Sequence[str] = ("source",), max_staleness: int = MAX_STALENESS_SECONDS, untimed_ok: Column | None = None) -> DataFrame:
    """One verdict per batch key from its newest exchange timestamp. ``now`` is constant per key.

    A source known to deliver without timestamps (``untimed_ok``) counts as current.
    """
    newest = quotes.groupBy(*keys).agg(F.max("quote_time").alias("quote_as_of"), F.max(now).alias("now"), F.bool_or(untimed_ok if untimed_ok is not None else F.lit(False)).alias("_untimed"))
    status = session_status(F.col("now"))
    at, seen = F.col("now"), F.date_format("quote_as_of", "HH:mm:ss")
    lag = F.unix_micros("now") - F.unix_micros("quote_as_of")
    reason = (
        F.when(F.col("quote_as_of").isNull() & F.col("_untimed"), F.lit(None))
        .when(F.col("quote_as_of").isNull(), "NO_TIMESTAMP")
        .when(F.col("quote_as_of").cast("date") != at.cast("date"), "NOT_TODAY")
        .when((status == "OPEN") & (lag > max_staleness * 1_000_000), "STALE")
        .when((status == "LUNCH") & (seen < LUNCH_FLOOR), "LUNCH_TIMESTAMP")
        .when((status == "CLOSED") & (seen < CLOSE_FLOOR), "CLOSE_TIMESTAMP")
    )
    return newest.select(*keys, "quote_as_of", "now", status.alias("market_status"), reason.alias("reason"), reason.isNull().alias("accepted"))


def project_turnover(quotes: DataFrame, now: Column) -> DataFrame:
    """Full-session equivalent of the accumulated turnover while the session runs."""
    running = session_status(now).isin("OPEN", "LUNCH")
    projected = F.col("amount_rmb") / F.greatest(session_fraction(now), F.lit(MINIMUM_FRACTION))
    return quotes.withColumn("amount_rmb_actual", F.col("amount_rmb")).withColumn("amount_rmb", F.when(running, projected).otherwise(F.col("amount_rmb")))


def infer_limits(quotes: DataFrame) -> DataFrame:
    """Last-resort limit flags from the previous close and the board's band, cents rounded half to even."""
    rate = F.when(starts_with_any(F.substring("ts_code", 1, 6), WIDE_BAND_PREFIXES), 0.20).otherwise(0.10)
    cents = lambda factor: F.rint(F.col("pre_close") * factor * 100.0) / 100.0
    up, down = flag(F.col("close") >= cents(F.lit(1.0) + rate)), flag(F.col("close") <= cents(F.lit(1.0) - rate))
    marked = quotes.withColumns({"is_limit_up": up, "is_limit_down": down}).filter(F.col("is_limit_up") | F.col("is_limit_down"))
    return marked.withColumns(
        {
            "limit_method": F.lit("price_inferred"), "limit_up_source": F.lit("realtime-price-inferred"), "limit_down_source": F.lit("realtime-price-inferred"), "limit_up_status": F.lit("APPROX_LIST"), "limit_down_status": F.lit("APPROX_LIST"),
        }
    )


def prefer_source(candidates: DataFrame, keys: Sequence[str], rank: str = "source_rank") -> DataFrame:
    """Rows of the best-ranked source that delivered anything, per key."""
    best = candidates.groupBy(*keys).agg(F.min(rank).alias(rank))
    return candidates.join(best, [*keys, rank], "left_semi")
