"""The live chain: one micro-batch of landed quotes to published state and advisory of the live day.

Quotes pass the freshness gate, take their master data from the stored panel, are projected to a full session and give
limit flags; the live day's factors are scored against stored factor history, and state and advisory follow from stored
daily scores. Nothing is written back to the history. Published and rejected rows go to snapshot tables under the
micro-batch's id, so a batch that is run again changes neither.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.advisory import advisory_frame
from ..operators.state_machine import build_states
from ..params import Degenerate, Percentile, Quality, Windows
from ..plans.temperature import intraday_temperature
from ..schemas import BARS, INDEX_BARS, LIMITS, conform, fields
from ..sources.snapshots import SnapshotTable, consume
from ..sources.tables import hand_off
from .quotes import freshness_gate, infer_limits, prefer_source, project_turnover, session_fraction

MASTER = ("name", "exchange", "board", "is_st", "list_date", "delist_date", "universe_count")
DAILY = ("raw_market_temperature", "breadth_score", "profit_effect_score", "liquidity_score", "stretch_score", "market_temperature_quality", "confidence", "data_quality_warnings")
STATE = ("raw_temperature", "smoothed_temperature", "state", "signal", "previous_state", "state_duration", "quality", "confidence", "warnings")
ADVICE = ("advisory_signal", "signal_confidence", "buy_reference", "sell_reference", "confirming_modules", "reason_codes", "headline", "summary", "why", "what_to_watch_next")


LiveTable = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stored:
    """What the chain reads beside the quotes. ``panel``, ``limits`` and ``index_bars`` need only the recent days that the
    windows reach; ``factors`` and ``stretch`` are the raw factor history, ``daily`` the scored days. Days from the live day on
    are not read from any of them."""

    panel: DataFrame
    limits: DataFrame
    index_bars: DataFrame
    factors: DataFrame
    stretch: DataFrame
    daily: DataFrame

    def before(self, day) -> "Stored":
        return Stored(*[frame.filter(F.col("trade_date") < day) for frame in (self.panel, self.limits, self.index_bars, self.factors, self.stretch, self.daily)])


@dataclass(frozen=True)
class Scoring:
    windows: Windows = Windows()
    quality: Quality = Quality(production=True)
    percentile: Percentile = Percentile()
    degenerate: Degenerate = Degenerate()


@dataclass(frozen=True)
class LiveBatch:
    """What one micro-batch gives: published rows, and quotes that were refused, each with its reason."""

    published: DataFrame | None
    rejected: DataFrame


def keyed(frame: DataFrame, ddl: str, keys: Sequence[str]) -> DataFrame:
    """``frame`` in its canonical schema, NaN as NULL, with series keys that the schema does not name. Rows without a
    sequence number are the first of their key."""
    named = {name for name, _ in fields(ddl)}
    whole = conform(frame, ", ".join([ddl, *(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys if k not in named)]))
    return whole.withColumn("row_seq", F.coalesce("row_seq", F.lit(0).cast("bigint")))


def gated(batch: DataFrame, keys: Sequence[str], landed: str, untimed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Quotes of the preferred source of each key where its newest stamp is current, with the poll's ``now``; and all others
    with a reason: the gate's, SUPERSEDED_SOURCE, NO_CODE or OLDER_QUOTE of the same security."""
    sourced = batch.withColumns({"source": F.coalesce("source", F.lit("")), "source_rank": F.coalesce("source_rank", F.lit(0))})
    by = [*keys, "source"]
    best = prefer_source(sourced.select(*by, "source_rank").distinct(), keys).select(*by, F.lit(True).alias("_best"))
    verdict = freshness_gate(sourced, F.col(landed), by, untimed_ok=F.col(untimed) if untimed else None).select(*by, "quote_as_of", F.col("now").alias("now"), "market_status", F.col("reason").alias("_stale"))
    place = F.struct(F.col("quote_time"), F.col(landed), F.xxhash64(*[F.col(c) for c in batch.columns]))
    newest = sourced.groupBy(*by, "ts_code").agg(F.max(place).alias("_newest"))
    # null-safe joins on the batch's own few keys; the newest quote is an aggregate, so copies merge before they are shuffled
    marked = sourced.withColumn("_place", place).join(best, by, "left").join(verdict, by, "left").join(newest, [*by, "ts_code"], "left")
    reason = F.when(F.col("_best").isNull(), "SUPERSEDED_SOURCE").when(F.col("_stale").isNotNull(), F.col("_stale")).when(F.col("ts_code").isNull(), "NO_CODE").when(F.col("_place") < F.col("_newest"), "OLDER_QUOTE")
    judged = marked.withColumn("reason", reason)
    accepted = judged.filter(F.col("reason").isNull()).drop("_best", "_stale", "_place", "_newest", "reason")
    rejected = judged.filter(F.col("reason").isNotNull()).select(*batch.columns, F.col("now").alias("polled_at"), "reason")
    return accepted, rejected


def live_bars(quotes: DataFrame, panel: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Accepted quotes as bars of their day. Master data comes with the quote, else from the security's newest stored row."""
    master = panel.groupBy(*keys, "ts_code").agg(F.max_by(F.struct(*MASTER), F.struct("trade_date", "row_seq")).alias("_master"))
    bars = keyed(quotes.withColumn("trade_date", F.col("now").cast("date")), BARS, keys)
    known = bars.join(master, [*keys, "ts_code"], "left")
    return known.withColumns({c: F.coalesce(F.col(c), F.col(f"_master.{c}")) for c in MASTER}).select(*bars.columns)


def score_live(batch: DataFrame, stored: Stored, live_index: LiveTable, scoring: Scoring = Scoring(), keys: Sequence[str] = ("market",), landed: str = "landed_at", untimed: str | None = None, live_limits: LiveTable | None = None) -> LiveBatch:
    """One micro-batch. ``landed`` is the time a quote was polled, the clock that the gate holds its stamp against; the live
    day is that of the newest. ``live_index`` makes benchmark bars of the live day from its stock bars. ``live_limits`` gives the
    day's limit pools likewise; without them limits are inferred from prices, which the profit module counts as unknown.
    Where the gate refuses every quote nothing is published."""
    accepted, rejected = gated(batch, keys, landed, untimed)
    if accepted.isEmpty():
        return LiveBatch(None, rejected)
    day = batch.agg(F.max(F.col(landed).cast("date"))).first()[0]  # one value
    past = stored.before(day)
    projected = project_turnover(accepted.dropDuplicates([*keys, "ts_code"]), F.col("now"))  # what is left of a security are equal copies
    known = keyed(past.panel, BARS, keys)
    today = hand_off(live_bars(projected, known, keys))  # a row for each security, read by every module
    panel = known.unionByName(today)
    limits = keyed(past.limits, LIMITS, keys).unionByName(keyed((live_limits or infer_limits)(today), LIMITS, keys))
    index = keyed(past.index_bars, INDEX_BARS, keys).unionByName(keyed(live_index(today), INDEX_BARS, keys))
    scored = intraday_temperature(panel, limits, index, past.factors, past.stretch, day.isoformat(), scoring.windows, scoring.quality, scoring.percentile, scoring.degenerate, keys, dedupe=False)
    clock = accepted.groupBy(*keys).agg(F.max("quote_as_of").alias("quote_as_of"), F.max("now").alias("calculated_at"), F.max("market_status").alias("market_status"), F.max("source").alias("source"), F.countDistinct("ts_code").alias("live_securities"))
    live = hand_off(scored.join(clock, list(keys), "left_semi").select(*keys, "trade_date", *DAILY))  # a row for each series
    states = hand_off(build_states(past.daily.select(*keys, "trade_date", *DAILY).unionByName(live), keys=keys))
    shown = states.filter(F.col("trade_date") == day).select(*keys, "trade_date", *STATE)
    advice = advisory_frame(states, keys).filter(F.col("trade_date") == day).select(*keys, *ADVICE)
    published = shown.join(advice, list(keys)).join(clock, list(keys)).withColumn("session_fraction", session_fraction(F.col("calculated_at")))
    return LiveBatch(published, rejected)


def run_live_chain(quotes: DataFrame, stored: Stored | Callable[[], Stored], live_index: LiveTable, published: SnapshotTable, rejected: SnapshotTable, checkpoint: str, scoring: Scoring = Scoring(), keys: Sequence[str] = ("market",), landed: str = "landed_at", name: str = "live-chain", untimed: str | None = None, live_limits: LiveTable | None = None) -> StreamingQuery:
    """Drains the available quotes. ``stored`` may be a function, which is then called for every batch, as after a close.
    ``published`` holds a row for each series and live day, ``rejected`` every quote that was refused; accepted and rejected
    quotes are together those of the input."""

    def publish(batch: DataFrame, number: int) -> None:
        if rejected.committed(name, number):  # a batch's last commit
            consume(batch)
            return
        rows = batch.persist()  # read by the gate, the chain and the rejects; a lost block is read from the source again
        try:
            if rows.count():
                found = score_live(rows, stored() if callable(stored) else stored, live_index, scoring, keys, landed, untimed, live_limits)
                if found.published is not None:
                    published.upsert(found.published, name, number)
                rejected.append(found.rejected, name, number)
        finally:
            rows.unpersist()

    return quotes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
