"""The freshness gate on a stream: every quote gets a verdict, and a source that falls silent is declared stale by a timer.

A source's state holds its newest accepted stamp and its last poll. Sources are judged poll by poll: the rule of
``freshness_gate`` takes or refuses a poll as a whole, and in an accepted poll a stamp further behind the newest one than
``lateness`` is late. The state is asked with a poll's newest stamps only, and its answer is joined to the rows of the same
micro-batch, so the rows of one source stay where they were read. The watermark runs on the time a row was taken, never on
its stamp, so however files are shuffled no row is dropped unseen; event time passes as other sources deliver, and with it
the silent source's timer.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.snapshots import SnapshotTable
from ..sources.tables import drop_path, scratch_path
from .live import PROVIDER_KEY, ROCKSDB
from .quotes import CLOSE_AM, CLOSE_FLOOR, CLOSE_PM, LUNCH_FLOOR, MAX_STALENESS_SECONDS, OPEN_AM, OPEN_PM

VERDICT = "kind string, reason string, verdict_at timestamp, late_before timestamp"
PARTITIONS_KEY = "spark.sql.shuffle.partitions"
QUOTE, POLL, STATUS = "quote", "poll", "status"


def session_of(clock: str) -> str:
    """Session phase at ``HH:MM:SS.ffffff``, as ``session_status`` gives it for a column."""
    if clock < OPEN_AM:
        return "PREOPEN"
    if clock <= CLOSE_AM:
        return "OPEN"
    if clock < OPEN_PM:
        return "LUNCH"
    return "OPEN" if clock <= CLOSE_PM else "CLOSED"


def poll_reason(newest: pd.Timestamp | None, now: pd.Timestamp, max_staleness: int = MAX_STALENESS_SECONDS) -> str | None:
    """Why a poll is refused, or None."""
    if newest is None or pd.isna(newest):
        return "NO_TIMESTAMP"
    if newest.date() != now.date():
        return "NOT_TODAY"
    phase, seen = session_of(now.strftime("%H:%M:%S.%f")), newest.strftime("%H:%M:%S")
    if phase == "OPEN" and now - newest > dt.timedelta(seconds=max_staleness):
        return "STALE"
    if phase == "LUNCH" and seen < LUNCH_FLOOR:
        return "LUNCH_TIMESTAMP"
    return "CLOSE_TIMESTAMP" if phase == "CLOSED" and seen < CLOSE_FLOOR else None


class QuoteGate(StatefulProcessor):
    """One source: judges its polls in order and keeps one timer, which its next accepted poll puts off. Its rows are newest
    stamps of parts of polls; it answers a row a poll, with the stamp before which quotes are late."""

    def __init__(self, keys: Sequence[str], landed: str, lateness: dt.timedelta, max_staleness: int) -> None:
        self.keys, self.landed, self.lateness, self.max_staleness = list(keys), landed, lateness, max_staleness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("source", T.StructType([T.StructField("payload", T.StringType())]))

    def load(self) -> dict[str, Any]:
        return json.loads(self.saved.get()[0]) if self.saved.exists() else {"newest": None, "status": None, "timer": None}

    def answer(self, key: Any, kind: str, reason: str | None, at: Any, landed: Any = None, late_before: Any = None) -> pd.DataFrame:
        row = dict(zip(self.keys, key, strict=True)) | {self.landed: landed}
        return pd.DataFrame([row | {"kind": kind, "reason": reason, "verdict_at": at, "late_before": late_before}])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.load()
        polls = pd.concat([part.groupby(self.landed, dropna=False)["quote_time"].max() for part in rows])
        for now, newest in polls.groupby(level=0, sort=True, dropna=False).max().items():
            reason = "NOT_LANDED" if pd.isna(now) else poll_reason(newest, now, self.max_staleness)
            late_before = None
            if reason is None:
                before = pd.Timestamp(state["newest"]) if state["newest"] else None
                if before is not None:
                    late_before = before - self.lateness
                state["newest"] = str(newest if before is None else max(newest, before))
                if state["timer"] is not None:
                    self.handle.deleteTimer(state["timer"])
                state["timer"] = int((now + pd.Timedelta(seconds=self.max_staleness)).timestamp() * 1000)
                self.handle.registerTimer(state["timer"])
                if state["status"] != "CURRENT":
                    state["status"] = "CURRENT"
                    yield self.answer(key, STATUS, "CURRENT", now)
            yield self.answer(key, POLL, reason, now, now, late_before)
        self.saved.update((json.dumps(state),))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self.load()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        if state["timer"] == expired:
            state |= {"status": "STALE", "timer": None}
            self.saved.update((json.dumps(state),))
            yield self.answer(key, STATUS, "STALE", pd.Timestamp(expired, unit="ms"))

    def close(self) -> None:
        pass


def newest_stamps(quotes: DataFrame, keys: Sequence[str], landed: str) -> DataFrame:
    """Newest stamp of each poll's part in an Arrow batch, where the rows are: a stream has no aggregate within a micro-batch."""
    by = [*dict.fromkeys([*keys, landed])]
    narrow = quotes.select(*by, "quote_time")

    def newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pa.Table.from_batches([batch]).group_by(by).aggregate([("quote_time", "max")])
            yield from parts.select([*by, "quote_time_max"]).rename_columns(batch.schema.names).cast(batch.schema).to_batches()

    return narrow.mapInArrow(newest, narrow.schema)


def judged_polls(quotes: DataFrame, keys: Sequence[str] = ("source",), landed: str = "landed_at", lateness: str = "3 minutes", max_staleness: int = MAX_STALENESS_SECONDS) -> DataFrame:
    """The quotes of the stream as they are, a verdict row for each poll of a source, and a status row where a source turns CURRENT
    or STALE. ``landed`` is when a row was taken; it must not go back by more than a second from one micro-batch to the next."""
    schema = T.StructType([*[quotes.schema[c] for c in (*keys, landed)], *T.StructType.fromDDL(VERDICT).fields])
    gate = QuoteGate(keys, landed, pd.Timedelta(lateness).to_pytimedelta(), max_staleness)
    stamps = newest_stamps(quotes, keys, landed).withWatermark(landed, "1 second")
    answers = stamps.groupBy(*keys).transformWithStateInPandas(statefulProcessor=gate, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return quotes.withColumn("kind", F.lit(QUOTE)).unionByName(answers, allowMissingColumns=True)


def with_verdicts(rows: DataFrame, polls: DataFrame, columns: Sequence[str], keys: Sequence[str], landed: str) -> DataFrame:
    """Quotes with ``reason``, which is null where they are accepted. Each has its poll's verdict, since both come of one micro-batch."""
    verdicts = polls.select(*[F.col(c).alias(f"_{c}") for c in (*keys, landed)], F.col("reason").alias("_reason"), F.col("late_before").alias("_late_before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, landed)])
    reason = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(F.col("quote_time").isNull(), "NO_TIMESTAMP")
        .when(F.col("quote_time") < F.col("_late_before"), "LATE")
    )
    return rows.select(*columns).join(verdicts, same).select(*columns, reason.alias("reason"), F.col(landed).alias("verdict_at"))


def run_gate(spark: SparkSession, quotes: DataFrame, accepted: SnapshotTable, rejected: SnapshotTable, status: SnapshotTable, checkpoint: str, keys: Sequence[str] = ("source",), landed: str = "landed_at", lateness: str = "3 minutes", max_staleness: int = MAX_STALENESS_SECONDS, partitions: int | None = None) -> None:
    """Drains the available quotes into three tables, under each micro-batch's id: accepted and rejected rows, together those
    of the input, and the last status of each source (``status`` needs ``keys`` and order ``since``). The verdicts of a
    micro-batch are stored, so that Spark knows how small they are when it joins the rows to them. ``partitions`` of the
    state, by default those of the session, each cost a micro-batch about half a second of a core; few sources need few."""
    columns = quotes.columns

    def publish(batch: DataFrame, number: int) -> None:
        rows, verdicts = batch.persist(), scratch_path(spark, "verdicts")  # the state moves once, whatever the tables below already know
        try:
            rows.count()
            rows.filter(F.col("kind") != QUOTE).write.parquet(verdicts)
            answers = batch.sparkSession.read.schema(rows.schema).parquet(verdicts)
            judged = with_verdicts(rows.filter(F.col("kind") == QUOTE), answers.filter(F.col("kind") == POLL), columns, keys, landed)
            accepted.append(judged.filter(F.col("reason").isNull()).drop("reason"), "gate", number)
            rejected.append(judged.filter(F.col("reason").isNotNull()), "gate", number)
            turned = answers.filter(F.col("kind") == STATUS).select(*keys, F.col("reason").alias("status"), F.col("verdict_at").alias("since"))
            status.upsert(turned, "gate", number)
        finally:
            rows.unpersist()
            drop_path(spark, verdicts)

    own = {PROVIDER_KEY: ROCKSDB} | ({} if partitions is None else {PARTITIONS_KEY: str(partitions)})
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        judged = judged_polls(quotes, keys, landed, lateness, max_staleness)
        query = judged.writeStream.outputMode("append").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
