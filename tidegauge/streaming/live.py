"""Live-day scoring against persisted history and the incremental state machine."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.advisory import advisory_frame
from ..operators.state_machine import OUTPUT, OUTPUT_COLUMNS, MachineState, build_states, run_series
from ..params import Variant
from ..sources.snapshots import SnapshotTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def live_snapshot(history: DataFrame, live: DataFrame, keys: Sequence[str] = ("market",)) -> tuple[DataFrame, DataFrame]:
    """State and advisory rows of the live day. The live row replaces a persisted row of the same day and
    nothing is written back to the history."""
    past = history.join(live.select(*keys, "trade_date"), [*keys, "trade_date"], "left_anti")
    states = build_states(past.unionByName(live, allowMissingColumns=True), keys=keys)
    advisory = advisory_frame(states, keys)
    today = live.select(*keys, "trade_date")
    return states.join(today, [*keys, "trade_date"], "left_semi"), advisory.join(today, [*keys, "trade_date"], "left_semi")


def run_live(live_daily: DataFrame, history: DataFrame | Callable[[], DataFrame], target: str, checkpoint: str, keys: Sequence[str] = ("market",)) -> StreamingQuery:
    """Per micro-batch of scored live rows, upsert the live days' advisory into a snapshot table under the batch id; other
    series and days keep theirs. ``history`` may be a function, which is then called for every batch."""
    table = SnapshotTable(live_daily.sparkSession, target, [*keys, "trade_date"])

    def publish(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            _, advisory = live_snapshot(history() if callable(history) else history, batch, keys)
            table.upsert(advisory, "live", number)

    return live_daily.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SeriesMachine(StatefulProcessor):
    """Keeps one machine per series and steps it through newly arrived days.

    Days at or before the last processed one are late: they are returned with ``late`` set and no state,
    so that the caller can report them.
    """

    def __init__(self, variants: dict[str, Variant]) -> None:
        self.variants = variants

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("machine", T.StructType([T.StructField("payload", T.StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("trade_date", ignore_index=True)
        saved = json.loads(self.saved.get()[0]) if self.saved.exists() else {"last": "", "machine": MachineState().to_dict()}
        machine = MachineState.from_dict(saved["machine"])
        late = pdf["trade_date"].astype(str) <= saved["last"]
        fresh = pdf[~late].drop_duplicates("trade_date").reset_index(drop=True)
        parts = []
        if len(fresh):
            parts.append(pd.concat([fresh, run_series(fresh, self.variants[fresh["variant_id"].iat[0]], machine), pd.Series(False, index=fresh.index, name="late")], axis=1))
            self.saved.update((json.dumps({"last": str(fresh["trade_date"].iat[-1]), "machine": machine.to_dict()}),))
        if late.any():
            parts.append(pdf[late].assign(**dict.fromkeys(OUTPUT_COLUMNS), late=True))
        for part in parts:
            yield part

    def close(self) -> None:
        pass


def stream_states(indicators: DataFrame, variants: Sequence[Variant] | None = None, keys: Sequence[str] = ("market",)) -> DataFrame:
    """State machine over a stream of indicator rows, one fold per series with durable state."""
    lookup = {v.variant_id: v for v in (variants or [Variant()])}
    slim = indicators.drop("p")
    schema = T.StructType([*slim.schema.fields, *T.StructType.fromDDL(OUTPUT).fields, T.StructField("late", T.BooleanType())])
    return slim.groupBy(*keys, "variant_id").transformWithStateInPandas(statefulProcessor=SeriesMachine(lookup), outputStructType=schema, outputMode="Append", timeMode="None")


def run_stream_states(spark: SparkSession, indicators: DataFrame, target: str, checkpoint: str, variants: Sequence[Variant] | None = None, keys: Sequence[str] = ("market",)) -> None:
    """Drain the available input into a state table; the keyed state needs the RocksDB provider."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    try:
        query = stream_states(indicators, variants, keys).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)
