"""The stateful freshness gate: verdicts, late rows, silent sources, nothing lost."""

import datetime as dt
import random
from collections import Counter

import pandas as pd
from conftest import frame
from pyspark.sql import functions as F

from tidegauge.sources.snapshots import SnapshotTable
from tidegauge.streaming import gate as gt
from tidegauge.streaming import quotes as qt

DDL = "source string, ts_code string, quote_time timestamp, landed_at timestamp, close double"
DAY = dt.datetime(2026, 8, 20)


def at(clock, day=DAY):
    return dt.datetime.combine(day.date(), dt.time.fromisoformat(clock))


def test_poll_verdicts_equal_the_batch_gate(spark):
    r = random.Random(1)
    clocks = ["09:00:00", "09:30:00", "10:04:00", "11:30:00", "11:30:00.5", "12:00:00", "13:00:00", "15:00:00", "15:00:01", "16:00:00"]
    rows = []
    for i in range(200):
        now = at(r.choice(clocks))
        stamp = r.choice([None, now, now - dt.timedelta(seconds=r.choice([179, 180, 181, 4000])), now - dt.timedelta(days=1), at("11:24:59"), at("11:25:00"), at("14:55:00")])
        rows.append((str(i), "1", stamp, now, 1.0))
    batch = {x.source: x.reason for x in qt.freshness_gate(frame(spark, DDL, rows), F.col("landed_at")).collect()}
    assert {s: gt.poll_reason(None if q is None else pd.Timestamp(q), pd.Timestamp(now)) for s, _, q, now, _ in rows} == batch
    assert len(set(batch.values())) == 6


class Run:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.files = spark, folder, 0
        self.accepted, self.rejected = (SnapshotTable(spark, f"{folder}/{n}") for n in ("accepted", "rejected"))
        self.status = SnapshotTable(spark, f"{folder}/status", ["source"], "since")

    def land(self, rows):
        frame(self.spark, DDL, rows).coalesce(1).write.mode("append").parquet(f"{self.folder}/landed")

    def drain(self, checkpoint="ck", **more):
        stream = qt.read_quotes(self.spark, f"{self.folder}/landed", DDL, "parquet", 1)
        gt.run_gate(self.spark, stream, self.accepted, self.rejected, self.status, f"{self.folder}/{checkpoint}", **more)

    def sources(self):
        return {r.source: (r.status, r.since.strftime("%H:%M:%S")) for r in self.status.read().collect()}


def test_shuffled_files_lose_no_row_and_a_silent_source_turns_stale(spark, tmp_path):
    run, r, rows = Run(spark, str(tmp_path)), random.Random(2), []
    for n in range(4):
        now = at("10:00:00") + dt.timedelta(minutes=5 * n)
        own = [(s, str(i), now - dt.timedelta(seconds=r.randint(0, 1500)), now, 1.0) for s in ("a", "b") for i in range(30)] + [("a", "x", now, now, 1.0), ("b", "x", now, now, 1.0)]
        own += [("quiet", "1", now, now, 1.0)] if n == 0 else []
        own += [("old", "1", now - dt.timedelta(days=1), now, 1.0), ("blank", "1", None, now, 1.0), ("a", "y", None, now, 1.0)]
        r.shuffle(own)
        rows += own
        run.land(own)
    run.drain()
    kept, gone = run.accepted.read(), run.rejected.read()
    assert Counter(kept.select("source", "ts_code", "quote_time").collect()) + Counter(gone.select("source", "ts_code", "quote_time").collect()) == Counter(frame(spark, DDL, rows).select("source", "ts_code", "quote_time").collect())
    newest = {}
    want = Counter()
    for n in range(4):
        now = at("10:00:00") + dt.timedelta(minutes=5 * n)
        for s, _, q, landed, _ in rows:
            if landed == now:
                reason = "NOT_TODAY" if s == "old" else "NO_TIMESTAMP" if q is None else "LATE" if s in newest and q < newest[s] - dt.timedelta(minutes=3) else None
                want[s, reason] += 1
        newest |= dict.fromkeys(("a", "b"), now)
    assert Counter((x.source, None) for x in kept.collect()) + Counter((x.source, x.reason) for x in gone.collect()) == want
    assert run.sources() == {"a": ("CURRENT", "10:00:00"), "b": ("CURRENT", "10:00:00"), "quiet": ("STALE", "10:03:00")}


def test_a_source_comes_back_and_a_replay_changes_nothing(spark, tmp_path):
    run = Run(spark, str(tmp_path))
    for minute, sources in ((0, "ab"), (5, "b"), (10, "b"), (15, "ab"), (16, "ab")):
        now = at("10:00:00") + dt.timedelta(minutes=minute)
        run.land([(s, "1", now, now, 1.0) for s in sources])
        if minute == 10:
            run.drain()
            assert run.sources() == {"a": ("STALE", "10:03:00"), "b": ("CURRENT", "10:00:00")}
    run.drain()  # state and timers survive between runs
    assert run.sources() == {"a": ("CURRENT", "10:15:00"), "b": ("CURRENT", "10:00:00")}
    before = [t.versions() for t in (run.accepted, run.rejected, run.status)]
    run.drain("another-checkpoint")
    assert [t.versions() for t in (run.accepted, run.rejected, run.status)] == before and run.accepted.read().count() == 8


def test_the_rows_of_a_source_stay_where_they_were_read(spark, tmp_path):
    """The state is asked with a few newest stamps, so no shuffle of the gate carries the 4,000 rows of its one source."""
    run = Run(spark, str(tmp_path))
    for minute in (0, 5):
        now = at("10:00:00") + dt.timedelta(minutes=minute)
        run.land([("a", str(i), now, now, 1.0) for i in range(2000)])
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    known = stages().size()
    run.drain()
    now = stages()
    assert run.accepted.read().count() == 4000 and now.size() > known
    assert max(now.apply(i).shuffleReadRecords() for i in range(now.size() - known)) < 100


def test_an_empty_stream(spark, tmp_path):
    run = Run(spark, str(tmp_path))
    run.land([])
    run.drain()
    assert run.status.versions() in ([], [1])


def test_the_quote_table_over_batches_and_replays(spark, tmp_path):
    """Three micro-batches, then the same files under a new checkpoint: the table keeps its version, and a key that no batch
    touches keeps its first folder."""
    ddl = "market string, ts_code string, quote_time timestamp, close double"
    for n in range(3):
        rows = [("M", code, at("10:00:00") + dt.timedelta(minutes=n), float(n)) for code in ("a", f"only{n}")]
        frame(spark, ddl, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    table = SnapshotTable(spark, str(tmp_path / "table"))
    for run in range(2):
        stream = qt.read_quotes(spark, str(tmp_path / "landed"), ddl, "parquet", 1)
        qt.run_latest_quotes(spark, stream, table.path, str(tmp_path / f"ck{run}")).awaitTermination()
        assert {r.ts_code: r.close for r in table.read().collect()} == {"a": 2.0, "only0": 0.0, "only1": 1.0, "only2": 2.0}
        written = [{r.ts_code for r in spark.read.parquet(f"{table.path}/{name}").collect()} for name in table.manifest().deltas]
        assert [w for w in written if w] == [{"a", "only0"}, {"a", "only1"}, {"a", "only2"}]
        if run:
            assert table.versions() == versions
        versions = table.versions()
