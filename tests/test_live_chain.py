"""The live chain: the gate's verdicts, master data, and a replay that changes nothing."""

import datetime as dt

from conftest import frame
from pyspark.sql import functions as F

from tidegauge.params import Quality
from tidegauge.registry import live as reg
from tidegauge.schemas import BARS, QUOTES, conform
from tidegauge.sources import tables as tb
from tidegauge.sources import testdata as td
from tidegauge.sources.snapshots import SnapshotTable
from tidegauge.streaming import chain as ch
from tidegauge.streaming import quotes as qt

SF = "/root/testdata/sf0.001"
DDL = QUOTES + ", source string, source_rank int, landed_at timestamp"


def at(clock, day="2026-08-20"):
    return dt.datetime.fromisoformat(f"{day} {clock}")


def quote(market, code, stamp, landed, source="a", rank=0, close=10.0, **more):
    row = dict.fromkeys([part.strip().split(" ")[0] for part in DDL.split(",")])
    return tuple((row | {"quote_time": stamp, "market": market, "ts_code": code, "close": close, "source": source, "source_rank": rank, "landed_at": landed} | more).values())


def test_gate_gives_every_quote_a_verdict(spark):
    now = at("10:04:00")
    rows = [
        quote("M", "600000", at("10:03:30"), now), quote("M", "600000", at("10:03:10"), now), quote("M", "600001", at("10:02:00"), now),
        quote("M", "600001", at("10:03:50"), now, "b", 1), quote("M", None, at("10:03:00"), now),
        quote("N", "600000", at("10:00:00"), now), quote("O", "600000", at("15:00:00", "2026-08-19"), now), quote("P", "1", None, now), quote("Q", "1", at("10:04:00"), now, None, None),
        quote("M", "600000", at("10:03:30"), now),
    ]
    accepted, rejected = ch.gated(frame(spark, DDL, rows), ["market"], "landed_at")
    kept, gone = accepted.collect(), rejected.collect()
    assert len(kept) + len(gone) == len(rows)
    assert sorted((r.market, r.ts_code, r.quote_time.strftime("%H:%M:%S")) for r in kept) == [("M", "600000", "10:03:30")] * 2 + [("M", "600001", "10:02:00"), ("Q", "1", "10:04:00")]
    assert sorted((r.market, r.reason) for r in gone) == [("M", "NO_CODE"), ("M", "OLDER_QUOTE"), ("M", "SUPERSEDED_SOURCE"), ("N", "STALE"), ("O", "NOT_TODAY"), ("P", "NO_TIMESTAMP")]
    untimed, _ = ch.gated(frame(spark, DDL + ", untimed boolean", [(*r, True) for r in rows]), ["market"], "landed_at", "untimed")
    assert "P" in {r.market for r in untimed.collect()}


def test_master_data_comes_from_the_newest_stored_row(spark):
    day = dt.date(2026, 8, 18)
    stored = frame(spark, "market string, ts_code string, trade_date date, close double, name string, is_st int, list_date date, row_seq bigint", [("M", "1", day, 9.0, "old", 0, None, 1), ("M", "1", day + dt.timedelta(1), 9.0, "*ST new", 1, day, 1), ("M", "2", day, 9.0, "two", 0, day, 1)])
    now = at("10:04:00")
    rows = [quote("M", "1", at("10:03:00"), now, close=float("nan")), quote("M", "2", at("10:03:00"), now, name="renamed"), quote("M", "3", at("10:03:00"), now)]
    bars = {r.ts_code: r for r in ch.live_bars(frame(spark, DDL, rows).withColumn("now", F.col("landed_at")), conform(stored, BARS)).collect()}
    assert (bars["1"].name, bars["1"].is_st, bars["1"].list_date, bars["1"].close) == ("*ST new", 1, day, None)
    assert (bars["2"].name, bars["3"].name) == ("renamed", None) and {r.trade_date for r in bars.values()} == {dt.date(2026, 8, 20)}


def test_a_replayed_stream_changes_neither_table(spark, tmp_path):
    polls = tb.hand_off(td.live_polls(spark, SF, reg.LIVE_DAY).filter("poll <> 1"))
    folder = reg.landed(spark, polls, "polls", [f"{reg.LIVE_DAY} {t}" for t in ("00:00:00", "11:00:00", "23:59:59")], "landed_at")
    published, rejected = SnapshotTable(spark, str(tmp_path / "live"), ["market", "trade_date"]), SnapshotTable(spark, str(tmp_path / "no"))
    stored = reg.stored_history(spark, SF)
    scoring = ch.Scoring(reg.W, Quality(**{**reg.Q.__dict__, "minimum_universe": 1}), td.PERCENTILE)
    for run in range(2):
        stream = qt.read_quotes(spark, folder, polls.schema, "parquet", reg.FILES)
        query = ch.run_live_chain(stream, stored, reg.live_index, published, rejected, str(tmp_path / f"ck{run}"), scoring, live_limits=reg.live_pools)
        query.awaitTermination()
        assert query.exception() is None
        seen = (published.versions(), rejected.versions(), sorted(map(str, published.read().collect())), rejected.read().count())
        if run:
            assert seen == before
        before = seen
    # the gate refuses a poll of old stamps whole, so only the close publishes
    markets = {r.market for r in polls.collect()}
    assert {r.market for r in published.read().collect()} == markets and {str(r.trade_date) for r in published.read().collect()} == {reg.LIVE_DAY}
    assert {r.market_status for r in published.read().collect()} == {"CLOSED"}
    live = published.read().agg(F.sum("live_securities")).first()[0]
    assert live + rejected.read().count() == polls.count()
