"""State machine, advisory, event study and live layer."""

import datetime as dt
import math
from types import SimpleNamespace

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from tidegauge.operators import events as ev
from tidegauge.operators import study as st
from tidegauge.operators.advisory import advisory_frame, audit_checks
from tidegauge.operators.regime import regime_indicators
from tidegauge.operators.state_machine import OUTPUT_COLUMNS, STATES, MachineState, build_states, step, zone_of
from tidegauge.operators.zones import add_zones
from tidegauge.params import Machine, Variant, vary
from tidegauge.sources import tables as tb
from tidegauge.sources import vendor as vd
from tidegauge.sources.snapshots import SnapshotTable
from tidegauge.streaming import live as lv
from tidegauge.streaming import quotes as qt

DAY0 = dt.date(2024, 1, 1)
DAILY = "market string, trade_date date, raw_market_temperature double, breadth_score double, profit_effect_score double, liquidity_score double, stretch_score double, market_temperature_quality string, data_quality_warnings string, observed_universe bigint"


def day(i):
    return DAY0 + dt.timedelta(days=i)


def wave(spark, markets=("M",), n=150):
    """An exact integer wave that visits both extremes, with an invalid day every 41st."""
    rows = []
    for k, m in enumerate(markets):
        for i in range(n):
            t = (i * 7 + k * 13) % 200
            raw = float(abs(t - 100))
            mods = [float(abs((i * 7 + k * 13 - 7 * (j % 2)) % 200 - 100)) for j in range(4)]
            bad = i % 41 == 40
            rows.append((m, day(i), None if bad else raw, *mods, "INVALID" if bad else "B", "", 10))
    return frame(spark, DAILY, rows)


def row(temp, slope=0.0, raw=None, valid=True, **kw):
    base = dict(
        regime_valid_observation=valid, smoothed_temperature=float(temp), raw_temperature=float(temp if raw is None else raw), slope3=float(slope), improving_modules=0, deteriorating_modules=0,
        breadth_delta3=0.0, profit_effect_delta3=0.0, panic_anchor_event=False, euphoria_anchor_event=False, rolling_low_10=math.nan, recovery_from_low=math.nan, rolling_high_10=math.nan, drop_from_high=math.nan,
    )
    return SimpleNamespace(**{**base, **kw})


def play(rows, variant=Variant(), legacy=False):
    s = MachineState()
    return [dict(zip(OUTPUT_COLUMNS, step(s, r, variant, legacy))) for r in rows]


UP = dict(improving_modules=3, breadth_delta3=1.0)


def test_panic_watch_confirm_close():
    out = play([row(15, -5, panic_anchor_event=True), row(21, 6, **UP), row(26, 6, **UP), row(30, 4, **UP), row(15, -9, panic_anchor_event=True)])
    assert [o["state"] for o in out] == ["PANIC_FALLING", "ICE_REVERSAL_WATCH", "ICE_REVERSAL", "COLD", "PANIC_FALLING"]
    assert out[2]["signal"] == "ICE_REVERSAL_CONFIRMED" and out[2]["recent_panic_episode"] and out[2]["panic_episode_closed"]
    assert not out[3]["recent_panic_episode"] and out[3]["panic_episode_closed"]
    assert out[4]["panic_episode_id"] == 2 and out[4]["panic_episode_age"] == 1


def test_watch_times_out_and_is_invalidated():
    quiet = dict(improving_modules=0)
    out = play([row(15, -5, panic_anchor_event=True), row(21, 6, **UP), *[row(22, 1, **quiet) for _ in range(5)]])
    assert [o["watch_streak"] for o in out[1:]] == [1, 2, 3, 4, 5, 0] and out[-1]["watch_timeout"]
    out = play([row(15, -5, panic_anchor_event=True), row(21, 6, **UP), row(20, -1)])
    assert out[2]["watch_invalidated"] and out[2]["state"] == "PANIC_FALLING"


def test_invalid_day_resets_memory_but_not_ids_or_zone():
    out = play([row(15, -5, panic_anchor_event=True), row(math.nan, valid=False), row(40, 5), row(15, -5, panic_anchor_event=True)])
    assert out[1]["state"] == "DATA_INVALID" and out[1]["panic_episode_id"] is None and out[1]["panic_episode_closed"]
    assert out[2]["panic_episode_closed"] and not out[2]["recent_panic_episode"]
    assert out[3]["panic_episode_id"] == 2


def test_episode_expires_after_memory_window():
    out = play([row(15, -5, panic_anchor_event=True), *[row(45, 0) for _ in range(10)]])
    assert out[9]["recent_panic_episode"] and not out[10]["recent_panic_episode"] and out[10]["panic_episode_closed"]


def test_zone_hysteresis():
    z, seen = "", []
    for x in (71, 68, 66, 69, 70, 29, 32, 34):
        z = zone_of(x, z, 30, 70, 3)
        seen.append(z)
    assert seen == ["HOT", "HOT", "NORMAL", "NORMAL", "HOT", "COLD", "COLD", "NORMAL"]


def test_legacy_rows_use_rolling_extremes():
    out = play([row(18, -1), row(26, 5, rolling_low_10=18.0, recovery_from_low=8.0, **UP), row(30, 5, rolling_low_10=18.0, recovery_from_low=12.0, **UP)], legacy=True)
    assert [o["state"] for o in out] == ["PANIC_FALLING", "ICE_REVERSAL_WATCH", "ICE_REVERSAL"]


def test_parameters_are_validated():
    with pytest.raises(ValueError):
        Machine(cool_threshold=90.0)
    assert vary("memory_window", 5.0).anchors.memory_window == 5


def test_states_are_causal_and_keys_independent(spark):
    columns = ["market", "variant_id", "trade_date", "state", "signal", "panic_episode_id", "euphoria_episode_id", "state_duration"]
    collect = lambda df: {tuple(r)[:3]: tuple(r)[3:] for r in df.select(*columns).collect()}
    variants = [Variant(), vary("ema_span", 2.0), vary("slope_lookback", 2.0)]
    both = collect(build_states(wave(spark, ("M", "N")), variants))
    assert len(both) == 2 * 150 * 3 and {v[0] for v in both.values()} > {"PANIC_FALLING", "ICE_REVERSAL", "HOT_ROLLOVER", "DATA_INVALID"}
    one = collect(build_states(wave(spark, ("M",)), [Variant()]))
    assert one == {k: v for k, v in both.items() if k[0] == "M" and k[1] == "default"}
    prefix = collect(build_states(wave(spark, ("M",), 90), [Variant()]))
    assert prefix == {k: v for k, v in one.items() if k[2] < day(90)}


def test_stream_equals_batch_across_triggers_and_reports_late_days(spark, tmp_path):
    indicators = regime_indicators(wave(spark)).drop("p")
    landing, target = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 50), (50, 110), (110, 150)):
        indicators.filter((F.col("trade_date") >= F.lit(day(low))) & (F.col("trade_date") < F.lit(day(high)))).coalesce(1).write.mode("append").parquet(landing)
    read = lambda: spark.readStream.schema(indicators.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    lv.run_stream_states(spark, read(), target, str(tmp_path / "ck"))
    columns = ["trade_date", "state", "signal", "panic_episode_id", "watch_streak", "post_panic_low"]
    got = [tuple(r) for r in spark.read.parquet(target).orderBy("trade_date").select(*columns).collect()]
    want = [tuple(r) for r in build_states(wave(spark)).orderBy("trade_date").select(*columns).collect()]
    assert got == want
    indicators.filter(F.col("trade_date") == F.lit(day(3))).coalesce(1).write.mode("append").parquet(landing)
    lv.run_stream_states(spark, read(), target, str(tmp_path / "ck"))
    late = spark.read.parquet(target).filter("late").collect()
    assert len(late) == 1 and late[0].trade_date == day(3) and late[0].state is None


def test_advisory_covers_every_state(spark):
    states = build_states(wave(spark, ("M", "N"), 200))
    out = advisory_frame(states)
    checks = audit_checks(out).collect()
    assert all(c.state_signal_consistent and c.data_invalid_hard_gate and c.vocabulary_ok and c.card_complete for c in checks)
    assert out.filter("why LIKE '%{%'").count() == 0
    assert {r.state for r in out.select("state").distinct().collect()} <= set(STATES)


def prices(spark, n=25, hole=None):
    rows = [("M", "I", day(i), 100.5 + i, 102.0 + i, None if i == hole else 98.0 + i, 100.0 + i) for i in range(n)]
    return ev.prepare_benchmark(frame(spark, "market string, benchmark string, trade_date date, open double, high double, low double, close double", rows))


def outcome(df, i, h):
    return df.filter((F.col("trade_date") == F.lit(day(i))) & (F.col("horizon") == h)).collect()[0]


def test_forward_outcomes_by_hand(spark):
    df = ev.forward_outcomes(prices(spark))
    first = outcome(df, 0, 3)
    assert abs(first.ret - (103 / 101.5 - 1)) < 1e-12 and abs(first.mfe - (105 / 101.5 - 1)) < 1e-12 and abs(first.mae - (99 / 101.5 - 1)) < 1e-12
    assert first.price_status == "TRUNCATED_HORIZON" and outcome(df, 0, 40).ret is None
    assert outcome(df, 24, 1).entry_price is None and outcome(df, 24, 1).price_status == "TRUNCATED_HORIZON"
    holed = ev.forward_outcomes(prices(spark, hole=2), (1, 3))
    assert outcome(holed, 0, 1).ret is not None and outcome(holed, 0, 3).ret is None and outcome(holed, 0, 3).price_status == "MISSING_PRICE"


def test_peak_to_trough_against_brute_force(spark):
    rng = np.random.default_rng(5)
    high = rng.integers(50, 100, 70).astype(float)
    low = high - rng.integers(1, 20, 70)
    rows = [("M", "I", day(i), float(low[i]), float(high[i]), float(low[i]), float(low[i])) for i in range(70)]
    df = ev.forward_outcomes(frame(spark, "market string, benchmark string, trade_date date, open double, high double, low double, close double", rows), (20,))
    for i in (0, 7, 30):
        window = slice(i + 1, i + 21)
        assert abs(outcome(df, i, 20).ptdd - (low[window] / np.maximum.accumulate(high[window]) - 1).min()) < 1e-12


def test_decluster_keeps_first_and_third(spark):
    events = frame(spark, "market string, event_id string, event_type string, direction string, episode_id string, date date, date_position bigint", [("M", n, "X", "ICE", e, day(p), p) for n, e, p in (("a", "1", 0), ("b", "1", 20), ("c", "2", 41))])
    ids = lambda mode: sorted(r.event_id for r in ev.decluster_events(events, mode, 20).collect())
    assert ids("declustered") == ["a", "c"] and ids("episode") == ["a", "c"] and ids("raw") == ["a", "b", "c"]
    sets = {(r.event_id, r.event_set) for r in ev.event_sets(events).collect()}
    assert {e for e, s in sets if s == "declustered"} == {"a", "c"} and len(sets) == 7
    with pytest.raises(ValueError):
        ev.decluster_events(events, "other")


def test_bootstrap_is_close_to_numpy_and_repeats(spark):
    rng = np.random.default_rng(11)
    xs = [float(x) for x in rng.normal(0.02, 0.05, 40)]
    df = frame(spark, "cell string, ret double", [("a", x) for x in xs] + [("one", 0.5), ("none", None)])
    got = {r.cell: r for r in st.bootstrap_intervals(df, ["cell"], samples=4000).collect()}
    again = {r.cell: r for r in st.bootstrap_intervals(df.repartition(7), ["cell"], samples=4000).collect()}
    assert got == again and "none" not in got and got["one"].MeanCI95Low == got["one"].MedianCI95High == 0.5
    draws = np.array(xs)[np.random.default_rng(42).integers(0, 40, (20000, 40))]
    low, high = np.percentile(draws.mean(axis=1), [2.5, 97.5])
    assert abs(got["a"].MeanCI95Low - low) < 0.003 and abs(got["a"].MeanCI95High - high) < 0.003
    low, high = np.percentile(np.median(draws, axis=1), [2.5, 97.5])
    assert abs(got["a"].MedianCI95Low - low) < 0.006 and abs(got["a"].MedianCI95High - high) < 0.006


def test_bootstrap_draws_equal_cells_once_and_in_ranges_of_samples(spark):
    rng = np.random.default_rng(3)
    sets = {"a": rng.normal(size=31), "b": rng.normal(size=30), "c": rng.normal(size=31), "one": np.array([0.25])}
    sets["a again"] = sets["a"][::-1]
    df = spark.createDataFrame([(c, float(x)) for c, v in sets.items() for x in v], "cell string, ret double")
    whole, parts = ({r.cell: tuple(r)[1:] for r in st.bootstrap_intervals(df, ["cell"], samples=999, chunk_draws=n).collect()} for n in (1 << 22, 700))
    assert set(whole) == set(sets) and whole["a"] == whole["a again"] and whole == parts
    for c, v in sets.items():
        drawn = np.sort(v)[st.drawn_places(42, np.arange(999), len(v))]
        want = [*np.percentile(drawn.mean(axis=1), [2.5, 97.5]), *np.percentile(np.median(drawn, axis=1), [2.5, 97.5])]
        assert np.allclose(whole[c], want, rtol=1e-12, atol=1e-15)



def test_evidence_labels(spark):
    rows = [(5, 0.1, 0.1, 0.1, None, None), (12, 0.1, 0.1, -0.1, None, None), (25, 0.1, 0.1, 0.1, 0.02, 0.2), (12, 0.1, 0.1, 0.1, 0.02, 0.2), (12, 0.1, 0.1, 0.1, -0.1, 0.2), (12, 0.1, -0.1, 0.1, 0.02, 0.2)]
    df = frame(spark, "n bigint, mean double, med double, x double, lo double, hi double", rows)
    c = F.col
    got = [r.e for r in df.select(st.evidence_label(c("n"), c("mean"), c("med"), c("x"), c("lo"), c("hi"), F.lit(True)).alias("e")).collect()]
    assert got == ["INCONCLUSIVE", "NEGATIVE", "STRONG", "MODERATE", "WEAK", "INCONCLUSIVE"]


def test_market_clock_and_freshness(spark):
    at = lambda text: F.lit(f"2026-03-02 {text}").cast("timestamp")
    got = spark.range(1).select(*[F.struct(qt.session_status(at(t)), qt.session_fraction(at(t))).alias(n) for n, t in (("a", "09:00:00"), ("b", "10:30:00"), ("c", "12:00:00"), ("d", "14:00:00"), ("e", "15:30:00"))]).collect()[0]
    assert [tuple(x) for x in got] == [("PREOPEN", 0.0), ("OPEN", 0.25), ("LUNCH", 0.5), ("OPEN", 0.75), ("CLOSED", 1.0)]
    q = frame(spark, "source string, quote_time timestamp", [("s", dt.datetime(2026, 3, 2, 10, 26)), ("t", dt.datetime(2026, 3, 2, 10, 28)), ("u", None)])
    gate = {r.source: r.reason for r in qt.freshness_gate(q, at("10:30:00"), untimed_ok=F.lit(False)).collect()}
    assert gate == {"s": "STALE", "t": None, "u": "NO_TIMESTAMP"}


def test_quote_text_amount_and_short_records(spark):
    fields = ["1", "Name", "600000", "10.5", "10.0", "10.1", "1234"] + ["0"] * 23 + ["20260302143000", "0", "5.0", "10.9", "9.9", "10.5/1234/1596598790"]
    text = 'v_sh600000="' + "~".join(fields) + '";\nv_sz000001="1~short";'
    rows = vd.parse_quote_text(frame(spark, "market string, payload string", [("M", text)])).collect()
    assert len(rows) == 1 and rows[0].ts_code == "600000.SH" and rows[0].amount_rmb == 1596598790.0 and rows[0].trade_date == dt.date(2026, 3, 2)


def test_partitioned_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "k string, yr int, v int, row_seq bigint"
    tb.save_dataset(frame(spark, ddl, [("a", 1, 1, 1), ("b", 2, 1, 1)]), path, ["yr"])
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "yr=1").iterdir()}
    tb.upsert_partitions(spark, path, frame(spark, ddl, [("b", 2, 9, 1), ("c", 2, 9, 1)]), ["k"], "yr")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9), ("c", 9)]
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "yr=1").iterdir()}


def test_live_stream_publishes_only_the_live_day(spark, tmp_path):
    full = wave(spark)
    last = full.filter(F.col("trade_date") == F.lit(day(149)))
    last.coalesce(1).write.parquet(str(tmp_path / "live"))
    stream = spark.readStream.schema(full.schema).parquet(str(tmp_path / "live"))
    lv.run_live(stream, full, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = SnapshotTable(spark, str(tmp_path / "out")).read().collect()
    want = advisory_frame(build_states(full)).filter(F.col("trade_date") == F.lit(day(149))).collect()[0]
    assert len(got) == 1 and got[0].advisory_signal == want.advisory_signal and got[0].why == want.why


def test_live_table_keeps_other_series(spark, tmp_path):
    """Two markets arrive in two batches; the second batch must leave the first market's rows alone."""
    from tidegauge.sources.tables import save_dataset

    target = str(tmp_path / "live")
    for market in ("M", "N"):
        save_dataset(frame(spark, "market string, trade_date string, x int", [(market, "2024-01-02", 1)]), target, ["market"], bounded=True)
    save_dataset(frame(spark, "market string, trade_date string, x int", [("N", "2024-01-03", 2)]), target, ["market"], bounded=True)
    assert sorted((r.market, r.trade_date, r.x) for r in spark.read.parquet(target).collect()) == [("M", "2024-01-02", 1), ("N", "2024-01-03", 2)]


def test_composed_zones_equal_the_day_by_day_rule(spark):
    rng = np.random.default_rng(5)
    start, rows = dt.date(2020, 1, 1), []
    for market, gap in (("A", 1), ("B", 9), ("C", 40)):  # many rows a block, a few, blocks of one
        for i in range(300):
            value = None if rng.random() < 0.1 else float(rng.choice([rng.uniform(0, 100), 27, 30, 33, 67, 70]))
            rows.append((market, "v", start + dt.timedelta(days=i * gap), value is not None and bool(rng.random() < 0.95), value, float("nan") if i % 50 == 7 else value))
    df = frame(spark, "market string, variant_id string, trade_date date, regime_valid_observation boolean, raw_temperature double, smoothed_temperature double", rows)
    df = df.withColumn("p", F.struct(F.lit(30.0).alias("cool_threshold"), F.lit(70.0).alias("warm_threshold"), F.lit(3.0).alias("zone_hysteresis")))
    zoned = add_zones(df)
    got = {(r.market, r.trade_date): r.zone_state for r in zoned.collect()}
    zone, want = {}, {}
    for market, _, day, valid, raw, smooth in rows:
        if valid and raw is not None and smooth == smooth:
            zone[market] = zone_of(smooth, zone.get(market, ""), 30, 70, 3)
            want[market, day] = zone[market]
        else:
            want[market, day] = "DATA_INVALID"
    assert got == want and set(want.values()) == {"HOT", "NORMAL", "COLD", "DATA_INVALID"}
    assert "Python" not in zoned._jdf.queryExecution().toString() and "Pandas" not in zoned._jdf.queryExecution().toString()
    assert add_zones(df.limit(0)).count() == 0


@pytest.mark.parametrize("window", [0, 3, 20])
def test_decluster_equals_a_greedy_loop(spark, window):
    rng = np.random.default_rng(window)
    rows = [("M", "ICE", "T", f"{k}", None if k % 3 else str(k), int(p), dt.date(2020, 1, 1) + dt.timedelta(days=int(p))) for k, p in enumerate(np.sort(rng.choice(900, 400, replace=False)))]
    rows += [("M", "HOT", "T2", "single", None, 5, dt.date(2020, 1, 6))]
    events = frame(spark, "market string, direction string, event_type string, event_id string, episode_id string, date_position long, date date", rows)
    last, want = None, {"single"}
    for _, direction, _, name, _, at, _ in rows:
        if direction == "ICE" and (last is None or at - last > window):
            last = at
            want.add(name)
    assert {r.event_id for r in ev.decluster_events(events, "declustered", window).collect()} == want
    assert {r.event_id for r in ev.event_sets(events, window).filter("event_set = 'declustered'").collect()} == want
