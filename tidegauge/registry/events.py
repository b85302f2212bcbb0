"""Event-study queries (EV)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import study as st
from ..operators.quality import changed_cells
from ..operators.state_machine import build_states
from ..params import ROBUSTNESS_GRID, grid
from ..sources import testdata as td
from ..sources.tables import hand_off
from .base import cte, register
from .regime import SPLIT, states
from .regime_sql import regime_ctes

B, H = td.BENCHMARKS, td.HORIZONS
ROBUST = grid(ROBUSTNESS_GRID)
DEFAULTS = {"raw_panic_threshold": 20.0, "raw_euphoria_threshold": 85.0, "ema_span": 3.0, "turning_delta": 5.0, "slope3_threshold": 4.0}
PERIODS = (("development", "1995-01-01", "1998-12-31"), ("holdout", "1999-01-01", "2099-12-31"))
regime_ctes("rob", ROBUST)
_CONF = ev.CONFIRMED_SIGNALS


def bench(spark, d, raw=None):
    """Benchmark bars with some days and prices missing."""
    day = F.dayofyear("trade_date")
    index = td.index_bars(spark, d, raw).filter(day % 47 != 9)
    return ev.prepare_benchmark(index.withColumns({"high": F.when(day % 61 != 5, F.col("high")), "open": F.when(day % 97 != 3, F.col("open"))}))


cte("bench", """
SELECT market, benchmark, trade_date, CASE WHEN dayofyear(trade_date) % 97 <> 3 THEN open END AS open, CASE WHEN dayofyear(trade_date) % 61 <> 5 THEN high END AS high, low, close
FROM index_bars WHERE dayofyear(trade_date) % 47 <> 9
""")


def _catalog_sql(p: str, name: str, extra: str = "") -> None:
    src = f"(SELECT *, row_number() OVER (PARTITION BY market, variant_id ORDER BY trade_date) - 1 AS date_position FROM {p}_state WHERE quality <> 'INVALID' AND raw_temperature IS NOT NULL)"
    base = "SELECT market, variant_id, {t} AS event_type, '{d}' AS direction, CAST({i} AS varchar) AS episode_id, trade_date AS date, date_position, signal AS original_signal, raw_temperature, smoothed_temperature, state FROM " + src + " WHERE {w}"
    parts = [base.format(t="signal", d=d, i=i, w=f"starts_with(signal, '{d}')") for d, i in (("ICE", "panic_episode_id"), ("HOT", "euphoria_episode_id"))]
    for k, d, s, y in (("panic", "ICE", "PANIC_EPISODE_START", "PANIC_EPISODE_DAY"), ("euphoria", "HOT", "EUPHORIA_EPISODE_START", "EUPHORIA_EPISODE_DAY")):
        act = f"recent_{k}_episode AND {k}_episode_id IS NOT NULL"
        parts.append(base.format(t=f"'{s}'", d=d, i=f"{k}_episode_id", w=act) + f" QUALIFY row_number() OVER (PARTITION BY market, variant_id, {k}_episode_id ORDER BY trade_date) = 1")
        parts.append(base.format(t=f"'{y}'", d=d, i=f"{k}_episode_id", w=act))
    cte(name, "SELECT *, event_type || ':' || strftime(date, '%Y-%m-%d') || ':0' AS event_id FROM (" + " UNION ALL ".join(f"({q})" for q in parts) + ")")


_catalog_sql("base", "catalog")
_catalog_sql("rob", "rob_catalog")


def catalog(spark, d, raw=None):
    return ev.event_catalog(states(spark, d, raw))


register("ev1_event_catalog", catalog, "market event_id event_type direction episode_id date date_position:n original_signal raw_temperature:f state", "catalog")


def _greedy(name: str, by: str, source: str) -> None:
    cols = ", ".join(f"k.{c.strip()}" for c in by.split(","))
    on = " AND ".join(f"e.{c.strip()} = k.{c.strip()}" for c in by.split(","))
    cte(name, f"SELECT {by}, min(date_position) AS pos FROM {source} GROUP BY {by} UNION ALL SELECT {cols}, min(e.date_position) FROM {name} k JOIN {source} e ON {on} AND e.date_position > k.pos + 20 GROUP BY {cols}")


_greedy("kept_type", "market, event_type", "catalog")
_greedy("kept_direction", "market, direction", "catalog")
cte("sets", """
SELECT *, 'raw' AS event_set FROM catalog UNION ALL SELECT c.*, 'declustered' FROM catalog c JOIN kept_type k ON k.market = c.market AND k.event_type = c.event_type AND k.pos = c.date_position
UNION ALL SELECT *, 'episode' FROM (SELECT * FROM catalog WHERE episode_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY market, event_type, episode_id ORDER BY date_position) = 1)
""")
register("ev2_event_sets", lambda s, d: ev.event_sets(catalog(s, d)), "market event_id event_set date_position:n", "sets")
cte("declustered", "SELECT c.* FROM catalog c JOIN kept_direction k ON k.market = c.market AND k.direction = c.direction AND k.pos = c.date_position QUALIFY row_number() OVER (PARTITION BY c.market, c.direction, date_position ORDER BY date, event_type) = 1")
register("ev2_decluster_by_direction", lambda s, d: ev.decluster_events(catalog(s, d), "declustered"), "market direction event_id date_position:n", "declustered")
register("ev3_prepare_benchmark", bench, "market benchmark trade_date open:f high:f low:f close:f", "bench")

cte("bench_pos", "SELECT *, row_number() OVER s - 1 AS pos, lead(trade_date) OVER s AS entry_date, lead(open) OVER s AS entry_open FROM bench WINDOW s AS (PARTITION BY market, benchmark ORDER BY trade_date)")
cte("horizons", f"SELECT unnest([{', '.join(map(str, H))}]) AS horizon")
cte("windows", """
SELECT b.market, b.benchmark, b.pos, h.horizon, f.pos AS fpos, f.high, f.low, f.close, max(f.high) OVER (PARTITION BY b.market, b.benchmark, b.pos, h.horizon ORDER BY f.pos) AS peak
FROM bench_pos b, horizons h JOIN bench_pos f ON f.market = b.market AND f.benchmark = b.benchmark AND f.pos BETWEEN b.pos + 1 AND b.pos + h.horizon
""")
cte("window_aggs", """
SELECT market, benchmark, pos, horizon, count(*) AS n, count(high) AS nh, count(low) AS nl, count(close) AS nc, max(high) AS high, min(low) AS low, arg_max(close, fpos) AS last_close, min(low / peak - 1) AS worst
FROM windows GROUP BY market, benchmark, pos, horizon
""")
cte("outcomes0", """
SELECT b.market, b.benchmark, b.trade_date, h.horizon, b.entry_date, CASE WHEN b.entry_date IS NOT NULL THEN b.entry_open END AS entry_price, CASE WHEN b.entry_date IS NOT NULL THEN b.close END AS signal_close_price,
  coalesce(a.n, 0) AS n, b.entry_open IS NOT NULL AND b.close IS NOT NULL AS priced, coalesce(a.n = h.horizon AND nh = n AND nl = n AND nc = n, false) AS complete, a.high, a.low, a.last_close, a.worst, b.close AS c0
FROM bench_pos b CROSS JOIN horizons h LEFT JOIN window_aggs a ON a.market = b.market AND a.benchmark = b.benchmark AND a.pos = b.pos AND a.horizon = h.horizon
""")
cte("status", f"""
SELECT market, benchmark, trade_date, CASE WHEN any_value(entry_date) IS NULL THEN 'TRUNCATED_HORIZON' WHEN NOT bool_and(priced) THEN 'MISSING_PRICE'
  ELSE coalesce(arg_min(CASE WHEN n < horizon THEN 'TRUNCATED_HORIZON' ELSE 'MISSING_PRICE' END, horizon) FILTER (WHERE n < horizon OR NOT complete), 'OK') END AS price_status
FROM outcomes0 GROUP BY market, benchmark, trade_date
""")
cte("outcomes", """
SELECT o.market, o.benchmark, o.trade_date, o.horizon, entry_date, entry_price, signal_close_price, price_status,
  CASE WHEN priced AND complete THEN last_close / entry_price - 1.0E0 END AS ret, CASE WHEN priced AND complete THEN last_close / c0 - 1.0E0 END AS close_ret,
  CASE WHEN priced AND complete THEN high / entry_price - 1.0E0 END AS mfe, CASE WHEN priced AND complete THEN low / entry_price - 1.0E0 END AS mae,
  CASE WHEN priced AND complete AND o.horizon IN (20, 60) THEN worst END AS ptdd
FROM outcomes0 o JOIN status USING (market, benchmark, trade_date)
""")


def outcomes(spark, d, raw=None):
    return ev.forward_outcomes(bench(spark, d, raw), H)


_KEY = "market benchmark trade_date horizon:n"
register("ev4_forward_outcomes", outcomes, _KEY + " entry_date entry_price:f ret:f close_ret:f mfe:f mae:f", "outcomes")
register("ev5_price_status", outcomes, _KEY + " price_status signal_close_price:f", "outcomes")
register("ev6_peak_to_trough", lambda s, d: outcomes(s, d).filter(F.col("horizon").isin(20, 60)), _KEY + " ptdd:f", "outcomes WHERE horizon IN (20, 60)")


def _attach_sql(name: str, events: str) -> None:
    cte(name, f"""
SELECT e.*, b.benchmark, h.horizon, o.entry_date, o.entry_price, o.signal_close_price, o.ret, o.close_ret, o.mfe, o.mae, o.ptdd, coalesce(o.price_status, 'MISSING_PRICE') AS price_status
FROM {events} e CROSS JOIN (SELECT unnest({list(B)}) AS benchmark) b CROSS JOIN horizons h LEFT JOIN outcomes o ON o.market = e.market AND o.benchmark = b.benchmark AND o.trade_date = e.date AND o.horizon = h.horizon
""")


_attach_sql("attached", "catalog")
_attach_sql("attached_sets", "sets")
_attach_sql("attached_rob", "rob_catalog")


def attached(spark, d):
    raw = td.stored_bars(spark, d)
    return ev.attach_outcomes(catalog(spark, d, raw), outcomes(spark, d, raw), B, H)


_WIDE = [f"{n}_{h}d" for h in (1, 20, 60) for n in ("return", "mfe", "future_drawdown")] + ["signal_close_forward_return_5d", "future_peak_to_trough_dd_20d", "future_peak_to_trough_dd_60d"]
cte("wide", "SELECT market, event_id, benchmark, date, entry_date, price_status, " + ", ".join(
    f"max({'ret' if c.startswith('return') else 'close_ret' if c.startswith('signal') else 'mfe' if c.startswith('mfe') else 'ptdd' if 'peak' in c else 'mae'}) FILTER (WHERE horizon = {c.rsplit('_', 1)[1][:-1]}) AS {c}" for c in _WIDE
) + " FROM attached GROUP BY market, event_id, benchmark, date, entry_date, price_status")
register("ev7_attach_outcomes", lambda s, d: ev.wide_outcomes(attached(s, d), H), "market event_id benchmark date entry_date price_status " + " ".join(f"{c}:f" for c in _WIDE), "wide")

cte("paths", f"""
SELECT e.market, e.event_type, e.event_id, b.benchmark, f.pos - b.pos AS observation, f.close / b.entry_open * 100.0E0 AS normalized_close
FROM catalog e JOIN bench_pos b ON b.market = e.market AND b.trade_date = e.date AND b.entry_open IS NOT NULL JOIN bench_pos f ON f.market = b.market AND f.benchmark = b.benchmark AND f.pos BETWEEN b.pos + 1 AND b.pos + 60
WHERE e.event_type IN {_CONF}
""")


def paths(spark, d):
    raw = td.stored_bars(spark, d)
    confirmed = catalog(spark, d, raw).filter(F.col("event_type").isin(*_CONF)).select("market", "event_type", "event_id", "date")
    return ev.future_paths(confirmed, bench(spark, d, raw), B)


register("ev8_future_path", paths, "market event_id benchmark observation:n normalized_close:f", "paths")
register("ev8_median_path", lambda s, d: ev.median_path(paths(s, d)), "market event_type benchmark observation:n n:n median_close:f", "(SELECT market, event_type, benchmark, observation, count(normalized_close) AS n, quantile_cont(normalized_close, 0.5) AS median_close FROM paths GROUP BY ALL)")

cte("confirm_dates", "SELECT market, 'panic' AS k, panic_episode_id AS id, min(trade_date) AS d FROM base_state WHERE signal = 'ICE_REVERSAL_CONFIRMED' GROUP BY ALL UNION ALL SELECT market, 'euphoria', euphoria_episode_id, min(trade_date) FROM base_state WHERE signal = 'HOT_ROLLOVER_CONFIRMED' GROUP BY ALL")
cte("masks", """
SELECT s.market, s.trade_date, s.quality <> 'INVALID' AND s.raw_temperature IS NOT NULL AS UNCONDITIONAL,
  s.valid AND s.recent_panic_episode AND s.panic_episode_id IS NOT NULL AND (p.d IS NULL OR s.trade_date < p.d) AS COLD_REGIME,
  s.valid AND s.recent_euphoria_episode AND s.euphoria_episode_id IS NOT NULL AND (e.d IS NULL OR s.trade_date < e.d) AS HOT_REGIME
FROM base_state s LEFT JOIN confirm_dates p ON p.market = s.market AND p.k = 'panic' AND p.id = s.panic_episode_id LEFT JOIN confirm_dates e ON e.market = s.market AND e.k = 'euphoria' AND e.id = s.euphoria_episode_id
""")
register("ev9_baseline_masks", lambda s, d: st.baseline_masks(states(s, d)), "market trade_date UNCONDITIONAL COLD_REGIME HOT_REGIME", "masks")
_STATS = ("count(ret) AS N, avg(ret) AS Mean, quantile_cont(ret, 0.5) AS Median, avg(CASE WHEN ret > 0 THEN 1.0E0 WHEN ret IS NOT NULL THEN 0.0E0 END) AS PositiveRate, avg(mae) AS MAEMean, quantile_cont(mae, 0.5) AS MAEMedian, "
          "avg(mfe) AS MFEMean, quantile_cont(mfe, 0.5) AS MFEMedian, avg(mae) AS FutureDrawdownMean, quantile_cont(mae, 0.5) AS FutureDrawdownMedian")
cte("baselines", " UNION ALL ".join(f"SELECT market, benchmark, horizon, '{b}' AS baseline_type, {_STATS} FROM (SELECT o.market, benchmark, horizon, CASE WHEN {b} THEN ret END AS ret, CASE WHEN {b} THEN mae END AS mae, CASE WHEN {b} THEN mfe END AS mfe FROM outcomes o JOIN masks m USING (market, trade_date)) GROUP BY ALL" for b in st.BASELINES))


def baselines(spark, d):
    raw = td.stored_bars(spark, d)
    return st.baseline_table(states(spark, d, raw), outcomes(spark, d, raw))


register("ev10_baseline_table", baselines, "market benchmark horizon:n baseline_type N:n Mean:f Median:f PositiveRate:f MAEMean:f MAEMedian:f MFEMean:f MFEMedian:f", "baselines")
_CELL = ["market", "event_type", "benchmark", "horizon"]
_U = f"((42 * 1000003 + CAST(s AS bigint) * 69621 + i * 48271 + 1) % {st.PRIME})"
_CI = "MeanCI95Low:f MeanCI95High:f MedianCI95Low:f MedianCI95High:f"


def _boot_sql(name: str, source: str, cell: str) -> str:
    """Percentile intervals of 10,000 samples of every cell of ``source``."""
    cte(f"{name}_cells", f"SELECT {cell}, list(ret ORDER BY ret) AS vals, count(*) AS n FROM {source} WHERE ret IS NOT NULL GROUP BY ALL")
    cte(f"{name}_draws", f"SELECT {cell}, list_transform(range(n), lambda i: vals[1 + ({_U} * {_U} % {st.PRIME} * 1103515245 + {_U} * 12345 + s) % {st.PRIME} % n]) AS x FROM {name}_cells, range(10000) t(s)")
    return cte(name, f"""
SELECT {cell}, quantile_cont(m, 0.025) AS MeanCI95Low, quantile_cont(m, 0.975) AS MeanCI95High, quantile_cont(d, 0.025) AS MedianCI95Low, quantile_cont(d, 0.975) AS MedianCI95High
FROM (SELECT {cell}, list_avg(x) AS m, list_aggregate(x, 'median') AS d FROM {name}_draws) GROUP BY ALL
""")


_boot_sql("boot_bounds", "attached", "market, event_type, benchmark, horizon")
register(
    "ev11_bootstrap_intervals", lambda s, d: st.bootstrap_intervals(hand_off(attached(s, d).select(*_CELL, "ret")), _CELL),
    f"market event_type benchmark horizon:n {_CI}", "boot_bounds",
)
_MORE = _STATS + ", stddev_samp(ret) AS StdDev, quantile_cont(ret, 0.25) AS P25, quantile_cont(ret, 0.75) AS P75, avg(ptdd) AS PeakToTroughDDMean, quantile_cont(ptdd, 0.5) AS PeakToTroughDDMedian"
cte("summaries", f"SELECT market, event_type, benchmark, horizon, {_MORE} FROM attached GROUP BY ALL")
_SUM = "N:n Mean:f Median:f StdDev:f PositiveRate:f P25:f P75:f MFEMean:f MFEMedian:f MAEMean:f MAEMedian:f PeakToTroughDDMean:f PeakToTroughDDMedian:f"
register("ev12_summarize_outcomes", lambda s, d: st.summarize(attached(s, d), _CELL), "market event_type benchmark horizon:n " + _SUM, "summaries")

cte("set_counts", "SELECT market, event_type, count(*) FILTER (WHERE event_set = 'raw') AS RawN, count(*) FILTER (WHERE event_set = 'declustered') AS DeclusteredN, count(*) FILTER (WHERE event_set = 'episode') AS EpisodeN FROM sets GROUP BY ALL")
cte("set_stats", f"SELECT market, event_type, event_set, benchmark, horizon, {_MORE} FROM attached_sets GROUP BY ALL")


def _study_sql(name: str, pairs) -> None:
    chosen = " OR ".join(f"(event_type = '{a}' AND event_set = '{b}')" for a, b in pairs)
    _boot_sql(f"{name}_boot", f"(SELECT * FROM attached_sets WHERE {chosen})", "market, event_type, event_set, benchmark, horizon")
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    cte(name, f"""
SELECT *, CASE WHEN N < 10 THEN 'VERY_LOW_SAMPLE' WHEN N < 20 THEN 'LOW_SAMPLE' ELSE 'MODERATE_SAMPLE' END AS SampleWarning,
  CASE WHEN N < 10 OR ExcessReturn IS NULL THEN 'INCONCLUSIVE' WHEN NOT CASE WHEN cold THEN ExcessReturn > 0 ELSE ExcessReturn < 0 END THEN 'NEGATIVE' WHEN (Mean >= 0) = (Median >= 0) AND (ExcessCI95Low > 0 OR ExcessCI95High < 0) THEN CASE WHEN N >= 20 THEN 'STRONG' ELSE 'MODERATE' END WHEN (Mean >= 0) = (Median >= 0) THEN 'WEAK' ELSE 'INCONCLUSIVE' END AS Evidence
FROM (SELECT m.market, g.event_type, g.event_set, b.benchmark, h.horizon, coalesce(s.N, 0) AS N, s.* EXCLUDE (market, event_type, event_set, benchmark, horizon, N), coalesce(c.RawN, 0) AS RawN, coalesce(c.DeclusteredN, 0) AS DeclusteredN,
    coalesce(c.EpisodeN, 0) AS EpisodeN, CASE g.event_set WHEN 'raw' THEN coalesce(c.RawN, 0) WHEN 'declustered' THEN coalesce(c.DeclusteredN, 0) ELSE coalesce(c.EpisodeN, 0) END AS EventCount,
    u.Mean AS BaselineMean, u.Median AS BaselineMedian, r.N AS RegimeBaselineN, r.Mean AS RegimeBaselineMean, r.Median AS RegimeBaselineMedian, r.FutureDrawdownMean AS RegimeBaselineFutureDrawdownMean,
    s.Mean - u.Mean AS ExcessReturn, k.MeanCI95Low, k.MeanCI95High, k.MedianCI95Low, k.MedianCI95High, k.MeanCI95Low - u.Mean AS ExcessCI95Low, k.MeanCI95High - u.Mean AS ExcessCI95High,
    starts_with(g.event_type, 'ICE') OR starts_with(g.event_type, 'PANIC') AS cold
  FROM (SELECT DISTINCT market FROM baselines) m CROSS JOIN (VALUES {values}) g(event_type, event_set) CROSS JOIN (SELECT unnest({list(B)}) AS benchmark) b CROSS JOIN horizons h
  LEFT JOIN set_stats s ON s.market = m.market AND s.event_type = g.event_type AND s.event_set = g.event_set AND s.benchmark = b.benchmark AND s.horizon = h.horizon
  LEFT JOIN {name}_boot k ON k.market = m.market AND k.event_type = g.event_type AND k.event_set = g.event_set AND k.benchmark = b.benchmark AND k.horizon = h.horizon
  LEFT JOIN set_counts c ON c.market = m.market AND c.event_type = g.event_type
  LEFT JOIN baselines u ON u.market = m.market AND u.benchmark = b.benchmark AND u.horizon = h.horizon AND u.baseline_type = 'UNCONDITIONAL'
  LEFT JOIN baselines r ON r.market = m.market AND r.benchmark = b.benchmark AND r.horizon = h.horizon AND r.baseline_type = CASE WHEN starts_with(g.event_type, 'ICE') OR starts_with(g.event_type, 'PANIC') THEN 'COLD_REGIME' ELSE 'HOT_REGIME' END)
""")


_study_sql("primary_study", st.PRIMARY)
_study_sql("comparator_study", st.COMPARATORS)


@dataclass(frozen=True)
class Stage:
    """Stage tables shared by the branches of one study."""

    daily: DataFrame
    states: DataFrame
    outcomes: DataFrame

    @property
    def catalog(self) -> DataFrame:
        return ev.event_catalog(self.states)

    def baselines(self) -> DataFrame:
        return st.baseline_table(self.states, self.outcomes)

    def study(self, pairs, baselines=None, sets=None, samples: int = 10_000) -> DataFrame:
        return st.study_table(ev.event_sets(self.catalog) if sets is None else sets, self.outcomes, self.baselines() if baselines is None else baselines, pairs, B, H, bootstrap_samples=samples)


def stage(spark, d) -> Stage:
    raw = td.stored_bars(spark, d)
    daily = hand_off(td.regime_daily(spark, d, raw))
    return Stage(daily, hand_off(build_states(daily)), hand_off(outcomes(spark, d, raw)))


def study(spark, d, pairs):
    s = stage(spark, d)
    return s.study(pairs, hand_off(s.baselines()), hand_off(ev.event_sets(s.catalog)))


_STUDY = "market event_type event_set benchmark horizon:n RawN:n DeclusteredN:n EpisodeN:n EventCount:n RegimeBaselineN:n RegimeBaselineMean:f BaselineMean:f BaselineMedian:f ExcessReturn:f ExcessCI95Low:f ExcessCI95High:f " + _CI + " " + _SUM
register("ev13_evidence_label", lambda s, d: study(s, d, st.PRIMARY), "market event_type event_set benchmark horizon:n N:n SampleWarning Evidence", "primary_study")
register("ev14_study_table", lambda s, d: study(s, d, st.PRIMARY), _STUDY, "primary_study")
register("ev15_comparator_table", lambda s, d: study(s, d, st.COMPARATORS), _STUDY, "comparator_study")
_values = ", ".join(f"('{a}', '{b}')" for a, b in st.PRIMARY)
cte("decluster_summary", f"""
SELECT m.market, g.event_type, g.event_set, count(s.event_id) AS event_count, min(s.date) AS first_event_date, max(s.date) AS last_event_date, count(DISTINCT s.episode_id) AS episode_count
FROM (SELECT DISTINCT market FROM sets) m CROSS JOIN (VALUES {_values}) g(event_type, event_set) LEFT JOIN sets s ON s.market = m.market AND s.event_type = g.event_type AND s.event_set = g.event_set GROUP BY ALL
""")
register("ev16_decluster_summary", lambda s, d: st.decluster_summary(hand_off(ev.event_sets(catalog(s, d)))), "market event_type event_set event_count:n first_event_date last_event_date episode_count:n", "decluster_summary")
_period = "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in PERIODS) + " END"
cte("split_stats", f"SELECT market, period, event_type, benchmark, horizon, {_MORE} FROM (SELECT *, {_period} AS period FROM attached WHERE event_type IN {_CONF}) WHERE period IS NOT NULL GROUP BY ALL")
_boot_sql("split_boot", f"(SELECT *, {_period} AS period FROM attached WHERE event_type IN {_CONF})", "market, period, event_type, benchmark, horizon")
cte("split_counts", f"SELECT market, {_period} AS period, event_type, count(*) AS event_count FROM catalog WHERE event_type IN {_CONF} GROUP BY ALL")
_pvalues = ", ".join(f"('{n}', '{s}')" for n, *_ in PERIODS for s in _CONF)
cte("time_split", f"""
SELECT m.market, g.period, g.event_type, b.benchmark, h.horizon, coalesce(c.event_count, 0) AS event_count, coalesce(s.N, 0) AS N, s.Mean, s.Median, s.PositiveRate, s.Mean - u.Mean AS ExcessReturn, u.Median AS BaselineMedian, k.MeanCI95Low, k.MeanCI95High, k.MedianCI95Low, k.MedianCI95High,
  CASE WHEN coalesce(s.N, 0) < 10 THEN 'DESCRIPTIVE_ONLY_LOW_SAMPLE' ELSE 'DESCRIPTIVE_SPLIT' END AS assessment
FROM (SELECT DISTINCT market FROM baselines) m CROSS JOIN (VALUES {_pvalues}) g(period, event_type) CROSS JOIN (SELECT unnest({list(B)}) AS benchmark) b CROSS JOIN horizons h
LEFT JOIN split_stats s ON s.market = m.market AND s.period = g.period AND s.event_type = g.event_type AND s.benchmark = b.benchmark AND s.horizon = h.horizon
LEFT JOIN split_boot k ON k.market = m.market AND k.period = g.period AND k.event_type = g.event_type AND k.benchmark = b.benchmark AND k.horizon = h.horizon
LEFT JOIN split_counts c ON c.market = m.market AND c.period = g.period AND c.event_type = g.event_type
LEFT JOIN baselines u ON u.market = m.market AND u.benchmark = b.benchmark AND u.horizon = h.horizon AND u.baseline_type = 'UNCONDITIONAL'
""")
def time_split(spark, d):
    s = stage(spark, d)
    return st.time_split(hand_off(s.catalog), s.outcomes, hand_off(s.baselines()), B, PERIODS, H)


register("ev17_time_split", time_split, "market period event_type benchmark horizon:n event_count:n N:n Mean:f Median:f PositiveRate:f ExcessReturn:f BaselineMedian:f " + _CI + " assessment", "time_split")


def robust_catalog(daily):
    return ev.event_catalog(build_states(daily, ROBUST), ["market", "variant_id"])


def robustness(spark, d, s=None, base=None, samples=10_000):
    s = s or stage(spark, d)
    base = hand_off(s.baselines()) if base is None else base
    return st.robustness_table(hand_off(robust_catalog(s.daily)), s.outcomes, base, ROBUST, B, DEFAULTS, H, bootstrap_samples=samples)


cte("rob_stats", f"SELECT market, variant_id, event_type, benchmark, horizon, {_STATS} FROM attached_rob WHERE event_type IN {_CONF} GROUP BY ALL")
_boot_sql("rob_boot", f"(SELECT * FROM attached_rob WHERE event_type IN {_CONF})", "market, variant_id, event_type, benchmark, horizon")
cte("rob_counts", f"SELECT market, variant_id, event_type, count(*) AS event_count FROM rob_catalog WHERE event_type IN {_CONF} GROUP BY ALL")
cte("rob_grid", f"""
SELECT m.market, v.variant_id, v.parameter, v.value, g.event_type, b.benchmark, h.horizon, coalesce(c.event_count, 0) AS event_count, coalesce(s.N, 0) AS N, s.Mean, s.Median, s.PositiveRate, s.Mean - u.Mean AS ExcessReturn, k.MeanCI95Low AS ci_low, k.MeanCI95High AS ci_high
FROM (SELECT DISTINCT market FROM baselines) m CROSS JOIN rob_variants v CROSS JOIN (SELECT unnest({list(_CONF)}) AS event_type) g CROSS JOIN (SELECT unnest({list(B)}) AS benchmark) b CROSS JOIN horizons h
LEFT JOIN rob_stats s ON s.market = m.market AND s.variant_id = v.variant_id AND s.event_type = g.event_type AND s.benchmark = b.benchmark AND s.horizon = h.horizon
LEFT JOIN rob_boot k ON k.market = m.market AND k.variant_id = v.variant_id AND k.event_type = g.event_type AND k.benchmark = b.benchmark AND k.horizon = h.horizon
LEFT JOIN rob_counts c ON c.market = m.market AND c.variant_id = v.variant_id AND c.event_type = g.event_type
LEFT JOIN baselines u ON u.market = m.market AND u.benchmark = b.benchmark AND u.horizon = h.horizon AND u.baseline_type = 'UNCONDITIONAL'
""")
_default = " OR ".join(f"(parameter = '{p}' AND value = {v})" for p, v in DEFAULTS.items())
cte("robustness", f"""
SELECT *, CASE WHEN same_direction_ratio < 2.0 / 3.0 THEN 'THRESHOLD_SENSITIVE' ELSE 'DIRECTION_STABLE' END AS parameter_sensitivity_warning
FROM (SELECT *, avg(CASE WHEN sign(coalesce(ExcessReturn, 0)) = sign(coalesce(nullif(base, 0), CASE WHEN starts_with(event_type, 'ICE') THEN 1 ELSE -1 END)) THEN 1.0E0 ELSE 0.0E0 END) OVER (PARTITION BY market, parameter, event_type, benchmark, horizon) AS same_direction_ratio
  FROM (SELECT *, max(CASE WHEN {_default} THEN ExcessReturn END) OVER (PARTITION BY market, parameter, event_type, benchmark, horizon) AS base FROM rob_grid))
""")
register("ev18_parameter_robustness", robustness, "market parameter value:f event_type benchmark horizon:n event_count:n N:n Mean:f Median:f PositiveRate:f ExcessReturn:f ci_low:f ci_high:f same_direction_ratio:f parameter_sensitivity_warning", "robustness")
cte("gate_main", """
SELECT market, event_type, bool_or(N >= 10) AS sample_ok, starts_with(event_type, 'ICE') AS up,
  coalesce(bool_or(N >= 10 AND CASE WHEN starts_with(event_type, 'ICE') THEN ExcessReturn > 0 ELSE ExcessReturn < 0 END), false)
    AND (starts_with(event_type, 'ICE') OR coalesce(bool_or(N >= 10 AND FutureDrawdownMean < RegimeBaselineFutureDrawdownMean), false)) AS effect_ok,
  coalesce(bool_and(CASE WHEN starts_with(event_type, 'ICE') THEN (Mean >= 0) = (Median >= 0) ELSE (Mean <= 0) = (Median <= 0) END) FILTER (WHERE N >= 10), false) AS direction_ok
FROM primary_study WHERE event_set = 'raw' AND horizon = 20 GROUP BY market, event_type
""")
cte("gate_comp", """
SELECT a.market, a.event_type, bool_or(coalesce(CASE WHEN starts_with(a.event_type, 'ICE') THEN a.Mean > b.Mean ELSE a.Mean < b.Mean END, false)) AS comparator_ok
FROM comparator_study a JOIN comparator_study b ON b.market = a.market AND b.benchmark = a.benchmark AND b.horizon = 20 AND b.event_set = 'raw'
  AND b.event_type = CASE a.event_type WHEN 'ICE_REVERSAL_CONFIRMED' THEN 'PANIC_EPISODE_START' ELSE 'EUPHORIA_EPISODE_START' END
WHERE a.horizon = 20 AND a.event_set = 'raw' AND a.event_type IN ('ICE_REVERSAL_CONFIRMED', 'HOT_ROLLOVER_CONFIRMED') GROUP BY a.market, a.event_type
""")
cte("gate_rob", "SELECT market, event_type, bool_or(same_direction_ratio >= 2.0 / 3.0) AS robustness_ok FROM robustness WHERE horizon = 20 GROUP BY market, event_type")


def _readiness_sql(name: str, persistence: str) -> None:
    cte(name, f"""
SELECT *, sample_ok AND effect_ok AND direction_ok AND persistence_ok AND robustness_ok AND comparator_ok AS ready,
  CASE WHEN sample_ok AND effect_ok AND direction_ok AND persistence_ok AND robustness_ok AND comparator_ok THEN 'ALL_DESCRIPTIVE_GATES_PASSED' ELSE
  concat_ws(',', CASE WHEN NOT sample_ok THEN 'SAMPLE_TOO_SMALL' END, CASE WHEN NOT effect_ok THEN 'NO_CLEAR_ECONOMIC_EFFECT' END, CASE WHEN NOT direction_ok THEN 'MEAN_MEDIAN_CONTRADICTION' END,
    CASE WHEN NOT persistence_ok THEN 'DECLUSTER_OR_EPISODE_NOT_STABLE' END, CASE WHEN NOT robustness_ok THEN 'NEIGHBORING_PARAMETER_SENSITIVE' END, CASE WHEN NOT comparator_ok THEN 'CONFIRMATION_ADDS_NO_CLEAR_VALUE' END) END AS reasons
FROM (SELECT m.*, {persistence} AS persistence_ok, r.robustness_ok, coalesce(c.comparator_ok, false) AS comparator_ok FROM gate_main m JOIN gate_rob r USING (market, event_type) LEFT JOIN gate_comp c USING (market, event_type))
""")


_readiness_sql("readiness", "false")
_readiness_sql("readiness_all", "coalesce((SELECT bool_or(k = 1 AND n = 3 AND s <> 0) FROM (SELECT benchmark, count(DISTINCT sign(ExcessReturn)) AS k, count(ExcessReturn) AS n, min(sign(ExcessReturn)) AS s FROM primary_study q WHERE q.market = m.market AND q.event_type = m.event_type AND q.horizon = 20 GROUP BY benchmark)), false)")


def readiness(spark, d, every=False):
    s = stage(spark, d)
    base, sets = hand_off(s.baselines()), hand_off(ev.event_sets(s.catalog))
    primary = s.study(st.PRIMARY, base, sets, 0)  # the gate reads no interval
    return st.readiness(hand_off(primary) if every else primary, s.study(st.COMPARATORS, base, sets, 0), robustness(spark, d, s, base, 0), persistence_from_all_sets=every)


_READY = "market event_type sample_ok effect_ok direction_ok persistence_ok robustness_ok comparator_ok ready reasons"
register("ev19_readiness_gate", readiness, _READY, "readiness")
register("ev19_readiness_all_sets", lambda s, d: readiness(s, d, True), _READY, "readiness_all")
for _name, _column in (("yearly", "state"), ("yearly_signal", "signal")):
    cte(_name, f"SELECT *, n / CAST(sum(n) OVER (PARTITION BY market, yr) AS double) AS percentage FROM (SELECT market, year(trade_date) AS yr, {_column} AS label, count(*) AS n FROM base_state GROUP BY ALL)")
register("ev20_yearly_state_counts", lambda s, d: st.yearly_counts(states(s, d), "state").withColumnRenamed("year", "yr"), "market yr:n label n:n percentage:f", "yearly")
register("ev20_yearly_signal_counts", lambda s, d: st.yearly_counts(states(s, d), "signal").withColumnRenamed("year", "yr"), "market yr:n label n:n percentage:f", "yearly_signal")
cte("month_slice", "SELECT market, benchmark, horizon, count(ret) AS N, avg(ret) AS Mean, quantile_cont(ret, 0.5) AS Median FROM attached WHERE event_type = 'ICE_REVERSAL_CONFIRMED' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND horizon IN (1, 5, 20, 60) GROUP BY ALL")
register("ev21_case_study_slice", lambda s, d: st.month_slice(attached(s, d), "1998-01-01", "1998-12-31"), "market benchmark horizon:n N:n Mean:f Median:f", "month_slice")
cte("tally", "SELECT count(DISTINCT benchmark) AS benchmarks, count(DISTINCT horizon) AS horizons_n, count(DISTINCT event_type) AS primary_signal_types, count(DISTINCT row(parameter, value)) AS robustness_parameter_values, count(*) FILTER (WHERE parameter_sensitivity_warning = 'THRESHOLD_SENSITIVE') AS threshold_sensitive_cells FROM robustness")
register("ev22_multiple_testing_tally", lambda s, d: st.testing_tally(robustness(s, d)).withColumnRenamed("horizons", "horizons_n"), "benchmarks:n horizons_n:n primary_signal_types:n robustness_parameter_values:n threshold_sensitive_cells:n", "tally")
cte("self_checks", "SELECT a.market, bool_and(coalesce(entry_date > date, true)) AS entry_after_signal_close, bool_and(price_status <> 'INTERPOLATED') AS no_price_interpolation, (SELECT bool_and(signal = 'NONE' AND smoothed_temperature IS NULL) FROM base_state s WHERE s.market = a.market AND state = 'DATA_INVALID') AS invalid_date_state_reset FROM attached a GROUP BY a.market")
def self_checks(spark, d):
    s = stage(spark, d)
    return st.self_checks(s.states, ev.attach_outcomes(s.catalog, s.outcomes, B, H))


register("dq14_event_self_checks", self_checks, "market entry_after_signal_close no_price_interpolation invalid_date_state_reset", "self_checks")

_EVENT_CELLS = ["original_signal", "direction", "episode_id", "raw_temperature", "state"]


def event_stability(spark, d):
    """Events of a run that ends at SPLIT against those of the whole run: none may be missing or differ."""
    daily = hand_off(td.regime_daily(spark, d))
    prefix = build_states(daily.filter(F.col("trade_date") < F.lit(SPLIT).cast("date")))
    return changed_cells(ev.event_catalog(build_states(daily)), ev.event_catalog(prefix), ["market", "event_type", "date"], _EVENT_CELLS)


register("dq13_event_no_lookahead", event_stability, "prefix_rows:n missing_rows:n " + " ".join(f"changed_{c}:n" for c in _EVENT_CELLS),
         "(SELECT count(*) AS prefix_rows, 0 AS missing_rows, " + ", ".join(f"0 AS changed_{c}" for c in _EVENT_CELLS) + f" FROM catalog WHERE date < DATE '{SPLIT}')")
