"""Regime, state-machine and diagnostic queries (RG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.regime import regime_indicators
from ..operators.state_machine import build_states
from ..operators.zones import add_zones
from ..sources import testdata as td
from ..sources.tables import hand_off
from . import regime_sql  # noqa: F401
from .base import cte, register


def indicators(spark, d):
    return regime_indicators(td.regime_daily(spark, d))


def states(spark, d, raw=None):
    return build_states(td.regime_daily(spark, d, raw))


def state_table(spark, d):
    """The state table as a stage boundary, for reports that read it more than once."""
    return hand_off(states(spark, d))


register("rg1_valid_observations", lambda s, d: indicators(s, d).withColumnRenamed("regime_valid_observation", "valid"), "market trade_date valid raw_temperature:f quality confidence", "base_ind")
register("rg2_causal_ema", indicators, "market trade_date smoothed_temperature:f", "base_ind")
register("rg3_valid_lag", indicators, "market trade_date slope1:f slope3:f", "base_ind")
register("rg4_valid_extremes", indicators, "market trade_date rolling_high_10:f rolling_low_10:f", "base_ind")
register("rg5_smoothing_metrics", indicators, "market trade_date temperature_shock:f recovery_from_low:f drop_from_high:f", "base_ind")
register("rg6_module_deltas", indicators, "market trade_date breadth_delta3:f profit_effect_delta3:f liquidity_delta3:f stretch_delta3:f improving_modules:n deteriorating_modules:n", "base_ind")
register(
    "rg7_anchor_flags", indicators,
    "market trade_date panic_module_count:n euphoria_module_count:n raw_panic_anchor smoothed_panic_anchor raw_euphoria_anchor smoothed_euphoria_anchor panic_anchor_event euphoria_anchor_event", "base_ind",
)
register(
    "rg8_state_machine", states,
    "market trade_date previous_state state signal watch_streak:n confirmation_streak:n watch_timeout watch_invalidated state_changed warnings "
    "panic_episode_id:n panic_episode_age:n post_panic_low:f recovery_from_post_panic_low:f recent_panic_episode panic_episode_closed "
    "euphoria_episode_id:n euphoria_episode_age:n post_euphoria_high:f drop_from_post_euphoria_high:f recent_euphoria_episode euphoria_episode_closed", "base_state",
)
register("rg9_zone_hysteresis", states, "market trade_date zone_state", "base_state")
register("rg9_zone_scan", lambda s, d: add_zones(indicators(s, d)), "market trade_date zone_state", "base_state")
register("rg10_state_duration", states, "market trade_date state state_duration:n", "base_state")

from ..operators import regime_reports as rr  # noqa: E402
from ..operators.quality import changed_cells  # noqa: E402
from ..operators.state_machine import STATES  # noqa: E402
from ..params import LEGACY_SENSITIVITY_GRID, SENSITIVITY_GRID, Variant, grid  # noqa: E402
from .regime_sql import regime_ctes  # noqa: E402

SENSITIVITY = [Variant(), *grid(SENSITIVITY_GRID)]
LEGACY_SENSITIVITY = [Variant(), *grid(LEGACY_SENSITIVITY_GRID)]
regime_ctes("sens", SENSITIVITY)
regime_ctes("old", LEGACY_SENSITIVITY)
_STATES = ", ".join(f"'{s}'" for s in STATES)
_WATCH = "('ICE_REVERSAL_WATCH', 'HOT_ROLLOVER_WATCH')"
_CONF = "('ICE_REVERSAL_CONFIRMED', 'HOT_ROLLOVER_CONFIRMED')"

cte("transitions", f"""
SELECT m.market, a.previous_state, b.state, count(s.market) AS transitions FROM (SELECT DISTINCT market FROM base_state) m, (SELECT unnest([{_STATES}, 'NONE']) AS previous_state) a, (SELECT unnest([{_STATES}]) AS state) b
LEFT JOIN base_state s ON s.market = m.market AND s.previous_state = a.previous_state AND s.state = b.state GROUP BY m.market, a.previous_state, b.state
""")
register("rg11_transition_matrix", lambda s, d: rr.transition_matrix(state_table(s, d)), "market previous_state state transitions:n", "transitions")
cte("runs", 'SELECT market, run_id AS run, state, count(*) AS duration, min(trade_date) AS "start", max(trade_date) AS "end" FROM base_state GROUP BY market, run_id, state')
register("rg12_runs", lambda s, d: rr.runs(states(s, d)).withColumnsRenamed({"start": "first_day", "end": "last_day"}), "market run:n state duration:n first_day last_day", '(SELECT *, "start" AS first_day, "end" AS last_day FROM runs)')
cte("state_stats", f"""
SELECT m.market, b.state, coalesce(sum(duration), 0) AS "count", coalesce(sum(duration), 0) / CAST(any_value(m.total) AS double) AS percentage, count(r.market) AS number_of_episodes,
  coalesce(quantile_cont(duration, 0.5), 0) AS median_duration, coalesce(max(duration), 0) AS max_duration
FROM (SELECT market, count(*) AS total FROM base_state GROUP BY market) m, (SELECT unnest([{_STATES}]) AS state) b LEFT JOIN runs r ON r.market = m.market AND r.state = b.state GROUP BY m.market, b.state
""")
register("rg13_state_statistics", lambda s, d: rr.state_statistics(state_table(s, d)).withColumnRenamed("count", "days"), "market state days:n percentage:f number_of_episodes:n median_duration:f max_duration:n", '(SELECT *, "count" AS days FROM state_stats)')


def _signal_cte(name: str, edge_on: str, first_counts: bool) -> None:
    cte(name + "0", f"""
SELECT market, count(*) FILTER (WHERE w AND NOT coalesce(pw, {str(not first_counts).lower()})) AS w, count(*) FILTER (WHERE signal IN {_CONF}) AS c, count(*) FILTER (WHERE watch_timeout) AS t,
  count(*) FILTER (WHERE signal = 'ICE_REVERSAL_WATCH') AS n0, count(*) FILTER (WHERE signal = 'ICE_REVERSAL_CONFIRMED') AS n1,
  count(*) FILTER (WHERE signal = 'HOT_ROLLOVER_WATCH') AS n2, count(*) FILTER (WHERE signal = 'HOT_ROLLOVER_CONFIRMED') AS n3
FROM (SELECT *, {edge_on} IN {_WATCH} AS w, lag({edge_on} IN {_WATCH}) OVER (PARTITION BY market ORDER BY trade_date) AS pw FROM base_state) GROUP BY market
""")
    rows = [("ICE_REVERSAL_WATCH_count", "n0", "NULL"), ("ICE_REVERSAL_confirmed_count", "n1", "NULL"), ("HOT_ROLLOVER_WATCH_count", "n2", "NULL"), ("HOT_ROLLOVER_confirmed_count", "n3", "NULL"), ("watch_episodes", "w", "NULL"),
            ("confirmed_episodes", "c", "NULL"), ("watch_to_confirm_rate", "c", "c / CAST(greatest(w, 1) AS double)"), ("watch_timeout_count", "t", "NULL"), ("watch_timeout_rate", "t", "t / CAST(greatest(w, 1) AS double)")]
    cte(name, " UNION ALL ".join(f"SELECT market, '{m}' AS metric, {c} AS cnt, CAST({r} AS double) AS rate FROM {name}0" for m, c, r in rows))


_signal_cte("signal_stats", "signal", True)
_signal_cte("signal_stats_legacy", "state", False)
register("rg14_signal_statistics", lambda s, d: rr.signal_statistics(states(s, d)).withColumnRenamed("count", "cnt"), "market metric cnt:n rate:f", "signal_stats")
register("rg14_signal_statistics_by_state", lambda s, d: rr.signal_statistics(states(s, d), by_state=True).withColumnRenamed("count", "cnt"), "market metric cnt:n rate:f", "signal_stats_legacy")

cte("episodes", " UNION ALL ".join(f"""
SELECT market, '{k}' AS episode_type, {k}_episode_id AS episode_id, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS duration_valid_observations, max({k}_episode_age) AS max_age,
  string_agg(strftime(trade_date, '%Y-%m-%d'), ',' ORDER BY trade_date) FILTER (WHERE {k}_anchor_event) AS anchor_dates, max({k}_module_count) AS max_extreme_module_count,
  (SELECT string_agg(state, ',' ORDER BY f) FROM (SELECT state, min(trade_date) AS f FROM base_state i WHERE i.market = o.market AND i.{k}_episode_id = o.{k}_episode_id GROUP BY state)) AS states_seen,
  min(trade_date) FILTER (WHERE signal IN {_CONF}) AS confirmed_date
FROM base_state o WHERE {k}_episode_id IS NOT NULL GROUP BY market, {k}_episode_id""" for k in ("panic", "euphoria")))
register("rg15_episode_table", lambda s, d: rr.episode_table(state_table(s, d)), "market episode_type episode_id:n start_date end_date duration_valid_observations:n max_age:n anchor_dates max_extreme_module_count:n states_seen confirmed_date", "episodes")
cte("episode_freq0", f"""
SELECT market, year(trade_date) AS "year", count(DISTINCT panic_episode_id) AS p, count(DISTINCT euphoria_episode_id) AS e, count(*) FILTER (WHERE signal = 'ICE_REVERSAL_CONFIRMED') AS i, count(*) FILTER (WHERE signal = 'HOT_ROLLOVER_CONFIRMED') AS h
FROM base_state GROUP BY market, year(trade_date)
""")
cte("episode_freq", " UNION ALL ".join(f"SELECT market, \"year\" AS yr, '{m}' AS metric, {c} AS cnt FROM episode_freq0" for m, c in (("panic_episode_count", "p"), ("euphoria_episode_count", "e"), ("ice_reversal_confirmed_count", "i"), ("hot_rollover_confirmed_count", "h"))))
register("rg16_episode_frequency", lambda s, d: rr.episode_frequency(states(s, d)).withColumnsRenamed({"count": "cnt", "year": "yr"}), "market yr:n metric cnt:n", "episode_freq")

cte("neighbours", "SELECT *, lag(state) OVER w AS b, lag(state, 2) OVER w AS b2, lead(state) OVER w AS a FROM base_state WINDOW w AS (PARTITION BY market ORDER BY trade_date)")
_FAM = "'ICE_REVERSAL', 'HOT_ROLLOVER'"


def _unpivot(source: str, rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT market, '{m}' AS metric, {expr} AS cnt FROM {src or source} GROUP BY market" for m, expr, src in ((r + ("",))[:3] for r in rows))


cte("whipsaw", _unpivot("neighbours", [
    ("state_changes", "count(*) FILTER (WHERE state IS DISTINCT FROM b)"), ("state_changes_within_1_day", "count(*) FILTER (WHERE duration <= 1)", "runs"), ("state_changes_within_2_day", "count(*) FILTER (WHERE duration <= 2)", "runs"),
    ("HOT_NORMAL_transitions", "count(*) FILTER (WHERE (state = 'HOT' AND b = 'NORMAL') OR (state = 'NORMAL' AND b = 'HOT'))"), ("COLD_NORMAL_transitions", "count(*) FILTER (WHERE (state = 'COLD' AND b = 'NORMAL') OR (state = 'NORMAL' AND b = 'COLD'))"),
    *[(f"{w}_watch_exits", f"count(*) FILTER (WHERE state = '{w}' AND (a IS NULL OR a NOT IN ('{w}', {_FAM})))") for w in ("ICE_REVERSAL_WATCH", "HOT_ROLLOVER_WATCH")],
]))
cte("whipsaw_legacy", _unpivot("neighbours", [
    ("state_changes_within_1_day", "count(*) FILTER (WHERE duration <= 1)", "runs"), ("state_changes_within_2_day", "count(*) FILTER (WHERE duration <= 2)", "runs"),
    *[(f"{x}_to_NORMAL_or_back", f"count(*) FILTER (WHERE (state = '{x}' AND a = 'NORMAL') OR (state = 'NORMAL' AND a = '{x}'))") for x in ("HOT", "COLD")],
    *[(f"{w}_to_NONE_or_back", f"count(*) FILTER (WHERE state = '{w}' AND a NOT IN ('{w}', {_FAM}))") for w in ("ICE_REVERSAL_WATCH", "HOT_ROLLOVER_WATCH")],
]))
_PAIRS = (("HOT", "NORMAL"), ("NORMAL", "HOT"), ("COLD", "NORMAL"), ("NORMAL", "COLD"), ("ICE_REVERSAL_WATCH", "NONE"), ("HOT_ROLLOVER_WATCH", "NONE"))
cte("whipsaw_lags", "SELECT *, CASE WHEN starts_with(metric, 'pair:') THEN 'DESCRIPTIVE' WHEN cnt > 20 THEN 'Review for possible hysteresis layer' ELSE 'NO_SEVERE_WHIPSAW_FLAG' END AS warning FROM (" + _unpivot("neighbours", [
    ("1", "count(*) FILTER (WHERE state <> 'DATA_INVALID' AND b <> 'DATA_INVALID' AND state <> b)"), ("2", "count(*) FILTER (WHERE state <> 'DATA_INVALID' AND b2 <> 'DATA_INVALID' AND state <> b2)"),
    *[(f"pair:{a}->{b}", f"count(*) FILTER (WHERE previous_state = '{a}' AND state = '{b}')") for a, b in _PAIRS],
]) + ")")
register("rg17_whipsaw", lambda s, d: rr.whipsaw(states(s, d)).withColumnRenamed("count", "cnt"), "market metric cnt:n", "whipsaw")
register("rg17_whipsaw_legacy", lambda s, d: rr.whipsaw_legacy(states(s, d)).withColumnRenamed("count", "cnt"), "market metric cnt:n", "whipsaw_legacy")
register("rg17_whipsaw_lags", lambda s, d: rr.whipsaw_lags(states(s, d)).withColumnRenamed("count", "cnt"), "market metric cnt:n warning", "whipsaw_lags")


def _sensitivity_cte(name: str, p: str) -> None:
    cte(f"{name}_dates", f"SELECT market, variant_id, trade_date FROM {p}_state WHERE signal IN {_CONF}")
    cte(f"{name}_counts", f"""
SELECT market, variant_id, count(DISTINCT panic_episode_id) AS panic_episode_count, count(DISTINCT euphoria_episode_id) AS euphoria_episode_count,
  count(*) FILTER (WHERE signal = 'ICE_REVERSAL_WATCH') AS ice_watch_count, count(*) FILTER (WHERE signal = 'ICE_REVERSAL_CONFIRMED') AS ice_confirmed_count,
  count(*) FILTER (WHERE signal = 'HOT_ROLLOVER_WATCH') AS hot_watch_count, count(*) FILTER (WHERE signal = 'HOT_ROLLOVER_CONFIRMED') AS hot_confirmed_count,
  count(DISTINCT run_id) AS state_changes, count(*) FILTER (WHERE signal IN {_CONF}) AS c, greatest(count(*) FILTER (WHERE signal IN {_WATCH}), 1) AS w,
  coalesce(string_agg(strftime(trade_date, '%Y-%m-%d'), ',' ORDER BY trade_date) FILTER (WHERE signal IN {_CONF}), '') AS confirmed_dates
FROM {p}_state GROUP BY market, variant_id
""")
    cte(f"{name}", f"""
SELECT k.*, d.average_state_duration, k.c / CAST(k.w AS double) AS watch_to_confirm_rate, CASE WHEN u > 0 THEN both_n / CAST(u AS double) ELSE 1.0E0 END AS confirmed_date_stability,
  CASE WHEN u > 0 AND both_n / CAST(u AS double) < 0.80 THEN 'THRESHOLD_SENSITIVE' ELSE 'STABLE_NEARBY' END AS sensitivity_flag
FROM (SELECT c.*, both_n, c.c + nb - both_n AS u FROM (SELECT c.*, (SELECT count(*) FROM {name}_dates a JOIN {name}_dates b USING (market, trade_date) WHERE a.market = c.market AND a.variant_id = c.variant_id AND b.variant_id = 'default') AS both_n,
        (SELECT count(*) FROM {name}_dates b WHERE b.market = c.market AND b.variant_id = 'default') AS nb FROM {name}_counts c) c) k
JOIN (SELECT market, variant_id, avg(m) AS average_state_duration FROM (SELECT market, variant_id, state, avg(state_duration) AS m FROM {p}_state GROUP BY market, variant_id, state) GROUP BY market, variant_id) d USING (market, variant_id)
""")


_sensitivity_cte("sens_report", "sens")
_sensitivity_cte("old_report", "old")
_SENS = "market variant_id panic_episode_count:n euphoria_episode_count:n ice_watch_count:n ice_confirmed_count:n hot_watch_count:n hot_confirmed_count:n state_changes:n average_state_duration:f watch_to_confirm_rate:f confirmed_date_stability:f sensitivity_flag confirmed_dates"
register("rg18_sensitivity_grid", lambda s, d: rr.sensitivity(build_states(td.regime_daily(s, d), SENSITIVITY)), _SENS, "sens_report")
register("rg18_sensitivity_grid_thresholds", lambda s, d: rr.sensitivity(build_states(td.regime_daily(s, d), LEGACY_SENSITIVITY)), _SENS, "old_report")

cte("placed", "SELECT *, row_number() OVER (PARTITION BY market ORDER BY trade_date) AS position FROM base_state")
cte("extreme_picks", """
SELECT market, 'hottest' AS kind, trade_date AS event_date, position AS at, row_number() OVER (PARTITION BY market ORDER BY smoothed_temperature DESC, trade_date) AS rank FROM placed WHERE smoothed_temperature IS NOT NULL
UNION ALL SELECT market, 'coldest', trade_date, position, row_number() OVER (PARTITION BY market ORDER BY smoothed_temperature, trade_date) FROM placed WHERE smoothed_temperature IS NOT NULL
""")
cte("extreme_rows", "SELECT e.market, e.kind, e.rank, e.event_date, p.position - e.at AS \"offset\", p.trade_date, p.smoothed_temperature, p.state, p.signal FROM extreme_picks e JOIN placed p ON p.market = e.market AND p.position BETWEEN e.at - 5 AND e.at + 5 WHERE e.rank <= 10")
register("rg19_extreme_audit", lambda s, d: rr.extremes(state_table(s, d)).withColumnRenamed("offset", "shift"), "market kind rank:n event_date shift:n trade_date smoothed_temperature:f state signal", '(SELECT *, "offset" AS shift FROM extreme_rows)')
_RANKED = "SELECT *, '{0}' AS kind, row_number() OVER (PARTITION BY market ORDER BY smoothed_temperature {1}, trade_date) AS rank FROM base_state WHERE smoothed_temperature IS NOT NULL AND state <> 'DATA_INVALID'"
register("rg19_top_days", lambda s, d: rr.top_days(state_table(s, d)), "market kind rank:n trade_date smoothed_temperature:f state signal", f"(SELECT * FROM ({_RANKED.format('hottest', 'DESC')} UNION ALL {_RANKED.format('coldest', 'ASC')}) WHERE rank <= 10)")
AUDIT = ("1996-06-30", "1998-10-01", "2000-03-15")
cte("audit_hits", f"""
SELECT market, episode_type, episode_id, min(target) AS target FROM (SELECT e.*, t.target FROM episodes e, (SELECT unnest([{', '.join(f"DATE '{t}'" for t in AUDIT)}]) AS target) t
  QUALIFY row_number() OVER (PARTITION BY e.market, e.episode_type, t.target ORDER BY abs(e.start_date - t.target), e.episode_id) = 1) GROUP BY market, episode_type, episode_id
""")
cte("audit", "SELECT e.*, h.target, row_number() OVER (PARTITION BY e.market, e.episode_type ORDER BY h.target IS NULL, e.start_date, e.episode_id) AS pick FROM episodes e LEFT JOIN audit_hits h USING (market, episode_type, episode_id) QUALIFY h.target IS NOT NULL OR pick <= 5")
register("rg20_historical_audit", lambda s, d: rr.episode_audit(rr.episode_table(state_table(s, d)), AUDIT), "market episode_type episode_id:n start_date target pick:n", "audit")

CAUSAL = ["smoothed_temperature", "temperature_shock", "slope1", "slope3", "rolling_high_10", "rolling_low_10", "recovery_from_low", "drop_from_high", "panic_episode_id", "euphoria_episode_id", "post_panic_low", "post_euphoria_high", "state", "signal"]
SPLIT = "2000-01-01"


def no_lookahead(spark, d):
    daily = td.regime_daily(spark, d)
    return changed_cells(build_states(daily), build_states(daily.filter(F.col("trade_date") < F.lit(SPLIT).cast("date"))), ["market", "variant_id", "trade_date"], CAUSAL)


# A causal engine changes no cell, so the check expects zeros over the prefix's row count.
register("dq13_no_lookahead_check", no_lookahead, "prefix_rows:n missing_rows:n " + " ".join(f"changed_{c}:n" for c in CAUSAL),
         "(SELECT count(*) AS prefix_rows, 0 AS missing_rows, " + ", ".join(f"0 AS changed_{c}" for c in CAUSAL) + f" FROM base_state WHERE trade_date < DATE '{SPLIT}')")
