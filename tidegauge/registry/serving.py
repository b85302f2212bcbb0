"""Serving queries (SV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serving as sv
from ..operators.quality import market_coverage_daily
from ..operators.state_machine import build_states
from ..operators.advisory import advisory_frame
from ..sources import testdata as td
from ..sources.tables import hand_off
from .advisory import _q, advisory
from .base import cte, register
from .regime import state_table, states

register("sv1_latest_valid_date", lambda s, d: sv.date_bounds(advisory(s, d)), "market latest_valid_date first_date last_date available_dates:n",
         "(SELECT market, max(date) FILTER (WHERE advisory_signal <> 'DATA_INVALID') AS latest_valid_date, min(date) AS first_date, max(date) AS last_date, count(*) AS available_dates FROM advisory GROUP BY market)")
TARGETS = ("1990-01-01", "1998-05-20", "2000-01-03", "2010-01-01")
cte("resolved", " UNION ALL ".join(f"""
SELECT market, DATE '{t}' AS target, coalesce(max(date) FILTER (WHERE date <= DATE '{t}'), min(date)) AS as_of, coalesce(max(date) FILTER (WHERE date < DATE '{t}'), min(date)) AS previous, coalesce(min(date) FILTER (WHERE date > DATE '{t}'), max(date)) AS following
FROM advisory GROUP BY market""" for t in TARGETS))
register("sv2_resolve_date", lambda s, d: sv.resolve_dates(advisory(s, d), TARGETS), "market target as_of previous following", "resolved")


def _case(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in labels.items()) + " END"


_titles = "concat_ws(';', " + ", ".join(f"CASE WHEN list_contains(string_split(reason_codes, ';'), '{c}') THEN {_q(t[0])} END" for c, t in sorted(sv.WARNING_MEANINGS.items(), key=lambda kv: ["DATA_INVALID", "SURVIVORSHIP_BIAS_WARNING", "OPTIONS_UNAVAILABLE"].index(kv[0]) if kv[0] in ("DATA_INVALID", "SURVIVORSHIP_BIAS_WARNING", "OPTIONS_UNAVAILABLE") else 9)) + ")"
_text = lambda c: f"coalesce(printf('%.1f', {c}), '—')"
cte("cards", f"""
SELECT market, trade_date, {_case('state', sv.STATE_LABELS)} AS state_label, {_case('advisory_signal', sv.SIGNAL_LABELS)} AS advisory_label, {_text('market_temperature')} AS temperature_text, {_text('smoothed_temperature')} AS smoothed_text,
  CASE WHEN state = 'DATA_INVALID' THEN '—' ELSE buy_reference END AS buy_reference, CASE WHEN state = 'DATA_INVALID' THEN '—' ELSE sell_reference END AS sell_reference, {_case('risk_level', sv.RISK_LABELS)} AS risk_label, {_case('expected_horizon', sv.HORIZON_LABELS)} AS horizon_label,
  CASE WHEN state = 'DATA_INVALID' THEN '—' ELSE reference_horizon END AS reference_horizon, {_case('signal_confidence', sv.CONFIDENCE_LABELS)} AS confidence_label, {_case('research_evidence', sv.EVIDENCE_LABELS)} AS evidence_label,
  CASE WHEN state = 'DATA_INVALID' THEN {_q(sv.NO_WATCH)} ELSE what_to_watch_next END AS what_to_watch_next, {_titles} AS warning_titles, list_contains(string_split(reason_codes, ';'), 'DATA_INVALID') AS blocking,
  {', '.join(f"{_text(m + '_score')} AS {m}_text" for m in ('breadth', 'profit_effect', 'liquidity', 'stretch'))}, state = 'DATA_INVALID' AS data_invalid
FROM advisory
""")
def daily_cards(spark, d):
    table = state_table(spark, d)
    return sv.daily_cards(advisory_frame(table), table)


register("sv3_daily_card", daily_cards,
         "market trade_date state_label advisory_label temperature_text smoothed_text buy_reference sell_reference risk_label horizon_label reference_horizon confidence_label evidence_label what_to_watch_next warning_titles blocking breadth_text profit_effect_text liquidity_text stretch_text data_invalid", "cards")
cte("trend_1y", "SELECT * FROM advisory a WHERE date >= (SELECT max(date) FROM advisory b WHERE b.market = a.market) - 366")
_POINT = "market date market_temperature:f smoothed_temperature:f advisory_signal"
register("sv4_trend_range", lambda s, d: sv.trend(advisory(s, d), "1Y"), _POINT, "trend_1y")
for _range, _days in (("3M", 92), ("6M", 183), ("All", 100_000)):
    register(f"sv4_trend_{_range.lower()}", lambda s, d, r=_range: sv.trend(advisory(s, d), r), _POINT, f"(SELECT * FROM advisory a WHERE date >= (SELECT max(date) FROM advisory b WHERE b.market = a.market) - {_days})")
register("sv4_last_rows", lambda s, d: sv.last_rows(sv.trend(advisory(s, d), "1Y")), _POINT, "(SELECT * FROM trend_1y QUALIFY row_number() OVER (PARTITION BY market ORDER BY date DESC) <= 40)")
cte("episode_cards", " UNION ALL ".join(f"""
SELECT o.market, '{t}' AS episode_type, {k}_episode_id AS episode_id, min(trade_date) AS start_date, {'arg_min' if k == 'panic' else 'arg_max'}(trade_date, smoothed_temperature ORDER BY trade_date) AS extreme_date, {'min' if k == 'panic' else 'max'}(smoothed_temperature) AS extreme_value,
  min(trade_date) FILTER (WHERE state = '{w}') AS watch_date, min(trade_date) FILTER (WHERE state = '{c}') AS confirmed_date, min(trade_date) FILTER (WHERE {k}_episode_closed) AS end_date,
  CASE WHEN bool_or({k}_episode_closed) THEN '{sv.EPISODE_CLOSED}' ELSE '{sv.EPISODE_OPEN}' END AS status, printf('%.1f', {'min' if k == 'panic' else 'max'}(smoothed_temperature)) AS extreme_text,
  (SELECT string_agg(state, ',' ORDER BY f) FROM (SELECT state, min(trade_date) AS f FROM base_state i WHERE i.market = o.market AND i.{k}_episode_id = o.{k}_episode_id GROUP BY state)) AS state_sequence
FROM base_state o WHERE {k}_episode_id IS NOT NULL GROUP BY o.market, {k}_episode_id""" for k, t, w, c in (("panic", "Panic", "ICE_REVERSAL_WATCH", "ICE_REVERSAL"), ("euphoria", "Euphoria", "HOT_ROLLOVER_WATCH", "HOT_ROLLOVER"))))
register("sv5_episode_cards", lambda s, d: sv.episode_cards(state_table(s, d)), "market episode_type episode_id:n start_date extreme_date extreme_value:f watch_date confirmed_date end_date status extreme_text state_sequence", "episode_cards")
cte("last_state", "SELECT s.market, s.quality AS status, s.trade_date AS latest_calculated_date, r.observed_universe AS universe FROM base_state s JOIN regime_daily r USING (market, trade_date) QUALIFY row_number() OVER (PARTITION BY s.market ORDER BY s.trade_date DESC) = 1")
cte("diagnostics", f"""
SELECT l.*, v.latest_valid_date, v.row_count, coalesce(printf('%.1f', c.coverage_ratio * 100) || '%', '—') AS coverage_text, k.warning_titles AS warning_labels
FROM last_state l JOIN (SELECT market, count(*) AS row_count, max(trade_date) FILTER (WHERE state <> 'DATA_INVALID') AS latest_valid_date FROM base_state GROUP BY market) v USING (market)
LEFT JOIN coverage c ON c.market = l.market AND c.trade_date = l.latest_calculated_date LEFT JOIN cards k ON k.market = l.market AND k.trade_date = v.latest_valid_date
""")


def diagnostics(spark, d):
    raw = td.stored_bars(spark, d)
    table = hand_off(build_states(td.regime_daily(spark, d, raw)))
    return sv.diagnostics(table, advisory_frame(table), market_coverage_daily(td.bars(spark, d, raw), td.QUALITY, dedupe=False))


register("sv6_diagnostics", diagnostics, "market status latest_valid_date latest_calculated_date row_count:n universe:n coverage_text warning_labels", "diagnostics")
register("sv7_recent_trading_days", lambda s, d: sv.recent_days(td.bars(s, d), 10), "market ts_code trade_date close:f", "(SELECT * FROM bars QUALIFY dense_rank() OVER (PARTITION BY market ORDER BY trade_date DESC) <= 10)")
NOW = "2001-08-04 16:05:00"
register("sv8_baseline_freshness", lambda s, d: sv.freshness(td.bars(s, d), NOW), "market latest_date required_date fresh safe_download_end",
         "(SELECT market, max(trade_date) AS latest_date, DATE '2001-08-03' AS required_date, max(trade_date) >= DATE '2001-08-03' AS fresh, DATE '2001-08-03' AS safe_download_end FROM bars GROUP BY market)")
def contract_tables(spark, d):
    daily = hand_off(td.regime_daily(spark, d))
    table = hand_off(build_states(daily))
    return sv.completeness({"temperature": daily, "state": table, "advisory": advisory_frame(table)})


register("sv9_completeness", lambda s, d: contract_tables(s, d).withColumnsRenamed({"temperature": "n_temperature", "state": "n_state", "advisory": "n_advisory"}), "market n_temperature:n n_state:n n_advisory:n ready",
         "(SELECT market, count(*) AS n_temperature, count(*) AS n_state, count(*) AS n_advisory, true AS ready FROM base_state GROUP BY market)")


def live_points(spark, d):
    """The last day's point revised upward by one degree, as an intraday refresh would deliver it."""
    points = hand_off(sv.trend(advisory(spark, d), "1Y"))
    live = sv.last_rows(points, 1).withColumns({"market_temperature": F.lit(55.5), "advisory_signal": F.lit("NEUTRAL")})
    return sv.replace_live_point(points, live)


register("st9_live_point_replaces", live_points, _POINT, "(SELECT * REPLACE (CASE WHEN date = m THEN 55.5E0 ELSE market_temperature END AS market_temperature, CASE WHEN date = m THEN 'NEUTRAL' ELSE advisory_signal END AS advisory_signal) FROM (SELECT *, max(date) OVER (PARTITION BY market) AS m FROM trend_1y))")
