"""Check SQL of the regime layer: indicators by list folds, the state machine by a recursive table."""

from __future__ import annotations

from collections.abc import Sequence

from ..params import MODULES, Variant
from .base import cte

_M = [f"{m}_score" for m in MODULES]

cte("rd_moved", "SELECT market, sk, trade_date, close, volume, lag(close) OVER (PARTITION BY market, sk ORDER BY trade_date) AS pre FROM raw_bars")
cte("rd_weekly", """
SELECT market, trade_date, count(*) AS n, count(*) FILTER (WHERE close > pre) AS up, count(*) FILTER (WHERE close < pre) AS down,
  count(*) FILTER (WHERE close >= pre * 1.5E0) AS jump, sum(volume) AS vol, sum(close) AS c, sum(pre) AS p FROM rd_moved WHERE pre IS NOT NULL GROUP BY market, trade_date
""")
cte("rd_three", """
SELECT market, trade_date, n, max(n) OVER (PARTITION BY market ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS best,
  CAST(sum(up) OVER t AS double) / nullif(sum(up) OVER t + sum(down) OVER t, 0) AS f_breadth, CAST(sum(jump) OVER t AS double) / nullif(sum(n) OVER t, 0) AS f_profit,
  sum(vol) OVER t AS f_liquidity, sum(c) OVER t / nullif(sum(p) OVER t, 0) AS f_stretch
FROM rd_weekly WINDOW t AS (PARTITION BY market ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")


def _pct(x: str) -> str:
    w = "(PARTITION BY market ORDER BY trade_date ROWS BETWEEN 103 PRECEDING AND CURRENT ROW)"
    seen = f"(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {w})"
    return f"CASE WHEN {x} IS NOT NULL AND len({seen}) >= 13 THEN (len(list_filter({seen}, lambda v: v < {x})) + 0.5E0 * len(list_filter({seen}, lambda v: v = {x}))) / len({seen}) * 100.0E0 END"


cte("rd_scores", f"SELECT market, trade_date, n, best, {_pct('f_breadth')} AS breadth_score, {_pct('f_profit')} AS profit_effect_score, {_pct('f_liquidity')} AS liquidity_score, {_pct('f_stretch')} AS stretch_score FROM rd_three")
cte("rd_mean", "SELECT *, (breadth_score + profit_effect_score + liquidity_score + stretch_score) / 4.0E0 AS mean_score FROM rd_scores")
cte("regime_daily", f"""
SELECT market, trade_date, {_pct('mean_score')} AS raw_market_temperature, breadth_score, profit_effect_score, liquidity_score, stretch_score,
  CASE WHEN n * 4 < best * 3 THEN 'INVALID' WHEN n = best THEN 'A' WHEN n * 10 >= best * 9 THEN 'B' ELSE 'C' END AS market_temperature_quality,
  CASE WHEN n * 4 >= best * 3 AND n = best THEN '' ELSE 'SURVIVORSHIP_BIAS_WARNING;OPTIONS_UNAVAILABLE' END AS data_quality_warnings,
  n AS observed_universe, best AS expected_eligible_count FROM rd_mean
""")


def regime_ctes(prefix: str, variants: Sequence[Variant]) -> None:
    """Define ``<prefix>_ind`` (indicators) and ``<prefix>_state`` (state table) for these parameter sets."""
    names = ["variant_id", "parameter", "value", *variants[0].settings()]

    def literal(v) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v}E0" if isinstance(v, float) else str(v)

    rows = ", ".join("(" + ", ".join(literal(x) for x in (v.variant_id, v.parameter, float(v.value), *v.settings().values())) + ")" for v in variants)
    look = {(v.machine.slope_lookback, v.machine.turning_window) for v in variants}
    assert len(look) == 1, "check SQL covers one frame length"
    lookback, turning = look.pop()
    p = prefix
    part = "PARTITION BY market, variant_id"
    cte(f"{p}_variants", f"SELECT * FROM (VALUES {rows}) AS t({', '.join(names)})")
    cte(f"{p}_marked", f"""
SELECT market, trade_date, data_quality_warnings, v.*, valid, CASE WHEN valid THEN raw_market_temperature END AS raw_temperature,
  CASE WHEN valid THEN market_temperature_quality ELSE 'INVALID' END AS quality,
  CASE WHEN NOT valid THEN 'NONE' WHEN market_temperature_quality = 'A' THEN 'HIGH' WHEN market_temperature_quality = 'B' THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  {', '.join(f'CASE WHEN valid THEN {m} END AS {m}' for m in _M)}
FROM (SELECT *, market_temperature_quality <> 'INVALID' AND raw_market_temperature IS NOT NULL AS valid FROM regime_daily), {p}_variants v
""")
    cte(f"{p}_ema", f"""
SELECT *, CASE WHEN valid THEN list_reduce(list(raw_temperature) FILTER (WHERE valid) OVER ({part} ORDER BY trade_date),
  lambda a, v: (2.0E0 / (ema_span + 1.0E0)) * v + (1.0E0 - 2.0E0 / (ema_span + 1.0E0)) * a) END AS smoothed_temperature FROM {p}_marked
""")
    wv = f"{part}, valid ORDER BY trade_date"
    cte(f"{p}_smooth", f"""
SELECT *, raw_temperature - smoothed_temperature AS temperature_shock, smoothed_temperature - lag(smoothed_temperature) OVER ({wv}) AS slope1,
  smoothed_temperature - lag(smoothed_temperature, {lookback}) OVER ({wv}) AS slope3,
  max(smoothed_temperature) OVER ({wv} ROWS BETWEEN {turning - 1} PRECEDING AND CURRENT ROW) AS rolling_high_10,
  min(smoothed_temperature) OVER ({wv} ROWS BETWEEN {turning - 1} PRECEDING AND CURRENT ROW) AS rolling_low_10,
  {', '.join(f'CASE WHEN {m}_score IS NOT NULL THEN {m}_score - lag({m}_score, 3) OVER ({part}, {m}_score IS NOT NULL ORDER BY trade_date) END AS {m}_delta3' for m in MODULES)}
FROM {p}_ema
""")
    up = " + ".join(f"CASE WHEN {m}_delta3 > 0 THEN 1 ELSE 0 END" for m in MODULES)
    down = " + ".join(f"CASE WHEN {m}_delta3 < 0 THEN 1 ELSE 0 END" for m in MODULES)
    cold = " + ".join(f"CASE WHEN {m} <= module_panic_threshold THEN 1 ELSE 0 END" for m in _M)
    hot = " + ".join(f"CASE WHEN {m} >= module_euphoria_threshold THEN 1 ELSE 0 END" for m in _M)
    cte(f"{p}_counted", f"""
SELECT *, smoothed_temperature - rolling_low_10 AS recovery_from_low, rolling_high_10 - smoothed_temperature AS drop_from_high,
  CASE WHEN valid THEN {up} ELSE 0 END AS improving_modules, CASE WHEN valid THEN {down} ELSE 0 END AS deteriorating_modules,
  CASE WHEN valid THEN {cold} ELSE 0 END AS panic_module_count, CASE WHEN valid THEN {hot} ELSE 0 END AS euphoria_module_count,
  row_number() OVER ({part} ORDER BY trade_date) AS rn
FROM {p}_smooth
""")
    cte(f"{p}_ind", f"""
SELECT *, coalesce(valid AND raw_temperature <= raw_panic_threshold AND panic_module_count >= minimum_extreme_modules, false) AS raw_panic_anchor,
  coalesce(valid AND smoothed_temperature <= smoothed_panic_threshold, false) AS smoothed_panic_anchor,
  coalesce(valid AND raw_temperature >= raw_euphoria_threshold AND euphoria_module_count >= minimum_extreme_modules, false) AS raw_euphoria_anchor,
  coalesce(valid AND smoothed_temperature >= smoothed_euphoria_threshold, false) AS smoothed_euphoria_anchor,
  coalesce(valid AND ((raw_temperature <= raw_panic_threshold AND panic_module_count >= minimum_extreme_modules) OR smoothed_temperature <= smoothed_panic_threshold), false) AS panic_anchor_event,
  coalesce(valid AND ((raw_temperature >= raw_euphoria_threshold AND euphoria_module_count >= minimum_extreme_modules) OR smoothed_temperature >= smoothed_euphoria_threshold), false) AS euphoria_anchor_event
FROM {p}_counted
""")
    # One recursion level per day; each level advances every series by one row.
    first = f"""
SELECT market, variant_id, CAST(0 AS bigint) AS rn, 'NONE' AS previous_state, 'NONE' AS state, 'NONE' AS signal, '' AS zone_state, CAST(0 AS bigint) AS watch_streak, CAST(0 AS bigint) AS carry_streak,
  false AS watch_timeout, false AS watch_invalidated, CAST(0 AS bigint) AS valid_index, '' AS carry_zone,
  false AS p_act, false AS p_closed, CAST(0 AS bigint) AS p_num, CAST(0 AS bigint) AS p_start, CAST(0 AS bigint) AS p_anch, CAST(NULL AS double) AS p_ext, CAST(NULL AS bigint) AS panic_episode_id, CAST(0 AS bigint) AS panic_episode_age, CAST(NULL AS double) AS post_panic_low, false AS recent_panic_episode, false AS panic_episode_closed,
  false AS e_act, false AS e_closed, CAST(0 AS bigint) AS e_num, CAST(0 AS bigint) AS e_start, CAST(0 AS bigint) AS e_anch, CAST(NULL AS double) AS e_ext, CAST(NULL AS bigint) AS euphoria_episode_id, CAST(0 AS bigint) AS euphoria_episode_age, CAST(NULL AS double) AS post_euphoria_high, false AS recent_euphoria_episode, false AS euphoria_episode_closed
FROM (SELECT DISTINCT market, variant_id FROM {p}_ind)
"""

    def side(k: str, event: str, agg: str) -> str:
        kept = f"(w.{k}_act AND NOT vi - w.{k}_anch >= memory_window)"
        return f"""
  {kept} OR {event} AS {k}_act1, CASE WHEN {event} AND NOT {kept} THEN w.{k}_num + 1 ELSE w.{k}_num END AS {k}_num1,
  CASE WHEN {event} AND NOT {kept} THEN vi ELSE w.{k}_start END AS {k}_start1, CASE WHEN {event} THEN vi ELSE w.{k}_anch END AS {k}_anch1,
  CASE WHEN {event} AND NOT {kept} THEN smoothed_temperature WHEN {event} THEN {agg}(w.{k}_ext, smoothed_temperature) ELSE w.{k}_ext END AS {k}_ext1,
  CASE WHEN {event} AND NOT {kept} THEN false ELSE w.{k}_closed OR (w.{k}_act AND NOT {kept}) END AS {k}_closed1"""

    cte(f"{p}_machine", f"""
{first} UNION ALL
SELECT market, variant_id, rn, prev, CASE WHEN NOT valid THEN 'DATA_INVALID' ELSE st END, CASE WHEN NOT valid THEN 'NONE' ELSE sig END,
  CASE WHEN NOT valid THEN 'DATA_INVALID' ELSE zone END, CASE WHEN NOT valid THEN 0 ELSE streak END, CASE WHEN NOT valid OR ends_with(sig, '_CONFIRMED') THEN 0 ELSE streak END,
  valid AND act = 'timeout', valid AND act = 'broken', vi, CASE WHEN NOT valid THEN w_zone ELSE zone END,
  valid AND p_act1 AND sig <> 'ICE_REVERSAL_CONFIRMED', CASE WHEN NOT valid OR sig = 'ICE_REVERSAL_CONFIRMED' THEN true ELSE p_closed1 END,
  CASE WHEN valid THEN p_num1 ELSE w_p_num END, p_start1, p_anch1, p_ext1,
  CASE WHEN valid AND p_act1 THEN p_num1 END, CASE WHEN valid AND p_act1 THEN vi - p_start1 + 1 ELSE 0 END, CASE WHEN valid AND p_act1 THEN p_ext1 END, valid AND p_act1,
  CASE WHEN NOT valid THEN true ELSE sig = 'ICE_REVERSAL_CONFIRMED' OR (p_closed1 AND NOT p_act1) END,
  valid AND e_act1 AND sig <> 'HOT_ROLLOVER_CONFIRMED', CASE WHEN NOT valid OR sig = 'HOT_ROLLOVER_CONFIRMED' THEN true ELSE e_closed1 END,
  CASE WHEN valid THEN e_num1 ELSE w_e_num END, e_start1, e_anch1, e_ext1,
  CASE WHEN valid AND e_act1 THEN e_num1 END, CASE WHEN valid AND e_act1 THEN vi - e_start1 + 1 ELSE 0 END, CASE WHEN valid AND e_act1 THEN e_ext1 END, valid AND e_act1,
  CASE WHEN NOT valid THEN true ELSE sig = 'HOT_ROLLOVER_CONFIRMED' OR (e_closed1 AND NOT e_act1) END
FROM (SELECT *,
    CASE act WHEN 'ice_confirm' THEN 'ICE_REVERSAL' WHEN 'hot_confirm' THEN 'HOT_ROLLOVER' WHEN 'ice_watch' THEN 'ICE_REVERSAL_WATCH' WHEN 'hot_watch' THEN 'HOT_ROLLOVER_WATCH'
      WHEN 'ice_new' THEN 'ICE_REVERSAL_WATCH' WHEN 'hot_new' THEN 'HOT_ROLLOVER_WATCH' WHEN 'stay' THEN prev ELSE base END AS st,
    CASE act WHEN 'ice_confirm' THEN 'ICE_REVERSAL_CONFIRMED' WHEN 'hot_confirm' THEN 'HOT_ROLLOVER_CONFIRMED' WHEN 'ice_watch' THEN 'ICE_REVERSAL_WATCH' WHEN 'hot_watch' THEN 'HOT_ROLLOVER_WATCH'
      WHEN 'ice_new' THEN 'ICE_REVERSAL_WATCH' WHEN 'hot_new' THEN 'HOT_ROLLOVER_WATCH' ELSE 'NONE' END AS sig,
    CASE WHEN act IN ('ice_new', 'hot_new') THEN 1 WHEN act IN ('ice_confirm', 'hot_confirm', 'ice_watch', 'hot_watch') THEN w_streak + 1 ELSE 0 END AS streak
  FROM (SELECT *,
      CASE WHEN prev = 'ICE_REVERSAL_WATCH' THEN CASE WHEN coalesce(slope3 <= 0, false) THEN 'broken' WHEN w_streak >= watch_timeout_cfg THEN 'timeout' WHEN ice AND w_streak + 1 >= confirmation_days THEN 'ice_confirm' ELSE 'ice_watch' END
        WHEN prev = 'HOT_ROLLOVER_WATCH' THEN CASE WHEN coalesce(slope3 >= 0, false) THEN 'broken' WHEN w_streak >= watch_timeout_cfg THEN 'timeout' WHEN hot AND w_streak + 1 >= confirmation_days THEN 'hot_confirm' ELSE 'hot_watch' END
        WHEN prev = 'ICE_REVERSAL' THEN CASE WHEN ice AND panic_anchor_event AND p_num1 IS DISTINCT FROM w_p_id THEN 'ice_new' WHEN ice THEN 'stay' ELSE 'base' END
        WHEN prev = 'HOT_ROLLOVER' THEN CASE WHEN hot AND euphoria_anchor_event AND e_num1 IS DISTINCT FROM w_e_id THEN 'hot_new' WHEN hot THEN 'stay' ELSE 'base' END
        WHEN ice THEN 'ice_new' WHEN hot THEN 'hot_new' ELSE 'base' END AS act,
      CASE WHEN p_act1 AND (coalesce(slope3 < 0, false) OR raw_temperature <= raw_panic_threshold) THEN 'PANIC_FALLING' WHEN p_act1 THEN 'EXTREME_PANIC'
        WHEN e_act1 AND coalesce(slope3 > 0, false) AND (smoothed_temperature >= smoothed_euphoria_threshold OR raw_temperature >= raw_euphoria_threshold) THEN 'EUPHORIA_RISING' ELSE zone END AS base
    FROM (SELECT *,
        coalesce(p_act1 AND smoothed_temperature - p_ext1 >= turning_delta AND slope3 >= slope3_threshold AND improving_modules >= minimum_confirming_modules AND (coalesce(breadth_delta3 > 0, false) OR coalesce(profit_effect_delta3 > 0, false)), false) AS ice,
        coalesce(e_act1 AND e_ext1 - smoothed_temperature >= turning_delta AND slope3 <= -slope3_threshold AND deteriorating_modules >= minimum_confirming_modules AND (coalesce(breadth_delta3 < 0, false) OR coalesce(profit_effect_delta3 < 0, false)), false) AS hot,
        CASE WHEN w_zone = 'HOT' AND smoothed_temperature >= warm_threshold - zone_hysteresis THEN 'HOT' WHEN w_zone = 'COLD' AND smoothed_temperature <= cool_threshold + zone_hysteresis THEN 'COLD'
          WHEN smoothed_temperature >= warm_threshold THEN 'HOT' WHEN smoothed_temperature <= cool_threshold THEN 'COLD' ELSE 'NORMAL' END AS zone
      FROM (SELECT i.* EXCLUDE (watch_timeout), i.watch_timeout AS watch_timeout_cfg, w.state AS prev, w.carry_streak AS w_streak, w.carry_zone AS w_zone, w.panic_episode_id AS w_p_id, w.euphoria_episode_id AS w_e_id, w.p_num AS w_p_num, w.e_num AS w_e_num, vi,
          {side('p', 'panic_anchor_event', 'least')}, {side('e', 'euphoria_anchor_event', 'greatest')}
        FROM {p}_machine w JOIN {p}_ind i ON i.market = w.market AND i.variant_id = w.variant_id AND i.rn = w.rn + 1
          CROSS JOIN LATERAL (SELECT w.valid_index + CASE WHEN i.valid THEN 1 ELSE 0 END AS vi)))))
""")
    cte(f"{p}_state0", f"""
SELECT i.* EXCLUDE (watch_timeout), m.* EXCLUDE (market, variant_id, rn), m.watch_streak AS confirmation_streak, m.state <> m.previous_state AS state_changed,
  smoothed_temperature - post_panic_low AS recovery_from_post_panic_low, post_euphoria_high - smoothed_temperature AS drop_from_post_euphoria_high,
  sum(CASE WHEN m.state <> m.previous_state THEN 1 ELSE 0 END) OVER (PARTITION BY i.market, i.variant_id ORDER BY i.rn) AS run_id,
  concat_ws(';', nullif(data_quality_warnings, ''), CASE WHEN m.watch_timeout THEN 'WATCH_TIMEOUT' WHEN m.watch_invalidated THEN 'WATCH_INVALIDATED' END) AS warnings
FROM {p}_ind i JOIN {p}_machine m ON m.market = i.market AND m.variant_id = i.variant_id AND m.rn = i.rn
""")
    cte(f"{p}_state", f"SELECT *, row_number() OVER (PARTITION BY market, variant_id, run_id ORDER BY rn) AS state_duration FROM {p}_state0")


regime_ctes("base", [Variant()])
