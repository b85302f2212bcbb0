"""Advisory queries (AD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advisory as ad
from ..operators import advisory_text as tx
from ..operators.quality import changed_cells
from ..operators.state_machine import build_states
from ..sources import testdata as td
from .base import cte, register
from .regime import SPLIT, states


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(names) -> str:
    return "(" + ", ".join(_q(n) for n in names) + ")"


cte("state_dim", f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(_q(v) for v in row) + ')' for row in tx.STATE_TEXT)}) AS t({', '.join(tx.FIELDS)})")
cte("ctx0", f"""
SELECT *, valid AND (coalesce(recent_panic_episode, false) OR coalesce(raw_temperature <= 20, false) OR coalesce(smoothed_temperature <= 20, false)) AS px,
  valid AND (coalesce(recent_euphoria_episode, false) OR coalesce(raw_temperature >= 85, false) OR coalesce(smoothed_temperature >= 80, false)) AS hx,
  coalesce(lag(NOT (valid AND state IN {_in(ad.PANIC_FAMILY)})) OVER (PARTITION BY market ORDER BY trade_date), false) AS pr,
  coalesce(lag(NOT (valid AND state IN {_in(ad.HOT_FAMILY)})) OVER (PARTITION BY market ORDER BY trade_date), false) AS hr
FROM base_state
""")
cte("ctx1", "SELECT *, sum(pr::int) OVER w AS pi, sum(hr::int) OVER w AS hi FROM ctx0 WINDOW w AS (PARTITION BY market ORDER BY trade_date)")
_names = lambda up: "list_filter([" + ", ".join(f"CASE WHEN {m}_delta3 {'>' if up else '<'} 0 THEN {_q(label)} END" for m, label in tx.MODULE_LABELS) + "], lambda x: x IS NOT NULL)"
cte("ctx", f"""
SELECT *, CASE WHEN state = 'ICE_REVERSAL' THEN state_days ELSE 0 END AS ice_days, CASE WHEN state = 'HOT_ROLLOVER' THEN state_days ELSE 0 END AS hot_days,
  CASE WHEN len(nm) > 0 THEN len(nm) ELSE least(greatest(CASE WHEN state IN {_in(ad.ICE_DIRECTION)} THEN improving_modules ELSE deteriorating_modules END, 0), 4) END AS confirming_modules, array_to_string(nm, ';') AS confirming_module_names
FROM (SELECT *, CASE WHEN valid THEN state_duration ELSE 0 END AS state_days, bool_or(px) OVER (PARTITION BY market, pi ORDER BY trade_date) AS panic_was_extreme, bool_or(hx) OVER (PARTITION BY market, hi ORDER BY trade_date) AS euphoria_was_extreme,
    CASE WHEN state IN {_in(ad.ICE_DIRECTION)} THEN {_names(True)} ELSE {_names(False)} END AS nm FROM ctx1)
""")
cte("strength", """
SELECT *, coalesce(state = 'ICE_REVERSAL' AND ice_days >= 3 AND panic_was_extreme AND breadth_delta3 > 0 AND profit_effect_delta3 > 0 AND slope3 > 0 AND confirming_modules >= 3, false)
  OR coalesce(state = 'HOT_ROLLOVER' AND hot_days >= 3 AND euphoria_was_extreme AND breadth_delta3 < 0 AND profit_effect_delta3 < 0 AND slope3 < 0 AND confirming_modules >= 3, false) AS strong_confirmation FROM ctx
""")
_clip = lambda x: f"least(greatest({x}, 0.0E0), 1.0E0)"
cte("confidence", f"""
SELECT *, CASE WHEN c_quality <= 0 THEN 'LOW' WHEN confidence_score >= 0.70 THEN 'HIGH' WHEN confidence_score >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS signal_confidence
FROM (SELECT *, 0.30E0 * c_quality + 0.25E0 * c_agreement + 0.20E0 * c_distance + 0.15E0 * c_slope + 0.10E0 * c_persistence AS confidence_score
  FROM (SELECT * EXCLUDE (confidence), CASE quality WHEN 'INVALID' THEN 0.0E0 WHEN 'A' THEN 1.0E0 WHEN 'B' THEN 0.72E0 ELSE 0.45E0 END AS c_quality, 0.55E0 + 0.45E0 * (confirming_modules / 4.0E0) AS c_agreement,
      CASE WHEN state = 'DATA_INVALID' OR smoothed_temperature IS NULL THEN 0.0E0 WHEN state IN ('PANIC_FALLING', 'EXTREME_PANIC', 'COLD') THEN {_clip('(40.0E0 - smoothed_temperature) / 40.0E0')}
        WHEN state IN {_in(ad.HOT_FAMILY)} THEN {_clip('(smoothed_temperature - 60.0E0) / 40.0E0')} WHEN state IN ('ICE_REVERSAL_WATCH', 'ICE_REVERSAL') THEN {_clip('coalesce(recovery_from_post_panic_low, recovery_from_low, 0) / 20.0E0')} ELSE 0.65E0 END AS c_distance,
      coalesce({_clip('abs(slope3) / 8.0E0')}, 0.0E0) AS c_slope, {_clip('state_days / 3.0E0')} AS c_persistence FROM strength))
""")
_codes = [
    f"CASE WHEN recent_panic_episode THEN 'PANIC_EPISODE_ACTIVE' WHEN state IN {_in(ad.PANIC_FAMILY)} THEN 'PANIC_EPISODE_RECENT' END",
    "CASE WHEN recent_euphoria_episode THEN 'EUPHORIA_EPISODE_ACTIVE' WHEN state IN ('EUPHORIA_RISING', 'HOT_ROLLOVER_WATCH', 'HOT_ROLLOVER') THEN 'EUPHORIA_EPISODE_RECENT' END",
    "CASE WHEN raw_temperature <= 20 THEN 'RAW_TEMPERATURE_EXTREME_LOW' END", "CASE WHEN raw_temperature >= 85 THEN 'RAW_TEMPERATURE_EXTREME_HIGH' END",
    "CASE WHEN smoothed_temperature <= 20 THEN 'EMA_EXTREME_LOW' END", "CASE WHEN smoothed_temperature >= 80 THEN 'EMA_EXTREME_HIGH' END",
]
for _m, _ in tx.MODULE_LABELS:
    _u = _m.upper()
    _codes += [f"CASE WHEN {_m}_score <= 20 THEN '{_u}_EXTREME_LOW' WHEN {_m}_score >= 80 THEN '{_u}_EXTREME_HIGH' END", f"CASE WHEN {_m}_delta3 > 0 THEN '{_u}_RECOVERING' WHEN {_m}_delta3 < 0 THEN '{_u}_DETERIORATING' END"]
_codes += [
    "CASE WHEN slope3 > 0 THEN 'EMA_RECOVERING' WHEN slope3 < 0 THEN 'EMA_DETERIORATING' END",
    "CASE state WHEN 'ICE_REVERSAL_WATCH' THEN 'ICE_WATCH' WHEN 'ICE_REVERSAL' THEN 'ICE_CONFIRMED' WHEN 'HOT_ROLLOVER_WATCH' THEN 'HOT_WATCH' WHEN 'HOT_ROLLOVER' THEN 'HOT_CONFIRMED' END",
    *[f"CASE WHEN contains(data_quality_warnings, '{w}') THEN '{w}' END" for w in ("SURVIVORSHIP_BIAS_WARNING", "OPTIONS_UNAVAILABLE")],
]
_fill = lambda t: f"replace(replace(replace({t}, '{{raw}}', raw_text), '{{smooth}}', smooth_text), '{{changed}}', what_changed)"
cte("advisory0", f"""
SELECT *, CASE WHEN state = 'DATA_INVALID' THEN 'DATA_INVALID' ELSE concat_ws(';', {', '.join(_codes)}) END AS reason_codes, coalesce(printf('%.1f', raw_temperature), 'N/A') AS raw_text, coalesce(printf('%.1f', smoothed_temperature), 'N/A') AS smooth_text,
  coalesce(nullif(concat_ws('{tx.FRAGMENT_JOIN}', CASE WHEN len({_names(True)}) > 0 THEN '{tx.IMPROVING}' || array_to_string({_names(True)}, '{tx.JOIN}') END, CASE WHEN len({_names(False)}) > 0 THEN '{tx.WEAKENING}' || array_to_string({_names(False)}, '{tx.JOIN}') END,
    CASE WHEN slope3 > 0 THEN '{tx.SLOPE_UP}' WHEN slope3 < 0 THEN '{tx.SLOPE_DOWN}' WHEN slope3 IS NOT NULL THEN '{tx.SLOPE_FLAT}' END), ''), '{tx.NO_DIRECTION}') AS what_changed,
  CASE WHEN state IN ('ICE_REVERSAL_WATCH', 'ICE_REVERSAL') THEN CASE WHEN strong_confirmation THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END AS buy_reference,
  CASE WHEN state IN ('HOT_ROLLOVER_WATCH', 'HOT_ROLLOVER') THEN CASE WHEN strong_confirmation THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END AS sell_reference
FROM confidence
""")
cte("advisory", f"""
SELECT a.*, d.* EXCLUDE (state), a.trade_date AS date, a.raw_temperature AS market_temperature, a.raw_temperature AS temperature, a.smoothed_temperature AS ema_temperature, a.signal AS state_signal, d.meaning AS what_it_means,
  {_fill('d.why_template')} AS why, {_fill(_q(tx.CURRENT_TEMPLATE))} AS current_condition,
  state IN ('ICE_REVERSAL_WATCH', 'ICE_REVERSAL') AS short_term_warning, state IN ('HOT_ROLLOVER_WATCH', 'HOT_ROLLOVER') AS not_exact_top, state IN ('ICE_REVERSAL', 'HOT_ROLLOVER') AS active_advisory_window
FROM advisory0 a JOIN state_dim d USING (state)
""")


def advisory(spark, d):
    return ad.advisory_frame(states(spark, d))


register("ad1_state_mapping", advisory, "market trade_date advisory_signal advisory_regime risk_level expected_horizon reference_horizon", "advisory")
register("ad2_causal_context", advisory, "market trade_date state_days:n ice_days:n hot_days:n panic_was_extreme euphoria_was_extreme", "advisory")
register("ad3_strong_confirmation", advisory, "market trade_date strong_confirmation", "advisory")
register("ad4_references", advisory, "market trade_date buy_reference sell_reference", "advisory")
register("ad5_module_confirmation", advisory, "market trade_date confirming_modules:n confirming_module_names", "advisory")
register("ad6_signal_confidence", advisory, "market trade_date c_quality:f c_agreement:f c_distance:f c_slope:f c_persistence:f confidence_score:f signal_confidence", "advisory")
register("ad7_research_evidence", advisory, "market trade_date research_evidence short_term_evidence medium_term_evidence", "advisory")
register("ad8_reason_codes", advisory, "market trade_date reason_codes", "advisory")
register("ad9_explanation_text", advisory, "market trade_date headline summary why what_to_watch_next what_changed what_it_means current_condition", "advisory")
register(
    "ad10_advisory_history", lambda s, d: ad.advisory_history(advisory(s, d)),
    "market date temperature:f ema_temperature:f state signal advisory_signal buy_reference sell_reference signal_confidence confirming_modules:n reason_codes short_term_warning not_exact_top", "advisory",
)
register(
    "ad11_latest_valid", lambda s, d: ad.select_advisory(advisory(s, d), start="1996-01-01", end="2000-12-31"), "market trade_date state advisory_signal market_temperature:f",
    "(SELECT * FROM advisory WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND advisory_signal <> 'DATA_INVALID' QUALIFY row_number() OVER (PARTITION BY market ORDER BY trade_date DESC) = 1)",
)
register("ad11_dated", lambda s, d: ad.select_advisory(advisory(s, d), date="1999-03-01"), "market trade_date state advisory_signal", "advisory WHERE trade_date = DATE '1999-03-01'")
register(
    "dq15_advisory_audit", lambda s, d: ad.audit_checks(advisory(s, d)), "market state_signal_consistent hot_rollover_semantics data_invalid_hard_gate vocabulary_ok warning_semantics_clear card_complete",
    f"""(SELECT a.market, bool_and(a.advisory_signal = d.advisory_signal) AS state_signal_consistent, bool_or(state IN {_in(ad.HOT_FAMILY)}) AND bool_and(state NOT IN {_in(ad.HOT_FAMILY)} OR a.advisory_signal = d.advisory_signal) AS hot_rollover_semantics,
    bool_or(state = 'DATA_INVALID') AND bool_and(state <> 'DATA_INVALID' OR a.advisory_signal = 'DATA_INVALID') AS data_invalid_hard_gate, bool_and(a.advisory_signal IN {_in(tx.ADVISORY_SIGNALS)}) AS vocabulary_ok,
    NOT bool_or(contains(reason_codes, 'DATA_QUALITY_WARNING')) AS warning_semantics_clear, bool_and(trim(why) <> '' AND trim(a.headline) <> '') AS card_complete FROM advisory a JOIN state_dim d USING (state) GROUP BY a.market)""",
)
_STABLE = ["advisory_signal", "buy_reference", "signal_confidence", "reason_codes", "why", "market_temperature"]


def advisory_stability(spark, d):
    daily = td.regime_daily(spark, d)
    early = daily.filter(F.col("trade_date") < F.lit(SPLIT).cast("date"))
    return changed_cells(ad.advisory_frame(build_states(daily)), ad.advisory_frame(build_states(early)), ["market", "trade_date"], _STABLE)


register("dq13_advisory_no_lookahead", advisory_stability, "prefix_rows:n missing_rows:n " + " ".join(f"changed_{c}:n" for c in _STABLE),
         "(SELECT count(*) AS prefix_rows, 0 AS missing_rows, " + ", ".join(f"0 AS changed_{c}" for c in _STABLE) + f" FROM base_state WHERE trade_date < DATE '{SPLIT}')")
