"""Episode memory and regime states: one causal step shared by the batch and the streaming run.

The transition depends on its own previous output, so it is a fold in date order. A fold runs per series
(market and parameter set) over at most one row per trading day; Spark spreads the series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import Variant
from .regime import regime_indicators

# State and signal vocabulary.
STATES = (
    "DATA_INVALID",
    "EXTREME_PANIC",
    "PANIC_FALLING",
    "ICE_REVERSAL_WATCH",
    "ICE_REVERSAL",
    "COLD",
    "NORMAL",
    "HOT",
    "EUPHORIA_RISING",
    "HOT_ROLLOVER_WATCH",
    "HOT_ROLLOVER",
)
SIGNALS = ("NONE", "ICE_REVERSAL_WATCH", "ICE_REVERSAL_CONFIRMED", "HOT_ROLLOVER_WATCH", "HOT_ROLLOVER_CONFIRMED")

OUTPUT = (
    "panic_episode_armed boolean, recent_panic_episode boolean, panic_episode_age bigint, panic_episode_id bigint, "
    "post_panic_low double, recovery_from_post_panic_low double, panic_episode_closed boolean, "
    "euphoria_episode_armed boolean, recent_euphoria_episode boolean, euphoria_episode_age bigint, euphoria_episode_id bigint, "
    "post_euphoria_high double, drop_from_post_euphoria_high double, euphoria_episode_closed boolean, "
    "previous_state string, state string, signal string, zone_state string, watch_streak bigint, confirmation_streak bigint, "
    "watch_timeout boolean, watch_invalidated boolean, state_changed boolean, state_duration bigint"
)
OUTPUT_COLUMNS = [part.strip().split(" ")[0] for part in OUTPUT.split(",")]
NAN = float("nan")


@dataclass
class Episode:
    """Memory of one kind of extreme. Ids keep counting across closures and invalid days."""

    active: bool = False
    closed: bool = False
    number: int = 0
    start: int = 0
    anchored: int = 0
    extreme: float = NAN

    def observe(self, event: bool, value: float, index: int, memory: int, lowest: bool) -> None:
        if self.active and index - self.anchored >= memory:
            self.active, self.closed = False, True
        if not event:
            return
        if not self.active:
            self.number += 1
            self.active, self.closed, self.start, self.extreme = True, False, index, value
        self.anchored = index
        self.extreme = min(self.extreme, value) if lowest else max(self.extreme, value)

    def close(self) -> None:
        self.active, self.closed = False, True


@dataclass
class MachineState:
    """Everything that survives from one trading day to the next."""

    state: str = "NONE"
    zone: str = ""
    streak: int = 0
    duration: int = 0
    index: int = 0
    panic_id: int | None = None
    euphoria_id: int | None = None
    panic: Episode = field(default_factory=Episode)
    euphoria: Episode = field(default_factory=Episode)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> "MachineState":
        data = dict(data)
        data["panic"], data["euphoria"] = Episode(**data["panic"]), Episode(**data["euphoria"])
        return cls(**data)


def zone_of(value: float, previous: str, cool: float, warm: float, band: float) -> str:
    """HOT/NORMAL/COLD with a wider exit than entry."""
    upper = warm - band if previous == "HOT" else warm
    lower = cool + band if previous == "COLD" else cool
    if previous == "COLD":
        return "COLD" if value <= lower else "HOT" if value >= upper else "NORMAL"
    return "HOT" if value >= upper else "COLD" if value <= lower else "NORMAL"


def _either(a: float, b: float, positive: bool) -> bool:
    return (a > 0 or b > 0) if positive else (a < 0 or b < 0)


def step(s: MachineState, row: Any, variant: Variant, legacy: bool = False) -> tuple:
    """Advance ``s`` by one day and return that day's ``OUTPUT`` values.

    ``legacy`` serves rows without anchor flags: rolling extremes stand in for episode extremes.
    """
    cfg, anc = variant.machine, variant.anchors
    previous = s.state
    smooth, raw, slope = row.smoothed_temperature, row.raw_temperature, row.slope3
    if not row.regime_valid_observation or math.isnan(raw) or math.isnan(smooth):
        for episode in (s.panic, s.euphoria):
            episode.close()
        s.streak = 0
        s.state = "DATA_INVALID"
        s.duration = s.duration + 1 if previous == s.state else 1
        s.panic_id = s.euphoria_id = None
        quiet = (False, False, 0, None, NAN, NAN, True)
        return (*quiet, *quiet, previous, s.state, "NONE", "DATA_INVALID", 0, 0, False, False, previous != s.state, s.duration)

    s.index += 1
    panic_event = bool(row.panic_anchor_event) and not legacy
    euphoria_event = bool(row.euphoria_anchor_event) and not legacy
    s.panic.observe(panic_event, smooth, s.index, anc.memory_window, True)
    s.euphoria.observe(euphoria_event, smooth, s.index, anc.memory_window, False)
    panic_on, euphoria_on = s.panic.active, s.euphoria.active
    low = s.panic.extreme if panic_on else NAN
    high = s.euphoria.extreme if euphoria_on else NAN
    recovery, drop = smooth - low, high - smooth
    panic_id = s.panic.number if panic_on else None
    euphoria_id = s.euphoria.number if euphoria_on else None

    if legacy:
        panic_ok, rise = row.rolling_low_10 <= cfg.cold_threshold, row.recovery_from_low
        euphoria_ok, fall = row.rolling_high_10 >= cfg.hot_threshold, row.drop_from_high
    else:
        panic_ok, rise, euphoria_ok, fall = panic_on, recovery, euphoria_on, drop
    ice = (
        panic_ok and rise >= cfg.turning_delta and slope >= cfg.slope3_threshold
        and row.improving_modules >= cfg.minimum_confirming_modules and _either(row.breadth_delta3, row.profit_effect_delta3, True)
    )
    hot = (
        euphoria_ok and fall >= cfg.turning_delta and slope <= -cfg.slope3_threshold
        and row.deteriorating_modules >= cfg.minimum_confirming_modules and _either(row.breadth_delta3, row.profit_effect_delta3, False)
    )

    s.zone = zone_of(smooth, s.zone, cfg.cool_threshold, cfg.warm_threshold, cfg.zone_hysteresis)
    if legacy:
        in_panic, falling = smooth <= cfg.cold_threshold, slope < 0
        rising = smooth >= cfg.hot_threshold and slope > 0
    else:
        in_panic, falling = panic_on, slope < 0 or raw <= anc.raw_panic_threshold
        rising = euphoria_on and slope > 0 and (smooth >= anc.smoothed_euphoria_threshold or raw >= anc.raw_euphoria_threshold)
    base = ("PANIC_FALLING" if falling else "EXTREME_PANIC") if in_panic else "EUPHORIA_RISING" if rising else s.zone

    state, signal, streak = base, "NONE", 0
    timed_out = broken = False
    closing: Episode | None = None
    turning = {"ICE_REVERSAL": (ice, slope <= 0, s.panic, panic_event, panic_id, s.panic_id), "HOT_ROLLOVER": (hot, slope >= 0, s.euphoria, euphoria_event, euphoria_id, s.euphoria_id)}
    watching = previous.removesuffix("_WATCH")
    if previous.endswith("_WATCH"):
        candidate, against, episode, *_ = turning[watching]
        if against:
            broken = True
        elif s.streak >= cfg.watch_timeout:
            timed_out = True
        else:
            streak = s.streak + 1
            if candidate and streak >= cfg.confirmation_days:
                state, signal, closing = watching, f"{watching}_CONFIRMED", episode
            else:
                state = signal = previous
    elif previous in turning:
        candidate, _, _, event, now, before = turning[previous]
        if candidate and event and now != before:
            state = signal = f"{previous}_WATCH"
            streak = 1
        elif candidate:
            state = previous
    elif ice or hot:
        state = signal = "ICE_REVERSAL_WATCH" if ice else "HOT_ROLLOVER_WATCH"
        streak = 1

    def fields(episode: Episode, on: bool, number: int | None, extreme: float, distance: float) -> tuple:
        age = s.index - episode.start + 1 if on else 0
        return (on, on, age, number, extreme, distance, closing is episode or (episode.closed and not on))

    out = (*fields(s.panic, panic_on, panic_id, low, recovery), *fields(s.euphoria, euphoria_on, euphoria_id, high, drop))
    if closing is not None:
        closing.close()
    s.duration = s.duration + 1 if state == previous else 1
    # A confirmation ends its streak; any other streak is what the next day continues.
    s.streak = 0 if closing is not None else streak
    s.state, s.panic_id, s.euphoria_id = state, panic_id, euphoria_id
    return (*out, previous, state, signal, s.zone, streak, streak, timed_out, broken, state != previous, s.duration)


def run_series(rows: pd.DataFrame, variant: Variant, state: MachineState | None = None, legacy: bool = False) -> pd.DataFrame:
    """Fold one date-ordered series; ``state`` carries over between calls."""
    state = state or MachineState()
    produced = [step(state, row, variant, legacy) for row in rows.itertuples(index=False)]
    out = pd.DataFrame(produced, columns=OUTPUT_COLUMNS, index=rows.index)
    for name in ("panic_episode_id", "euphoria_episode_id"):
        out[name] = out[name].astype("Int64")
    return out


def _schema(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(OUTPUT).fields])


def apply_state_machine(indicators: DataFrame, variants: Sequence[Variant] | None = None, keys: Sequence[str] = ("market",), legacy: bool = False) -> DataFrame:
    """State table for every series. Only columns that later layers read cross into Python."""
    lookup = {v.variant_id: v for v in (variants or [Variant()])}
    slim = indicators.drop("p")
    by = [*keys, "variant_id"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date", ignore_index=True)
        return pd.concat([pdf, run_series(pdf, lookup[pdf["variant_id"].iat[0]], legacy=legacy)], axis=1)

    return slim.groupBy(*by).applyInPandas(fold, _schema(slim))


def finish_states(states: DataFrame) -> DataFrame:
    """Append the watch outcome to the row's warnings."""
    base = F.coalesce(F.col("data_quality_warnings"), F.lit("")) if "data_quality_warnings" in states.columns else F.lit("")
    outcome = F.when(F.col("watch_timeout"), F.lit("WATCH_TIMEOUT")).when(F.col("watch_invalidated"), F.lit("WATCH_INVALIDATED"))
    return states.withColumn("warnings", F.concat_ws(";", F.when(base != "", base), outcome))


def build_states(daily: DataFrame, variants: Sequence[Variant] | None = None, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Daily temperature table to state table. Equal parameter sets run once; their rows are then given to every name."""
    names: dict[tuple, list[Variant]] = {}
    for variant in variants or [Variant()]:
        names.setdefault((variant.machine, variant.anchors), []).append(variant)
    distinct = [same[0] for same in names.values()]
    states = finish_states(apply_state_machine(regime_indicators(daily, distinct, keys), distinct, keys))
    if all(len(same) == 1 for same in names.values()):
        return states
    shared = F.coalesce(*[F.when(F.col("variant_id") == same[0].variant_id, F.array(*[F.lit(v.variant_id) for v in same])) for same in names.values()])
    return states.withColumn("_named", F.explode(shared)).withColumn("variant_id", F.col("_named")).drop("_named")
