"""Read models over the state and advisory tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import flag
from ..functions.text import decimals
from .regime_reports import ordered_states

# Published display labels.
SIGNAL_LABELS = {
    "PANIC_WAIT": "恐慌下行 · 等待确认", "BUY_WATCH": "修复观察", "BUY_REFERENCE": "修复参考", "NEUTRAL": "中性",
    "HOT_CAUTION": "偏热谨慎", "SELL_WATCH": "退潮观察", "SELL_REFERENCE": "退潮参考", "DATA_INVALID": "数据不可用",
}
STATE_LABELS = {
    "PANIC_FALLING": "恐慌下行", "EXTREME_PANIC": "极端恐慌", "ICE_REVERSAL_WATCH": "冰点修复观察", "ICE_REVERSAL": "冰点修复确认", "COLD": "偏冷", "NORMAL": "中性", "HOT": "偏热",
    "EUPHORIA_RISING": "高温上行", "HOT_ROLLOVER_WATCH": "高温退潮观察", "HOT_ROLLOVER": "高温退潮确认", "DATA_INVALID": "数据不可用",
}
RISK_LABELS = {"LOW": "低", "NORMAL": "正常", "ELEVATED": "偏高", "HIGH": "高", "EXTREME": "极高"}
HORIZON_LABELS = {
    "NOT_APPLICABLE": "不适用", "SHORT_TERM": "短期", "SHORT_TERM_UNCERTAINTY": "短期不确定性", "MEDIUM_TERM": "中期（20–60 个交易观测）", "MEDIUM_TERM_RISK": "中期风险（40–60 个交易观测）",
}
CONFIDENCE_LABELS = {"LOW": "低", "MEDIUM": "中", "HIGH": "高"}
EVIDENCE_LABELS = {"UNPROVEN": "尚未验证", "WEAK": "较弱", "WEAK_TO_MODERATE": "较弱至中等", "MODERATE": "中等", "RELATIVELY_STRONG": "相对较强"}
WARNING_MEANINGS = {
    "SURVIVORSHIP_BIAS_WARNING": ("生存者偏差提示", "当前股票池不能完全还原历史当日股票集合。", False),
    "HISTORICAL_DELIST_DATE_INCOMPLETE": ("历史退市日期不完整", "历史股票集合的退市日期信息不完整，覆盖率解读需保守。", False),
    "MARGIN_OPTIONAL": ("融资融券数据可选", "融资融券模块没有纳入本日核心温度。", False),
    "OPTIONS_UNAVAILABLE": ("期权数据不可用", "期权模块缺少可靠数据，温度已在可用模块之间重新归一化。", False),
    "FAILED_LIMIT_RATE_UNAVAILABLE": ("失败率数据不可用", "涨停后失败率没有可靠数据，Profit Effect 的解读需保守。", False),
    "DATA_INVALID": ("数据不可用", "本日无法通过生产数据门禁，不生成正常市场建议。", True),
}
NO_WATCH = "数据恢复后再查看市场建议。"
EPISODE_OPEN, EPISODE_CLOSED, DASH = "进行中", "已结束", "—"
RANGE_DAYS = {"3M": 92, "6M": 183, "1Y": 366, "All": None}


def label(column: str, labels: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(table[F.col(column)], F.initcap(F.replace(F.col(column), F.lit("_"), F.lit(" "))))


def date_bounds(advisory: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    return advisory.groupBy(*keys).agg(
        F.max(F.when(F.col("advisory_signal") != "DATA_INVALID", F.col("date"))).alias("latest_valid_date"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("date").alias("available_dates")
    )


def resolve_dates(advisory: DataFrame, targets: Sequence[str], keys: Sequence[str] = ("market",)) -> DataFrame:
    """As-of, previous and next available day of each target, clamped to the series' ends.

    One aggregation with a handful of conditional extremes per target; no as-of join is needed.
    """
    day = F.col("date")
    picks = []
    for t in targets:
        at = F.lit(t).cast("date")
        picks.append(
            F.struct(
                at.alias("target"),
                F.coalesce(F.max(F.when(day <= at, day)), F.min(day)).alias("as_of"),
                F.coalesce(F.max(F.when(day < at, day)), F.min(day)).alias("previous"),
                F.coalesce(F.min(F.when(day > at, day)), F.max(day)).alias("following"),
            ).alias(f"_{len(picks)}")
        )
    wide = advisory.groupBy(*keys).agg(*picks)
    return wide.select(*keys, F.explode(F.array(*[F.col(f"_{i}") for i in range(len(picks))])).alias("r")).select(*keys, "r.*")


def daily_cards(advisory: DataFrame, states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Advisory day with display labels, warning meanings and the module scores of its state row."""
    by = [*keys, "trade_date"]
    scores = states.select(*by, *[f"{m}_score" for m in ("breadth", "profit_effect", "liquidity", "stretch")])
    invalid = (F.col("advisory_signal") == "DATA_INVALID") | (F.col("state") == "DATA_INVALID")
    titles = F.create_map(*[x for code, (title, _, _) in WARNING_MEANINGS.items() for x in (F.lit(code), F.lit(title))])
    codes = F.filter(F.split("reason_codes", ";"), lambda c: c != "")
    shown = F.filter(codes, lambda c: c.isin(*WARNING_MEANINGS))
    dash = lambda c: F.when(invalid, DASH).otherwise(F.col(c))
    text = lambda c: F.coalesce(decimals(c, 1), F.lit(DASH))
    return advisory.join(scores, by, "left").select(
        *by, "state", label("state", STATE_LABELS).alias("state_label"), "advisory_signal", label("advisory_signal", SIGNAL_LABELS).alias("advisory_label"),
        text("market_temperature").alias("temperature_text"), text("smoothed_temperature").alias("smoothed_text"),
        dash("buy_reference").alias("buy_reference"), dash("sell_reference").alias("sell_reference"), label("risk_level", RISK_LABELS).alias("risk_label"), label("expected_horizon", HORIZON_LABELS).alias("horizon_label"),
        dash("reference_horizon").alias("reference_horizon"), label("signal_confidence", CONFIDENCE_LABELS).alias("confidence_label"), label("research_evidence", EVIDENCE_LABELS).alias("evidence_label"),
        F.when(invalid, NO_WATCH).otherwise(F.col("what_to_watch_next")).alias("what_to_watch_next"), F.array_join(F.transform(shown, lambda c: titles[c]), ";").alias("warning_titles"),
        flag(F.exists(shown, lambda c: c == "DATA_INVALID")).alias("blocking"), *[text(f"{m}_score").alias(f"{m}_text") for m in ("breadth", "profit_effect", "liquidity", "stretch")], invalid.alias("data_invalid"),
    )


def trend(advisory: DataFrame, range_name: str = "1Y", keys: Sequence[str] = ("market",)) -> DataFrame:
    days = RANGE_DAYS.get(range_name, 366)
    points = advisory.select(*keys, "date", "market_temperature", "smoothed_temperature", "advisory_signal")
    if days is None:
        return points
    newest = F.max("date").over(Window.partitionBy(*keys))
    return points.withColumn("_max", newest).filter(F.col("date") >= F.date_sub("_max", days)).drop("_max")


def last_rows(points: DataFrame, n: int = 40, keys: Sequence[str] = ("market",)) -> DataFrame:
    return points.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("date").desc()))).filter(F.col("_r") <= n).drop("_r")


def episode_cards(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """One card per episode: start, extreme, first watch and confirmation, end when closed, state path."""
    out: DataFrame | None = None
    t = F.col("smoothed_temperature")
    for kind, title, watch, confirmed, lowest in (("panic", "Panic", "ICE_REVERSAL_WATCH", "ICE_REVERSAL", True), ("euphoria", "Euphoria", "HOT_ROLLOVER_WATCH", "HOT_ROLLOVER", False)):
        at = F.when(t.isNotNull(), F.struct(t if lowest else -t, F.col("trade_date")))
        first = lambda cond: F.min(F.when(cond, F.col("trade_date")))
        part = states.filter(F.col(f"{kind}_episode_id").isNotNull()).groupBy(*keys, F.col(f"{kind}_episode_id").alias("episode_id")).agg(
            F.min("trade_date").alias("start_date"), F.min_by("trade_date", at).alias("extreme_date"), (F.min(t) if lowest else F.max(t)).alias("extreme_value"),
            first(F.col("state") == watch).alias("watch_date"), first(F.col("state") == confirmed).alias("confirmed_date"), first(F.col(f"{kind}_episode_closed")).alias("end_date"), F.array_join(ordered_states(), ",").alias("state_sequence"),
        ).withColumns({"episode_type": F.lit(title), "status": F.when(F.col("end_date").isNotNull(), EPISODE_CLOSED).otherwise(EPISODE_OPEN), "extreme_text": F.coalesce(decimals("extreme_value", 1), F.lit(DASH))})
        out = part if out is None else out.unionByName(part)
    return out


def diagnostics(states: DataFrame, advisory: DataFrame, coverage: DataFrame | None = None, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Latest status, coverage, universe and warning titles per market."""
    pick = ["trade_date", "quality", "observed_universe", *(["market_coverage_ratio"] if "market_coverage_ratio" in states.columns else [])]
    latest = states.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.max(F.when(F.col("state") != "DATA_INVALID", F.col("trade_date"))).alias("latest_valid_date"), F.max_by(F.struct(*pick), "trade_date").alias("r")
    ).select(*keys, "row_count", "latest_valid_date", F.col("r.trade_date").alias("latest_calculated_date"), F.col("r.quality").alias("status"), F.col("r.observed_universe").alias("universe"), *([F.col("r.market_coverage_ratio")] if len(pick) > 3 else [F.lit(None).cast("double").alias("market_coverage_ratio")]))
    codes = advisory.select(*keys, F.col("trade_date").alias("latest_valid_date"), "reason_codes")
    out = latest.join(codes, [*keys, "latest_valid_date"], "left")
    if coverage is not None:
        out = out.join(coverage.select(*keys, F.col("trade_date").alias("latest_calculated_date"), "coverage_ratio"), [*keys, "latest_calculated_date"], "left")
    else:
        out = out.withColumn("coverage_ratio", F.lit(None).cast("double"))
    titles = F.create_map(*[x for code, (title, _, _) in WARNING_MEANINGS.items() for x in (F.lit(code), F.lit(title))])
    shown = F.filter(F.split(F.coalesce("reason_codes", F.lit("")), ";"), lambda c: c.isin(*WARNING_MEANINGS))
    value = F.coalesce("coverage_ratio", "market_coverage_ratio")
    return out.select(
        *keys, "status", "latest_valid_date", "latest_calculated_date", "row_count", "universe", F.coalesce(F.concat(decimals(value * 100, 1), F.lit("%")), F.lit(DASH)).alias("coverage_text"), F.array_join(F.transform(shown, lambda c: titles[c]), ";").alias("warning_labels")
    )


def recent_days(df: DataFrame, n: int, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Rows of the last ``n`` distinct trading days. The cutoff comes from the distinct days (one row per
    day), so the large table is only filtered, never ranked."""
    days = df.select(*keys, "trade_date").distinct()
    ranked = days.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("trade_date").desc())))
    cutoff = ranked.filter(F.col("_r") <= n).groupBy(*keys).agg(F.min("trade_date").alias("_cutoff"))
    return df.join(cutoff, list(keys)).filter(F.col("trade_date") >= F.col("_cutoff")).drop("_cutoff")


def previous_weekday(day: Column) -> Column:
    return F.date_sub(day, F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1))


def freshness(panel: DataFrame, now: str, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Whether the panel reaches the previous weekday, and the last day that is safe to download
    (today only on a weekday after 15:30)."""
    at = F.lit(now).cast("timestamp")
    today = at.cast("date")
    closed = F.date_format(at, "HH:mm") >= "15:30"
    weekday = ~F.dayofweek(today).isin(1, 7)
    return panel.groupBy(*keys).agg(F.max("trade_date").alias("latest_date")).select(
        *keys, "latest_date", previous_weekday(today).alias("required_date"), (F.col("latest_date") >= previous_weekday(today)).alias("fresh"), F.when(weekday & closed, today).otherwise(previous_weekday(today)).alias("safe_download_end")
    )


def completeness(tables: Mapping[str, DataFrame], keys: Sequence[str] = ("market",)) -> DataFrame:
    """Row counts of the contract tables per market and whether all of them hold data."""
    counted: DataFrame | None = None
    for name, df in tables.items():
        part = df.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("dataset", F.lit(name))
        counted = part if counted is None else counted.unionByName(part)
    wide = counted.groupBy(*keys).pivot("dataset", list(tables)).agg(F.sum("rows"))
    ready = F.lit(True)
    for name in tables:
        ready = ready & (F.coalesce(F.col(name), F.lit(0)) > 0)
    return wide.na.fill(0).withColumn("ready", ready)


def replace_live_point(points: DataFrame, live: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """The live point replaces the persisted point of the same day."""
    return points.join(live.select(*keys, "date"), [*keys, "date"], "left_anti").unionByName(live.select(*points.columns))
