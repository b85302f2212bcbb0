"""Descriptive tables over the state table: transitions, runs, episodes, whipsaw, parameter sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import changed_from_previous, count_true, flag, island_id, ordered
from .state_machine import STATES

CONFIRMED = ("ICE_REVERSAL_CONFIRMED", "HOT_ROLLOVER_CONFIRMED")
WATCHES = ("ICE_REVERSAL_WATCH", "HOT_ROLLOVER_WATCH")
EPISODE_KINDS = (
    ("panic", "post_panic_low", "PANIC_FALLING,EXTREME_PANIC,ICE_REVERSAL_WATCH,ICE_REVERSAL"),
    ("euphoria", "post_euphoria_high", "EUPHORIA_RISING,HOT_ROLLOVER_WATCH,HOT_ROLLOVER"),
)


def _long(keys: Sequence[str], pairs: Sequence[tuple[str, Column, Column | None]]) -> list[Column]:
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("bigint").alias("count"), (F.lit(None).cast("double") if r is None else r.cast("double")).alias("rate")) for m, c, r in pairs])
    return [*[F.col(k) for k in keys], F.explode(rows).alias("_m")]


def metrics(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, Column, Column | None]]) -> DataFrame:
    return df.select(*_long(keys, pairs)).select(*keys, "_m.*")


def transition_matrix(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Counts for every (previous, current) pair, zero cells and the initial NONE row included."""
    counts = states.groupBy(*keys, "previous_state", "state").agg(F.count("*").alias("_n"))
    grid = (
        counts.select(*keys).distinct()
        .withColumn("previous_state", F.explode(F.array(*[F.lit(s) for s in (*STATES, "NONE")])))
        .withColumn("state", F.explode(F.array(*[F.lit(s) for s in STATES])))
    )
    return grid.join(counts, [*keys, "previous_state", "state"], "left").select(*keys, "previous_state", "state", F.coalesce("_n", F.lit(0)).alias("transitions"))


def runs(states: DataFrame, keys: Sequence[str] = ("market",), column: str = "state") -> DataFrame:
    numbered = states.withColumn("_new", changed_from_previous(column, keys)).withColumn("run", island_id(F.col("_new"), keys))
    return numbered.groupBy(*keys, "run", column).agg(F.count("*").alias("duration"), F.min("trade_date").alias("start"), F.max("trade_date").alias("end"))


def state_statistics(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Share, run count and run lengths per state; states that never occur keep a zero row."""
    found = runs(states, keys).groupBy(*keys, "state").agg(
        F.sum("duration").alias("count"), F.count("*").alias("number_of_episodes"), F.percentile("duration", F.lit(0.5)).alias("median_duration"), F.max("duration").alias("max_duration")
    )
    totals = states.groupBy(*keys).agg(F.count("*").alias("_total")).withColumn("state", F.explode(F.array(*[F.lit(s) for s in STATES])))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return totals.join(found, [*keys, "state"], "left").select(
        *keys, "state", zero("count").alias("count"), (zero("count") / F.col("_total")).alias("percentage"), zero("number_of_episodes").alias("number_of_episodes"),
        F.coalesce("median_duration", F.lit(0.0)).alias("median_duration"), zero("max_duration").alias("max_duration"),
    )


def signal_statistics(states: DataFrame, keys: Sequence[str] = ("market",), by_state: bool = False) -> DataFrame:
    """Signal counts and watch-to-confirm/timeout rates. A watch episode starts where the watch *signal*
    rises, or with ``by_state`` where the watch *state* does (a first row never counts there)."""
    watching = F.col("state" if by_state else "signal").isin(*WATCHES)
    previous = F.lag(watching).over(ordered(keys))
    edge = watching & ~F.coalesce(previous, F.lit(by_state))
    s = F.col("signal")
    base = states.withColumn("_edge", edge).groupBy(*keys).agg(
        count_true(F.col("_edge")).alias("w"),
        count_true(s.isin(*CONFIRMED)).alias("c"),
        count_true(F.col("watch_timeout")).alias("t"),
        *[count_true(s == n).alias(f"n{i}") for i, n in enumerate((WATCHES[0], CONFIRMED[0], WATCHES[1], CONFIRMED[1]))],
    )
    denominator = F.greatest(F.col("w"), F.lit(1)).cast("double")
    return metrics(
        base, keys,
        [
            ("ICE_REVERSAL_WATCH_count", F.col("n0"), None), ("ICE_REVERSAL_confirmed_count", F.col("n1"), None),
            ("HOT_ROLLOVER_WATCH_count", F.col("n2"), None), ("HOT_ROLLOVER_confirmed_count", F.col("n3"), None),
            ("watch_episodes", F.col("w"), None), ("confirmed_episodes", F.col("c"), None),
            ("watch_to_confirm_rate", F.col("c"), F.col("c") / denominator), ("watch_timeout_count", F.col("t"), None), ("watch_timeout_rate", F.col("t"), F.col("t") / denominator),
        ],
    )


def ordered_states(date: str = "trade_date", state: str = "state") -> Column:
    """Distinct states of a group in order of first appearance; a group is one episode's days."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(state).alias("s"))))
    return F.array_distinct(F.transform(pairs, lambda x: x["s"]))


def episode_table(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    out: DataFrame | None = None
    for kind, _, family in EPISODE_KINDS:
        number = f"{kind}_episode_id"
        dates = F.array_sort(F.collect_list(F.when(F.col(f"{kind}_anchor_event"), F.date_format("trade_date", "yyyy-MM-dd"))))
        part = states.filter(F.col(number).isNotNull()).groupBy(*keys, F.col(number).alias("episode_id")).agg(
            F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count("*").alias("duration_valid_observations"), F.max(f"{kind}_episode_age").alias("max_age"),
            F.array_join(dates, ",").alias("anchor_dates"), F.max(f"{kind}_module_count").alias("max_extreme_module_count"), F.array_join(ordered_states(), ",").alias("states_seen"),
            F.min(F.when(F.col("signal").isin(*CONFIRMED), F.col("trade_date"))).alias("confirmed_date"),
        ).withColumns({"episode_type": F.lit(kind), "confirmed": F.col("confirmed_date").isNotNull(), "target_state_family": F.lit(family)})
        out = part if out is None else out.unionByName(part)
    return out


def episode_frequency(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    base = states.groupBy(*keys, F.year("trade_date").alias("year")).agg(
        F.count_distinct("panic_episode_id").alias("p"), F.count_distinct("euphoria_episode_id").alias("e"),
        count_true(F.col("signal") == CONFIRMED[0]).alias("i"), count_true(F.col("signal") == CONFIRMED[1]).alias("h"),
    )
    named = (("panic_episode_count", "p"), ("euphoria_episode_count", "e"), ("ice_reversal_confirmed_count", "i"), ("hot_rollover_confirmed_count", "h"))
    return metrics(base, [*keys, "year"], [(m, F.col(c), None) for m, c in named]).drop("rate")


def _short_runs(next_state: str) -> list[Column]:
    """Runs of one and up to two days, counted on the last row of each run."""
    last = ~F.col("state").eqNullSafe(F.col(next_state))
    return [count_true(last & (F.col("state_duration") <= n)).alias(f"r{n}") for n in (1, 2)]


def whipsaw(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """State changes, short runs, HOT/COLD-NORMAL crossings (by previous row) and watch exits."""
    before, after = F.lag("state").over(ordered(keys)), F.lead("state").over(ordered(keys))
    st = F.col("state")
    crossing = lambda a: flag(((st == a) & (F.col("_b") == "NORMAL")) | ((st == "NORMAL") & (F.col("_b") == a)))
    exits = lambda w: (st == w) & ~F.coalesce(F.col("_a").isin(w, "ICE_REVERSAL", "HOT_ROLLOVER"), F.lit(False))
    marked = states.withColumns({"_b": before, "_a": after})
    base = marked.groupBy(*keys).agg(
        count_true(~st.eqNullSafe(F.col("_b"))).alias("c"), count_true(crossing("HOT")).alias("h"), count_true(crossing("COLD")).alias("k"),
        count_true(exits(WATCHES[0])).alias("iw"), count_true(exits(WATCHES[1])).alias("hw"), *_short_runs("_a"),
    )
    named = (
        ("state_changes", "c"), ("state_changes_within_1_day", "r1"), ("state_changes_within_2_day", "r2"), ("HOT_NORMAL_transitions", "h"), ("COLD_NORMAL_transitions", "k"),
        ("ICE_REVERSAL_WATCH_watch_exits", "iw"), ("HOT_ROLLOVER_WATCH_watch_exits", "hw"),
    )
    return metrics(base, keys, [(m, F.col(c), None) for m, c in named]).drop("rate")


def whipsaw_legacy(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Earlier variant: crossings by next row; a watch on the last row is not an exit."""
    st, nxt = F.col("state"), F.col("_a")
    marked = states.withColumn("_a", F.lead("state").over(ordered(keys)))
    crossing = lambda a: flag(((st == a) & (nxt == "NORMAL")) | ((st == "NORMAL") & (nxt == a)))
    exits = lambda w: flag((st == w) & nxt.isNotNull() & ~nxt.isin(w, "ICE_REVERSAL", "HOT_ROLLOVER"))
    base = marked.groupBy(*keys).agg(count_true(crossing("HOT")).alias("h"), count_true(crossing("COLD")).alias("k"), count_true(exits(WATCHES[0])).alias("iw"), count_true(exits(WATCHES[1])).alias("hw"), *_short_runs("_a"))
    named = (
        ("state_changes_within_1_day", "r1"), ("state_changes_within_2_day", "r2"), ("HOT_to_NORMAL_or_back", "h"), ("COLD_to_NORMAL_or_back", "k"),
        ("ICE_REVERSAL_WATCH_to_NONE_or_back", "iw"), ("HOT_ROLLOVER_WATCH_to_NONE_or_back", "hw"),
    )
    return metrics(base, keys, [(m, F.col(c), None) for m, c in named]).drop("rate")


def whipsaw_lags(states: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Changes against the row one and two days back with both days valid, plus named pairs."""
    st = F.col("state")
    marked = states.withColumns({f"_l{n}": F.lag("state", n).over(ordered(keys)) for n in (1, 2)})
    moved = lambda n: flag((st != "DATA_INVALID") & (F.col(f"_l{n}") != "DATA_INVALID") & (st != F.col(f"_l{n}")))
    pairs = (("HOT", "NORMAL"), ("NORMAL", "HOT"), ("COLD", "NORMAL"), ("NORMAL", "COLD"), (WATCHES[0], "NONE"), (WATCHES[1], "NONE"))
    base = marked.groupBy(*keys).agg(
        *[count_true(moved(n)).alias(f"d{n}") for n in (1, 2)], *[count_true((F.col("previous_state") == a) & (st == b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    named = [("1", F.col("d1"), None), ("2", F.col("d2"), None)] + [(f"pair:{a}->{b}", F.col(f"p{i}"), None) for i, (a, b) in enumerate(pairs)]
    warning = F.when(F.col("metric").startswith("pair:"), "DESCRIPTIVE").when(F.col("count") > 20, "Review for possible hysteresis layer").otherwise("NO_SEVERE_WHIPSAW_FLAG")
    return metrics(base, keys, named).drop("rate").withColumn("warning", warning)


def sensitivity(states: DataFrame, keys: Sequence[str] = ("market",), baseline: str = "default") -> DataFrame:
    """One row per parameter set: counts, durations and the overlap of its confirmation dates with the
    baseline's. ``states`` holds all sets at once, keyed by ``variant_id``, and is read in one pass.

    Episode ids count up from one within a series, so their maximum is the number of episodes.
    """
    by = [*keys, "variant_id"]
    confirmed = F.col("signal").isin(*CONFIRMED)
    per_state = states.groupBy(*by, "state").agg(
        F.max("panic_episode_id").alias("p"), F.max("euphoria_episode_id").alias("e"),
        *[count_true(F.col("signal") == n).alias(f"n{i}") for i, n in enumerate((WATCHES[0], CONFIRMED[0], WATCHES[1], CONFIRMED[1]))],
        count_true(F.col("state_changed")).alias("x"), F.avg("state_duration").alias("m"),
        F.collect_list(F.when(confirmed, F.date_format("trade_date", "yyyy-MM-dd"))).alias("d"),
    )
    totals = per_state.groupBy(*by).agg(
        F.coalesce(F.max("p"), F.lit(0)).alias("panic_episode_count"), F.coalesce(F.max("e"), F.lit(0)).alias("euphoria_episode_count"),
        *[F.sum(f"n{i}").alias(n) for i, n in enumerate(("ice_watch_count", "ice_confirmed_count", "hot_watch_count", "hot_confirmed_count"))],
        F.sum("x").alias("state_changes"), F.avg("m").alias("average_state_duration"), F.array_sort(F.flatten(F.collect_list("d"))).alias("_dates"),
    )
    base = F.max(F.when(F.col("variant_id") == baseline, F.col("_dates"))).over(Window.partitionBy(*keys))
    paired = totals.withColumn("_base", F.coalesce(base, F.array().cast("array<string>"))).withColumns(
        {"_both": F.size(F.array_intersect("_dates", "_base")), "_union": F.size(F.array_union("_dates", "_base"))}
    )
    stability = F.when(F.col("_union") > 0, F.col("_both") / F.nullif(F.col("_union").cast("double"), F.lit(0.0))).otherwise(1.0)
    watches = F.greatest(F.col("ice_watch_count") + F.col("hot_watch_count"), F.lit(1))
    return paired.withColumn("confirmed_date_stability", stability).withColumns(
        {
            "watch_to_confirm_rate": (F.col("ice_confirmed_count") + F.col("hot_confirmed_count")) / watches,
            "sensitivity_flag": F.when((F.col("_union") > 0) & (F.col("confirmed_date_stability") < 0.80), "THRESHOLD_SENSITIVE").otherwise("STABLE_NEARBY"),
            "confirmed_dates": F.array_join("_dates", ","),
        }
    ).drop("_both", "_union", "_dates", "_base")


def extremes(states: DataFrame, n: int = 10, reach: int = 5, keys: Sequence[str] = ("market",), value: str = "smoothed_temperature") -> DataFrame:
    """The ``n`` hottest and coldest valid days per market, each with the rows within ``reach`` positions.

    Ranks come from a window over the daily series; the neighbourhood is fetched by exploding the wanted
    positions of the few picked days and joining on the exact position, not by a range join.
    """
    placed = states.withColumn("position", F.row_number().over(ordered(keys)))
    w = lambda direction: Window.partitionBy(*keys).orderBy(direction, "trade_date")
    valid = placed.filter((F.col("state") != "DATA_INVALID") & F.col(value).isNotNull())
    ranked = valid.withColumns({"_hot": F.row_number().over(w(F.col(value).desc())), "_cold": F.row_number().over(w(F.col(value).asc()))})
    picked = ranked.filter((F.col("_hot") <= n) | (F.col("_cold") <= n)).select(
        *keys, F.col("trade_date").alias("event_date"), F.col("position").alias("_at"),
        F.explode(F.array_compact(F.array(F.when(F.col("_hot") <= n, F.struct(F.lit("hottest").alias("kind"), F.col("_hot").alias("rank"))), F.when(F.col("_cold") <= n, F.struct(F.lit("coldest").alias("kind"), F.col("_cold").alias("rank")))))).alias("k"),
    )
    wanted = picked.select(*keys, "k.kind", "k.rank", "event_date", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset"), "_at").withColumn("position", F.col("_at") + F.col("offset")).drop("_at")
    return wanted.join(placed.select(*keys, "position", "trade_date", "raw_temperature", value, "state", "signal"), [*keys, "position"])


def top_days(states: DataFrame, n: int = 10, keys: Sequence[str] = ("market",), value: str = "smoothed_temperature") -> DataFrame:
    """The ``n`` hottest and coldest valid days of each market with their ``kind`` and ``rank``; earlier days win ties."""
    valid = states.filter((F.col("state") != "DATA_INVALID") & F.col(value).isNotNull())
    sides = []
    for kind, direction in (("hottest", F.col(value).desc()), ("coldest", F.col(value).asc())):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(direction, "trade_date"))
        sides.append(valid.withColumns({"kind": F.lit(kind), "rank": place}).filter(F.col("rank") <= n))
    return sides[0].unionByName(sides[1])


def episode_audit(episodes: DataFrame, targets: Sequence[str], fill_to: int = 5, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Per market and kind: the episode starting nearest to each target day, then earliest others up to ``fill_to``."""
    by = [*keys, "episode_type"]
    spread = episodes.withColumn("target", F.explode(F.array(*[F.lit(t).cast("date") for t in targets])))
    nearest = spread.groupBy(*by, "target").agg(F.min_by("episode_id", F.struct(F.abs(F.date_diff("start_date", "target")), F.col("episode_id"))).alias("episode_id"))
    hits = nearest.groupBy(*by, "episode_id").agg(F.min("target").alias("target"))
    tagged = episodes.join(hits, [*by, "episode_id"], "left")
    w = Window.partitionBy(*by).orderBy(F.col("target").isNull(), "start_date", "episode_id")
    return tagged.withColumn("pick", F.row_number().over(w)).filter(F.col("target").isNotNull() | (F.col("pick") <= fill_to))
