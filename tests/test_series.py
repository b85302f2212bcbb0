"""Window helpers against hand values and brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from conftest import frame, values

from tidegauge.functions import series as sr
from tidegauge.params import Percentile

START = dt.date(2024, 1, 1)


def series(spark, xs, market="M"):
    return frame(spark, "market string, trade_date date, x double", [(market, START + dt.timedelta(days=i), None if x is None else float(x)) for i, x in enumerate(xs)])


def test_ema_skips_invalid_rows(spark):
    got = values(sr.add_valid_ema(series(spark, [10, 12, None, 16]), "e", "x", ["market"], 2), "e")
    assert got[2] is None
    assert np.allclose([got[0], got[1], got[3]], [10, 34 / 3, 14.444444444])


@pytest.mark.parametrize("span", [1, 2, 3, 5])
def test_ema_equals_plain_recursion(spark, span):
    rng = np.random.default_rng(1)
    xs = [None if rng.random() < 0.2 else float(v) for v in rng.uniform(0, 100, 200)]
    got = values(sr.add_valid_ema(series(spark, xs), "e", "x", ["market"], span), "e")
    alpha, previous = 2 / (span + 1), None
    for x, g in zip(xs, got):
        if x is None:
            assert g is None
            continue
        previous = x if previous is None else alpha * x + (1 - alpha) * previous
        assert abs(previous - g) < 1e-12


def test_valid_lag_and_extremes(spark):
    df = series(spark, [10, None, 12, 8, 14]).withColumns({"lag": sr.valid_lag("x", ["market"], 3), "hi": sr.valid_extreme("x", ["market"], 3, True), "lo": sr.valid_extreme("x", ["market"], 3, False)})
    assert values(df, "lag") == [None, None, None, None, 10.0]
    assert values(df, "hi")[4] == 14.0 and values(df, "lo")[4] == 8.0 and values(df, "hi")[1] is None


def test_percentile_against_brute_force_and_prefix(spark):
    rng = np.random.default_rng(2)
    xs = [None if rng.random() < 0.1 else float(v) for v in rng.integers(0, 12, 120)]
    score = lambda data: values(series(spark, data).withColumn("p", sr.mid_rank_percentile("x", ["market"], 30, 10)), "p")
    got = score(xs)
    for i, x in enumerate(xs):
        window = [v for v in xs[max(0, i - 29) : i + 1] if v is not None]
        want = None if x is None or len(window) < 10 else (sum(v < x for v in window) + 0.5 * sum(v == x for v in window)) / len(window) * 100
        assert got[i] == want
    assert score(xs[:80]) == got[:80]
    with pytest.raises(ValueError):
        Percentile(5, 6)


def test_winsorize_and_degenerate_against_pandas(spark):
    rng = np.random.default_rng(3)
    xs = [float(v) for v in rng.normal(size=60)] + [1.0] * 25
    df = series(spark, xs).withColumns({"w": sr.trailing_winsorize("x", ["market"], 20, 5, 0.1, 0.9), "d": sr.degenerate_mask("x", ["market"], 20, 2, 5, 1e-12)})
    s = pd.Series(xs)
    r = s.rolling(20, min_periods=5)
    want = s.clip(lower=r.quantile(0.1), upper=r.quantile(0.9))
    assert np.allclose(values(df, "w"), want)
    d = values(df, "d")
    assert d[0] and not d[30] and d[-1]


@pytest.mark.parametrize("gap", [None, 3, 20])
def test_wilder_mean(spark, gap):
    from pyspark.sql import functions as F

    n = 5
    rng = np.random.default_rng(4)
    xs = [None] + [float(v) for v in rng.uniform(1, 5, 60)]
    if gap is not None:
        xs[gap] = None
    df = series(spark, xs).withColumn("pos", F.row_number().over(sr.ordered(["market"])) - 1)
    df = sr.add_wilder_means(df, {"m": ("x", n)}, "pos", ["market"])
    got = values(df, "m")
    want = [None] * len(xs)
    want[n] = float(np.mean([x for x in xs[1 : n + 1] if x is not None]))
    for i in range(n + 1, len(xs)):
        want[i] = None if want[i - 1] is None or xs[i] is None else (want[i - 1] * (n - 1) + xs[i]) / n
    for g, w in zip(got, want):
        assert (g is None) == (w is None) and (w is None or abs(g - w) < 1e-12)


def test_long_flat_tail_keeps_the_ratio_of_averages(spark):
    """15 rises, 20 falls, then 600 equal closes: gains and losses fade together, so the index must stay where it was."""
    n, closes = 14, [100.0]
    for step in [1.0] * 15 + [-1.3] * 20 + [0.0] * 600:
        closes.append(closes[-1] + step)
    gains = [None, *[max(b - a, 0.0) for a, b in zip(closes, closes[1:])]]
    losses = [None, *[max(a - b, 0.0) for a, b in zip(closes, closes[1:])]]

    def plain(xs):
        out, mean = [], None
        for i, x in enumerate(xs):
            mean = None if i < n else sum(xs[1 : n + 1]) / n if i == n else (mean * (n - 1) + x) / n
            out.append(mean)
        return out

    df = spark.createDataFrame([("M", i, g, x) for i, (g, x) in enumerate(zip(gains, losses))], "market string, trade_date int, g double, l double")
    got = sr.add_wilder_means(df, {"g": ("g", n), "l": ("l", n)}, "trade_date", ["market"]).orderBy("trade_date").collect()
    for row, g, x in zip(got, plain(gains), plain(losses)):
        assert (row.g is None) == (g is None)
        if g is not None:
            assert row.g == pytest.approx(g, rel=1e-9, abs=0) and row.l == pytest.approx(x, rel=1e-9, abs=0)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 129, 5000])
def test_recursive_scan_equals_the_loop_to_the_last_bit(spark, n):
    """Three series of different length, one of them of key NULL; blocks left unfinished; two recurrences at once."""
    rng = np.random.default_rng(n)
    rows = [(m, i, float(rng.normal())) for m, size in (("M", n), ("N", n // 2 + 1), (None, 70)) for i in range(size)]
    df = frame(spark, "market string, trade_date int, x double", rows)
    steps = {"mean": (F.col("x"), lambda y, x: F.when(y.isNull(), x).otherwise((y * 13.0 + x) / 14.0)), "total": (F.col("x"), lambda y, x: F.coalesce(y, F.lit(0.0)) + x)}
    got = {(r.market, r.trade_date): (r.mean, r.total) for r in sr.recursive_scan(df, steps, ["market"]).collect()}
    mean, total = {}, {}
    for m, i, x in rows:
        mean[m] = (mean[m] * 13.0 + x) / 14.0 if m in mean else x
        total[m] = total.get(m, 0.0) + x
        assert got[m, i] == (mean[m], total[m]), (m, i)
    assert len(got) == len(rows)
