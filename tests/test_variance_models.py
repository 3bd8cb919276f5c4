import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import models, variance
from tickloom.operators.returns import log_returns

from .conftest import in_order

E = math.e
DAY = dt.date(2024, 3, 1)


def sparse(df, s, overnight):
    got = variance.sparse_rv_calendar(df, [s], overnight).orderBy("index_date")
    return [((r.index_date - DAY).days, pytest.approx(r.rv_sparse)) for r in got.collect()]


def test_sparse_rv_reaches_back_over_night(series):
    df = series([(0, 0, 1.0), (0, 30, E), (1, 0, E), (1, 30, E**2)], "last_price")
    assert sparse(df, 30, "include") == [(0, 1.0), (1, 1.0)]
    assert sparse(df, 30, "exclude") == [(0, 1.0)]
    with pytest.raises(ValueError):
        variance.sparse_rv_calendar(df, [30], "other")


def straightforward(rows, s, include=True):
    """Row by row: drop opening rows of later dates, sample, difference, square."""
    rows = sorted(rows)
    first = {}
    for d, m, _ in rows:
        first.setdefault(d, m)
    kept = [
        (d, p)
        for d, m, p in rows
        if (30 + m) % 60 % s == 0 and (m != first[d] or d == rows[0][0])
    ]
    out = {}
    for (d0, p0), (d1, p1) in zip(kept, kept[1:]):
        if include or d0 == d1:
            out[d1] = out.get(d1, 0.0) + math.log(p1 / p0) ** 2
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sparse_rv_for_all_periods_at_once(series, seed):
    pick = random.Random(seed)
    rows = [
        (d, m, pick.uniform(1, 5))
        for d in range(5)
        for m in sorted(pick.sample(range(391), pick.choice([2, 40, 391])))
    ]
    df = series(random.Random(9).sample(rows, len(rows)), "last_price")
    for overnight in ("include", "exclude"):
        got = variance.sparse_rv_calendar(df, overnight=overnight).collect()
        table = {(r.s_grid, (r.index_date - DAY).days): r.rv_sparse for r in got}
        want = {
            (s, d): v
            for s in range(1, 61)
            for d, v in straightforward(rows, s, overnight == "include").items()
        }
        assert table.keys() == want.keys()
        assert all(table[k] == pytest.approx(want[k]) for k in want)


def test_an_unknown_price_spoils_both_returns_it_touches(series):
    df = series([(0, 0, 1.0), (0, 1, E), (0, 2, None), (0, 3, E), (0, 4, E**3)], "last_price")
    assert sparse(df, 1, "include") == [(0, 1.0 + 4.0)]


def test_exclude_never_exceeds_include(series):
    pick = random.Random(5)
    df = series([(d, m, pick.uniform(1, 5)) for d in range(4) for m in range(391)], "last_price")
    both = variance.sparse_rv_calendar(df, overnight="exclude").withColumnRenamed("rv_sparse", "low").join(
        variance.sparse_rv_calendar(df), ["s_grid", "index_date"]
    )
    assert both.filter("low > rv_sparse + 1e-12").count() == 0


def test_realized_variance_drops_zero_and_unknown(series):
    df = series([(0, 0, None), (0, 1, 0.1), (0, 2, -0.2), (1, 0, None), (1, 1, 0.0), (2, 0, None)], "log_ret")
    rows = variance.realized_variance(df).collect()
    assert [(r.index_date, r.rv) for r in rows] == [(DAY, pytest.approx(0.05))]
    assert rows[0].rv_an == pytest.approx(math.sqrt(252 * 0.05))
    assert variance.realized_variance(df, keep_zero=True).count() == 2


def test_rolled_returns_keep_every_kth_of_the_whole_series(series):
    pick = random.Random(3)
    rows = [(d, m, None if m == 0 else pick.uniform(-1, 1)) for d in range(4) for m in range(50)]
    df = series(rows, "log_ret")
    got = variance.rolling_returns(df, [(5, 1), (5, 3), (10, 10)])
    values = [v for _, _, v in rows]
    for s, k in [(5, 1), (5, 3), (10, 10)]:
        sums = [sum(w) for i in range(len(values)) if None not in (w := values[i + 1 - s : i + 1]) and len(w) == s]
        assert in_order(got.filter(f"s = {s} AND k = {k}"), "ret") == pytest.approx(sums[::k])


def test_rolled_returns_across_dates(series):
    pick = random.Random(6)
    rows = [(d, m, 0.0 if m == 0 else pick.uniform(-1, 1)) for d in range(4) for m in range(50)]
    df = series(rows, "log_ret")
    got = variance.rolling_returns(df, [(5, 1), (10, 10), (30, 7)], across=True)
    values = [v for _, _, v in rows]
    for s, k in [(5, 1), (10, 10), (30, 7)]:
        sums = [sum(values[i + 1 - s : i + 1]) for i in range(s - 1, len(values))]
        assert in_order(got.filter(f"s = {s} AND k = {k}"), "ret") == pytest.approx(sums[::k])
    assert got.filter("s = 10").count() == 20
    with pytest.raises(Exception, match="does not open with NULL"):
        variance.rolling_returns(df, [(10, 10)]).collect()


def test_wide_table_equals_the_chain_of_joins(series):
    pick = random.Random(4)
    df = series([(d, m, None if m == 0 else pick.uniform(-1, 1)) for d in range(3) for m in range(20)], "log_ret")
    rv, long = variance.realized_variance(df), variance.sparse_rv_rolling(df)
    wide = variance.estimators_by_date(rv, long).orderBy("index_date")
    assert wide.collect() == variance.estimators_by_joins(rv, long).orderBy("index_date").collect()
    assert {r.s: r.minutes for r in variance.signature_wide(wide).collect()} == {
        "s1": 1, "s5": 5, "s10": 10, "s15": 15, "s30": 30,
    }


def daily(spark, values):
    return spark.createDataFrame(
        [(DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "date date, x double"
    )


def test_acf_of_a_short_series(spark):
    got = {r.lag: r.acf for r in variance.acf(daily(spark, [1, 2, 3, 4]), "x", "date", 3).collect()}
    assert got[1] == pytest.approx(0.25) and got[2] == pytest.approx(-0.3)


def test_acf_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=200).cumsum()
    got = {r.lag: r.acf for r in variance.acf(daily(spark, x), "x", "date", 100).collect()}
    d = x - x.mean()
    want = {k: float((d[:-k] * d[k:]).sum() / (d * d).sum()) for k in range(1, 101)}
    assert got == pytest.approx(want)


def test_smooth_is_a_centred_mean(spark):
    got = models.trend_smooth(daily(spark, [1, 2, 6, 3]), "x", "date", 1).orderBy("date").collect()
    assert [r.smooth for r in got] == pytest.approx([1.5, 3, 11 / 3, 4.5])


def test_har_fit_against_numpy(spark):
    x = np.exp(np.random.default_rng(2).normal(size=120).cumsum() / 10)
    features = models.har_features(daily(spark, x), "x", "date")
    ln = lambda a, b: np.array([np.log(x[i + a : i + b].mean()) for i in range(20, 99)])
    design = np.column_stack([np.ones(79), ln(0, 1), ln(-4, 1), ln(-20, 1)])
    want, *_ = np.linalg.lstsq(design, ln(1, 22), rcond=None)
    got = {r.term: r.estimate for r in models.har_fit(features).collect()}
    assert [got[t] for t in ("(Intercept)", "ln_rv_d", "ln_rv_w", "ln_rv_m")] == pytest.approx(list(want), abs=1e-8)


def test_moments(series):
    r = [0.1, -0.2, 0.3]
    row = models.realized_moments(series([(0, i, v) for i, v in enumerate(r)], "log_ret")).first()
    rv = sum(v * v for v in r)
    assert row.rv == pytest.approx(rv)
    assert row.rskew == pytest.approx(math.sqrt(3) * sum(v**3 for v in r) / rv**1.5)
    assert row.rkurt == pytest.approx(3 * sum(v**4 for v in r) / rv**2)


def test_premium_is_in_daily_variance(spark):
    df = spark.createDataFrame([(20.0, 0.0001)], "iv double, rv double")
    row = models.variance_risk_premium(df).first()
    assert row.iv_var == pytest.approx(0.04 / 252) and row.vrp == pytest.approx(0.04 / 252 - 0.0001)


def test_returns_of_a_date_add_up(series):
    pick = random.Random(8)
    prices = [(d, m, pick.uniform(1, 9)) for d in range(3) for m in range(100)]
    sums = (
        log_returns(series(prices, "last_price"))
        .groupBy("index_date")
        .agg(
            F.sum("log_ret").alias("total"),
            F.min_by("last_price", "index_time").alias("a"),
            F.max_by("last_price", "index_time").alias("b"),
        )
    )
    assert all(r.total == pytest.approx(math.log(r.b / r.a)) for r in sums.collect())


def test_local_trend_follows_lines_and_skips_gaps(spark):
    start = dt.date(2024, 1, 1)
    days = [0, 1, 2, 5, 6, 9, 12, 13, 30]
    rows = [("line", start + dt.timedelta(days=d), 3.0 + 2 * d) for d in days]
    rows += [("gap", start + dt.timedelta(days=d), None if d == 5 else float(d)) for d in days]
    rows += [("one", start, 4.0), ("none", start, None), ("same", start, 1.0), ("same", start, 3.0)]
    df = spark.createDataFrame(rows, "k string, date date, v double")
    found = {}
    for r in models.local_trend(df, "v", "date", 3, ["k"]).collect():
        found.setdefault(r.k, []).append((r.date, r.trend))
    for d, trend in found["line"]:
        assert abs(trend - (3 + 2 * (d - start).days)) < 1e-9
    for d, trend in found["gap"]:
        assert abs(trend - (d - start).days) < 1e-9
    assert found["one"] == [(start, 4.0)] and found["none"] == [(start, None)] and [t for _, t in found["same"]] == [2.0, 2.0]
