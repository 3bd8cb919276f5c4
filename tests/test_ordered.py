import random

import pytest
from pyspark.sql import Window, functions as F

from tickloom.operators import ordered
from tickloom.operators.ordered import Axis

from .conftest import in_order


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([(0, 0, None), (0, 1, None), (0, 2, 10.0), (0, 3, None), (0, 4, 12.0), (0, 5, None)],
         [10, 10, 10, 10, 12, 12]),
        ([(0, 0, 10.0), (0, 1, 11.0), (1, 0, None), (1, 1, 12.0)], [10, 11, 11, 12]),
        ([(0, 0, 10.0), (1, 0, None), (1, 1, None), (2, 0, None), (2, 1, 13.0)], [10, 10, 10, 10, 13]),
        ([(0, 0, None), (0, 1, None), (1, 0, None), (1, 1, 7.0)], [7, 7, 7, 7]),
        ([(0, 0, None), (1, 0, None)], [None, None]),
    ],
)
def test_fill_forward(series, rows, wanted):
    assert in_order(ordered.fill_forward(series(rows), "x"), "x") == wanted


def random_rows(seed, gaps=True):
    pick = random.Random(seed)
    rows = []
    for day in range(12):
        minutes = sorted(pick.sample(range(391), pick.choice([1, 5, 60])))
        rows += [(day, m, None if gaps and pick.random() < 0.4 else pick.uniform(1, 9)) for m in minutes]
    pick.shuffle(rows)
    return rows


WHOLE = ("index_date", "index_time")


def test_fill_forward_equals_one_window_over_everything(series):
    df = series(random_rows(1))
    w = Window.orderBy(*WHOLE)
    naive = F.coalesce(
        F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.first("x", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    )
    assert in_order(ordered.fill_forward(df, "x"), "x") == in_order(df.withColumn("x", naive), "x")


def test_lag_equals_one_window_over_everything(series):
    df = series(random_rows(2))
    naive = df.withColumn("p", F.lag("x").over(Window.orderBy(*WHOLE)))
    assert in_order(ordered.lag_rows(df, {"p": "x"}), "p") == in_order(naive, "p")


def test_row_numbers_have_no_gaps(series):
    df = series(random_rows(3))
    numbered = in_order(ordered.number_rows(df, "n"), "n")
    assert numbered == list(range(1, len(numbered) + 1))


def test_rows_can_be_counted_on_a_condition(series):
    df = series([(0, 0, 1.0), (0, 1, None), (1, 0, 2.0), (2, 0, None), (2, 1, 3.0)])
    got = ordered.number_rows(df, "n", where=F.col("x").isNotNull())
    assert in_order(got, "n") == [1, 1, 2, 2, 3]


def test_every_kth_row_drifts_over_dates(series):
    df = series([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0)])
    assert in_order(ordered.every_kth_row(df, 2), "x") == [1, 3, 5]
    drift = series([(0, 0, 1.0), (1, 0, 2.0), (1, 1, 3.0), (2, 0, 4.0)])
    assert in_order(ordered.every_kth_row(drift, 2), "x") == [1, 3]


def test_rolling_sum_needs_all_rows(series):
    df = series([(0, m, v) for m, v in enumerate([None, 1.0, 2.0, 3.0, 4.0])])
    assert in_order(ordered.rolling_sum(df, "x", 3, "s"), "s") == [None, None, None, 6, 9]


@pytest.mark.parametrize("period, block", [(3, 5), (7, 7), (10, 4), (30, 64)])
def test_rolling_sum_across_equals_one_window_over_everything(series, period, block):
    df = series(random_rows(4, gaps=False))
    w = Window.orderBy(*WHOLE).rowsBetween(1 - period, 0)
    naive = df.withColumn("s", F.when(F.count("x").over(w) == period, F.sum("x").over(w)))
    got = in_order(ordered.rolling_sum_across(df, "x", period, "s", block=block), "s")
    want = in_order(naive, "s")
    assert [g is None for g in got] == [v is None for v in want]
    assert [g for g in got if g is not None] == pytest.approx([v for v in want if v is not None])


def test_keys_are_separate_series(spark, series):
    a, b = series(random_rows(5)), series(random_rows(6))
    both = a.withColumn("k", F.lit("a")).unionByName(b.withColumn("k", F.lit("b")))
    axis = Axis(keys=("k",))
    for build in (
        lambda df, ax: ordered.fill_forward(df, "x", ax),
        lambda df, ax: ordered.lag_rows(df, {"y": "x"}, ax),
        lambda df, ax: ordered.number_rows(df, "y", ax),
        lambda df, ax: ordered.every_kth_row(df, 3, ax),
    ):
        keyed = build(both, axis)
        for name, alone in (("a", a), ("b", b)):
            one = build(alone, ordered.MINUTES)
            columns = [c for c in one.columns]
            assert in_order(keyed.filter(F.col("k") == name), *columns) == in_order(one, *columns)


def test_other_segments_work_the_same(spark):
    rows = [(i // 7, i, float(i % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "seg int, pos int, x double")
    axis = Axis(segment="seg", order=("pos",))
    got = ordered.lag_rows(df, {"p": "x"}, axis).orderBy("pos").select("p").collect()
    assert [r[0] for r in got] == [None] + [float(i % 5) for i in range(49)]
