import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import returns, volume
from tickloom.operators.grid import with_index

from .conftest import in_order

E = math.e
PRICES = [(0, 0, 1.0), (0, 1, E), (1, 0, E), (1, 1, 1.0)]


@pytest.mark.parametrize(
    "rule, wanted",
    [("null", [None, 1, None, -1]), ("zero", [0, 1, 0, -1]), ("include", [None, 1, 0, -1])],
)
def test_overnight_rules(series, rule, wanted):
    df = returns.log_returns(series(PRICES, "last_price"), overnight=rule)
    got = in_order(df, "log_ret")
    assert [g is None for g in got] == [w is None for w in wanted]
    assert [g or 0 for g in got] == pytest.approx([w or 0 for w in wanted])


def test_unknown_overnight_rule(series):
    with pytest.raises(ValueError):
        returns.log_returns(series(PRICES, "last_price"), overnight="other")


def test_overnight_steps_agree_with_the_rules(series):
    moved = returns.log_returns(series(PRICES, "last_price"), overnight="include")
    flagged = returns.date_change(moved)
    assert in_order(returns.overnight_to_null(flagged), "log_ret") == [None, 1, None, -1]
    assert in_order(returns.overnight_to_zero(flagged), "log_ret") == [0, 1, 0, -1]


def test_date_change_is_unknown_on_the_first_row(series):
    df = series([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)])
    assert in_order(returns.date_change(df), "date_change") == [None, False, True]
    assert in_order(returns.day_change(df), "day_change") == [None, 0, 1]


def test_diff_counts_seconds_across_dates(series):
    df = with_index(series([(0, 0, 1.0), (0, 5, 1.0), (1, 0, 1.0)]))
    assert in_order(returns.lag_diff(df), "diff") == [None, 300, 86400 - 300]


def test_signature_agrees_with_its_parts(series):
    df = series([(0, 0, 1.0), (0, 5, 1.0), (3, 0, 1.0)])
    signature = returns.time_signature(df)
    assert in_order(signature, "diff") == in_order(returns.lag_diff(with_index(df)), "diff")
    assert in_order(signature, "date_change") == [None, False, True]


def test_volume_delta(series):
    rows = list(zip([0] * 5 + [1] * 2, [0, 1, 2, 3, 4, 0, 1], [0, 5, 5, 3, 9, 4, 6]))
    df = series(rows, "volume", "bigint")
    assert in_order(volume.volume_delta(df), "new_volume") == [5, 6, 4, 2]
    assert in_order(volume.volume_delta_within(df), "new_volume") == [5, 0, -2, 6, 2]
    assert in_order(volume.volume_anomalies(df), "volume") == [3]


def test_means_by_half_hour_week_and_weekday(series):
    df = series([(0, 0, 10), (0, 29, 20), (0, 30, 40), (3, 390, 60)], "new_volume", "bigint")
    halves = [(r.subgrid, r.mean_volume) for r in volume.mean_by_half_hour(df).collect()]
    assert halves == [(13, 60.0), (2, 40.0), (1, 15.0)]
    weeks = [(r.week, r.average_volume) for r in volume.mean_by_week(df).collect()]
    assert weeks == [(10, 60.0), (9, pytest.approx(70 / 3))]
    days = [(r.wday, r.wday_label) for r in volume.mean_by_weekday(df).collect()]
    assert days == [(1, "Mon"), (5, "Fri")]


def test_half_hour_mean_pad(series):
    ticks = series([(0, 0, 1.0), (0, 1, E), (0, 2, E**3)], "last_price")
    grid = series([(0, m, 0.0) for m in range(5)]).drop("x")
    padded = returns.half_hour_mean_pad(ticks, grid)
    assert in_order(padded, "log_ret") == pytest.approx([1.5, 1, 2, 1.5, 1.5])
    assert in_order(padded, "was_missing") == [True, False, False, True, True]
