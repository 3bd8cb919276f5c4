import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import grid, ordered

from .conftest import in_order

DAY = dt.date(2024, 3, 1)


def ticks_of(spark, rows):
    """rows: (day, seconds, price)"""
    data = [(DAY + dt.timedelta(days=d), t, p, 1) for d, t, p in rows]
    return spark.createDataFrame(data, "index_date date, index_time int, last_price double, no_trades bigint")


def step_by_step(ticks, keys=()):
    axis = ordered.minute_axis(keys)
    joined = grid.grid_left_join(grid.session_grid(ticks, keys=keys), ticks, keys)
    return ordered.fill_forward(joined, "last_price", axis)


def messy_ticks(seed):
    pick = random.Random(seed)
    rows = []
    for day in range(10):
        kind = pick.choice(["none", "early", "late", "normal", "normal", "edges", "both"])
        minutes = {
            "none": [3 * 60],
            "early": [60, 120, 500],
            "late": [1000, 1200],
            "normal": pick.sample(range(0, 1440), 40),
            "edges": [510, 900],
            "both": [200, 509, 510, 511, 899, 900, 901],
        }[kind]
        rows += [(day, 60 * m, None if pick.random() < 0.1 else pick.uniform(5, 9)) for m in minutes]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_padding_in_one_pass_equals_grid_join_and_fill(spark, seed):
    ticks = ticks_of(spark, messy_ticks(seed))
    columns = ("index_date", "index_time", "last_price", "no_trades")
    quick = grid.pad_session(ticks, extras=["no_trades"])
    assert in_order(quick, *columns) == in_order(step_by_step(ticks), *columns)


@pytest.mark.parametrize("seed", range(3))
def test_ticks_between_minutes_mark_their_date_only(spark, seed):
    pick = random.Random(seed)
    between = [(d, 60 * pick.randrange(400, 1000) + pick.randrange(1, 60), 1.0) for d in range(12) for _ in range(3)]
    ticks = ticks_of(spark, messy_ticks(seed) + between)
    columns = ("index_date", "index_time", "last_price", "no_trades")
    quick = grid.pad_session(ticks, extras=["no_trades"])
    assert in_order(quick, *columns) == in_order(step_by_step(ticks), *columns)


def test_two_ticks_in_one_minute_fail(spark):
    ticks = ticks_of(spark, [(0, 9 * 3600, 5.0), (0, 9 * 3600, 6.0), (0, 10 * 3600, 7.0)])
    with pytest.raises(Exception, match="two ticks in one grid minute"):
        grid.pad_session(ticks).collect()


def test_padding_by_key(spark):
    parts = [ticks_of(spark, messy_ticks(s)).withColumn("k", F.lit(s)) for s in (7, 8)]
    both = parts[0].unionByName(parts[1])
    columns = ("index_date", "index_time", "last_price")
    keyed = grid.pad_session(both, keys=["k"])
    for s, part in zip((7, 8), parts):
        assert in_order(keyed.filter(F.col("k") == s), *columns) == in_order(
            grid.pad_session(part.drop("k")), *columns
        )


def test_every_date_has_391_minutes_even_without_session_ticks(spark):
    ticks = ticks_of(spark, [(0, 9 * 3600, 5.0), (1, 20 * 3600, 7.0), (3, 10 * 3600, 6.0)])
    padded = grid.pad_session(ticks)
    counts = {r[0]: r[1] for r in padded.groupBy("index_date").count().collect()}
    assert counts == {DAY + dt.timedelta(days=d): 391 for d in (0, 1, 3)}
    flat = padded.filter(F.col("index_date") == DAY + dt.timedelta(days=1)).select("last_price").distinct()
    assert [r[0] for r in flat.collect()] == [5.0]


def test_session_edges(spark):
    ticks = ticks_of(spark, [(0, 7 * 3600, 5.0), (2, 20 * 3600, 7.0)])
    row = grid.session_edges(ticks).first()
    assert tuple(row) == (dt.datetime(2024, 3, 1, 8, 30), dt.datetime(2024, 3, 3, 15, 0))


def test_calendar_grid_runs_through_the_night(spark):
    ticks = ticks_of(spark, [(0, 23 * 3600 + 58 * 60, 1.0), (2, 60, 2.0)])
    got = in_order(grid.calendar_grid(ticks), "index_date", "index_time")
    assert len(got) == 2 + 1440 + 2
    assert got[0] == (DAY, 86280) and got[-1] == (DAY + dt.timedelta(days=2), 60)


def test_full_join_fills_keys_from_both_sides(spark):
    ticks = ticks_of(spark, [(0, 9 * 3600, 5.0), (0, 20 * 3600, 7.0)])
    side = grid.session_grid(ticks).withColumn("mark", F.lit(1))
    tidy = ticks.withColumnsRenamed({"index_date": "d", "index_time": "t"})
    joined = grid.signature_full_join(side, tidy, [("index_date", "d"), ("index_time", "t")], ordered=True)
    assert joined.columns == ["index_date", "index_time", "mark", "last_price", "no_trades"]
    rows = joined.collect()
    assert len(rows) == 392
    assert tuple(rows[-1]) == (DAY, 72000, None, 7.0, 1)


def test_semi_join_keeps_only_known_dates(spark):
    ticks = ticks_of(spark, [(0, 1, 5.0), (0, 2, 5.0), (1, 1, 5.0), (2, 1, 5.0)])
    known = ticks.filter(F.col("index_date") != DAY + dt.timedelta(days=1))
    assert grid.date_semi_join(ticks, known).count() == 3


def test_make_series(spark):
    starts = spark.createDataFrame([(dt.datetime(2024, 1, 1, 8, 30),)], "start timestamp_ntz")
    got = [r[0] for r in grid.make_series(starts, "start", 391).select("index").orderBy("index").collect()]
    assert (len(got), got[0], got[-1]) == (391, dt.datetime(2024, 1, 1, 8, 30), dt.datetime(2024, 1, 1, 15, 0))
