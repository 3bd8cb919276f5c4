"""Quantiles, date sets and summaries by key."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import datesets, profile, volume
from tickloom.operators.quantiles import grouped_quantiles

PS = [0, 0.01, 0.25, 0.5, 0.9, 1]


@pytest.mark.parametrize("ranges, few", [(1024, 4096), (4, 3), (2, 0)])
def test_quantiles_by_group(spark, ranges, few):
    draw = random.Random(5)
    rows = [("hot", draw.lognormvariate(0, 3)) for _ in range(400)] + [("hot", 1.0)] * 200  # one group, one value in it
    rows += [(f"k{k % 7}", draw.choice([0.0, -0.0, 1e300, -1e-300, 5.0, math.inf, -math.inf])) for k in range(120)]
    rows += [(None, float(k)) for k in range(9)] + [("none", None), ("none", math.nan), ("one", 7.5)]
    df = spark.createDataFrame([(k, v, None if v is None else v * 2) for k, v in rows], "k string, v double, w double").repartition(3)
    found = {(r.k, r.column, r.p): r.quantile for r in grouped_quantiles(df, ["v", "w"], PS, ["k"], ranges, few).collect()}
    groups = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(k, []).append(v)
    assert len(found) == len(groups) * 2 * len(PS)
    for k, own in groups.items():
        for name, times in (("v", 1), ("w", 2)):
            held = sorted(v * times for v in own)
            for p in PS:
                at = (len(held) - 1) * p
                a, b, share = held[math.floor(at)], held[math.ceil(at)], at - math.floor(at)
                wanted = a if share == 0 else a + share * (b - a)
                got = found[k, name, p]
                assert got == wanted or math.isclose(got, wanted, rel_tol=1e-12) or (math.isnan(got) and math.isnan(wanted))


def test_quantiles_of_one_table_and_of_none(spark):
    df = spark.createDataFrame([(float(k), k) for k in range(101)], "v double, n int")
    assert [r.quantile for r in grouped_quantiles(df, ["n"], [0.5, 0.755]).orderBy("p").collect()] == [50.0, 75.5]
    assert grouped_quantiles(df.limit(0), ["v"], PS).count() == 0


def test_date_sets_merge_and_differ(spark):
    draw = random.Random(8)
    day = lambda k: dt.date(1890, 1, 1) + dt.timedelta(days=k)
    rows = [(draw.choice(["hot", "hot", "a", "b", None]), day(draw.choice([draw.randrange(60), 29_000, 62_000])), draw.random()) for _ in range(900)]
    rows += [("c", None, 0.5), ("d", day(3), None)]
    df = spark.createDataFrame(rows, "k string, index_date date, x double").repartition(3)
    whole = datesets.date_sets(df, ["k"], high=F.col("x") > 0.9)
    parts = [datesets.date_sets(df.filter(F.coalesce(F.col("x"), F.lit(0)) % 0.1 < 0.05), ["k"], high=F.col("x") > 0.9),
             datesets.date_sets(df.filter(F.coalesce(F.col("x"), F.lit(0)) % 0.1 >= 0.05), ["k"], high=F.col("x") > 0.9)]
    union = datesets.merged(*parts, keys=["k"])
    as_rows = lambda s: sorted((str(r.k), r.bucket, bytes(r.dates), bytes(r.high)) for r in s.collect())
    assert as_rows(union) == as_rows(whole)
    wanted, high = {}, {}
    for k, d, x in rows:
        if d:
            wanted.setdefault(k, set()).add(d)
            high.setdefault(k, set()).update({d} if x is not None and x > 0.9 else ())
    assert {r.k: (r.dates, r.high) for r in datesets.sizes(whole, ["k"]).collect()} == {k: (len(v), len(high[k])) for k, v in wanted.items()}
    some = datesets.date_sets(df.filter("x > 0.9"), ["k"])
    found = {r.k: (r.all_dates, r.found_dates, r.missing_dates) for r in datesets.missing_dates(datesets.date_sets(df, ["k"]), some, ["k"]).collect()}
    assert found == {k: (len(v), len(high[k]), len(v - high[k])) for k, v in wanted.items()}
    assert datesets.sizes(datesets.date_sets(df)).first().dates == len({d for _, d, _ in rows if d})


def test_summaries_by_key(spark):
    rows = [("a", float(v)) for v in (3, 1, 2, 10)] + [(None, 4.0), (None, 6.0), ("b", None), ("c", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {(r.k, r.measure): r.value for r in profile.summary_long(df, "v", ["k"]).collect()}
    assert [found["a", m] for m in ("Min", "Median", "Mean", "Max")] == [1, 2.5, 4, 10]
    assert math.isclose(found["a", "Standard Dev"], np.std([3, 1, 2, 10], ddof=1))
    assert found[None, "Median"] == 5 and found["c", "Standard Dev"] is None and ("b", "Min") not in found


def test_means_by_key_carry_the_label(spark):
    rows = [("x", dt.date(2024, 1, 3), 30600, 4), ("x", dt.date(2024, 1, 3), 30660, 6), ("y", dt.date(2024, 1, 4), 54000, 1)]
    df = spark.createDataFrame(rows, "k string, index_date date, index_time int, new_volume int")
    found = volume.mean_by_half_hour(df, keys=["k"]).collect()
    assert [(r.k, r.subgrid, r.mean_volume) for r in found] == [("x", 1, 5), ("y", 13, 1)] and all(r.subgrid_id for r in found)
    assert [(r.k, r.week) for r in volume.mean_by_week(df, keys=["k"]).collect()] == [("x", 1), ("y", 1)]
    assert [(r.k, r.wday) for r in volume.mean_by_weekday(df, keys=["k"]).collect()] == [("x", 3), ("y", 4)]
