import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import calendar, clock, numeric


def dates(spark, *texts):
    return spark.createDataFrame([(dt.date.fromisoformat(t),) for t in texts], "d date")


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_week_counts_whole_weeks_from_new_year(spark):
    df = dates(spark, "2024-01-07", "2024-01-08", "2024-12-30")
    assert values(df, calendar.week_of_year(F.col("d"))) == [1, 2, 53]


def test_calendar_features(spark):
    df = dates(spark, "2024-12-30", "2024-02-29")
    features = {k: values(df, c) for k, c in calendar.signature_columns(F.col("d"), F.lit(30660)).items()}
    assert features["wday"] == [1, 4]
    assert features["wday_label"] == ["Mon", "Thu"]
    assert features["month_label"] == ["Dec", "Feb"]
    assert features["qday"] == [91, 60]
    assert features["yday"] == [365, 60]
    assert features["half"] == [2, 1]
    assert features["quarter"] == [4, 1]
    assert (features["hour"], features["minute"]) == ([8, 8], [31, 31])


def test_week_of_month_and_weekday_instance(spark):
    # 1 September 2024 is a Sunday, so the 2nd opens the second row of the calendar.
    df = dates(spark, "2024-09-01", "2024-09-02", "2024-09-09", "2024-09-30")
    assert values(df, calendar.week_of_month(F.col("d"))) == [1, 2, 3, 6]
    assert values(df, calendar.weekday_instance(F.col("d"))) == [1, 1, 2, 5]


def seconds(*texts):
    return [sum(int(p) * f for p, f in zip(t.split(":"), (3600, 60))) for t in texts]


def test_half_hours(spark):
    df = spark.createDataFrame(
        [(s,) for s in seconds("08:30", "08:59", "09:00", "14:59", "15:00", "15:01", "08:29")], "t int"
    )
    bucket = calendar.half_hour_bucket(F.col("t"))
    assert values(df, bucket) == [1, 1, 2, 13, 13, None, None]
    assert values(df, calendar.half_hour_label(bucket))[:3] == ["08:30 - 8:59", "08:30 - 8:59", "09:00 - 9:29"]


def test_legacy_half_hours_merge_both_halves_of_hour_14(spark):
    times = ["08:45", "09:10", "09:40", "13:10", "13:40", "14:10", "14:40", "15:00"]
    df = spark.createDataFrame([(s,) for s in seconds(*times)], "t int")
    assert values(df, calendar.half_hour_bucket_legacy(F.col("t"))) == [1, 2, 3, 10, 11, 12, 12, 13]


def test_clock_does_not_depend_on_the_time_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 15),)], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:30 does not exist there
    try:
        ts = F.col("ts")
        row = df.select(
            clock.time_of_day(ts),
            clock.moment(F.to_date(ts), clock.minute_of_day(ts)),
            clock.epoch_seconds(F.to_date(ts), clock.time_of_day(ts)),
            clock.clock_text(clock.time_of_day(ts)),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(row) == (9015, dt.datetime(2024, 3, 10, 2, 30), 1710037815, "02:30:15")


def test_parsing(spark):
    df = spark.createDataFrame([(19960102.0, "08:36:05")], "d double, t string")
    row = df.select(clock.parse_date_number(F.col("d")), clock.parse_time_of_day(F.col("t"))).first()
    assert tuple(row) == (dt.date(1996, 1, 2), 8 * 3600 + 36 * 60 + 5)


def test_log_change_matches_the_published_return(spark):
    change = numeric.log_change(F.lit(2777.14), F.lit(2777.47))
    assert spark.range(1).select(change).first()[0] == pytest.approx(-1.18820e-4, rel=1e-4)


def test_log_of_zero_is_minus_infinity(spark):
    df = spark.createDataFrame([(0.0,), (None,), (-1.0,), (math.e,)], "x double")
    got = values(df, numeric.natural_log(F.col("x")))
    assert got[0] == -math.inf and got[1] is None and math.isnan(got[2]) and got[3] == pytest.approx(1)


def test_clip_keeps_missing_and_is_strict(spark):
    df = spark.createDataFrame([(None,), (0.05,), (0.1,), (-0.2,), (math.nan,), (math.inf,)], "x double")
    assert values(df, numeric.clip_outliers(F.col("x"), 0.1)) == [None, 0.05, 0.0, 0.0, None, 0.0]


def test_if_else_is_null_for_unknown(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert values(df, numeric.if_else(F.col("b"), F.lit(1), F.lit(0))) == [1, 0, None]


def test_annualise(spark):
    row = spark.range(1).select(
        numeric.annualise(F.lit(0.0001)), numeric.annualise(F.lit(0.0001), "252_sqrt_rv")
    ).first()
    assert row[0] == pytest.approx(0.158745, abs=1e-6) and row[1] == pytest.approx(2.52)
    with pytest.raises(ValueError):
        numeric.annualise(F.lit(1.0), "other")


def test_bins_close_the_range(spark):
    df = spark.createDataFrame([(0.0,), (0.99,), (1.0,), (5.0,), (5.01,), (None,)], "x double")
    assert values(df, numeric.equal_width_bin(F.col("x"), F.lit(0.0), F.lit(5.0), 5)) == [1, 1, 2, 5, None, None]
    assert values(df.limit(1), numeric.equal_width_bin(F.col("x"), F.lit(0.0), F.lit(0.0), 5)) == [1]
