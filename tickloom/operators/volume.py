"""Per-minute volume out of a volume that accumulates over the day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import (
    half_hour_bucket,
    half_hour_label,
    week_of_year,
    weekday_label,
    weekday_number,
)
from .ordered import Axis, MINUTES
from .returns import day_change


def volume_delta(df: DataFrame, volume: str = "volume", axis: Axis = MINUTES) -> DataFrame:
    """``new_volume``: the value itself when the day has just changed, else the rise
    since the previous row. Rows without a rise are dropped, and so is the very
    first row, whose ``day_change`` is unknown."""
    if "day_change" not in df.columns:
        df = day_change(df, axis)
    rise = F.col(volume) - F.lag(volume).over(axis.within())
    fresh = F.when(F.col("day_change") == 1, F.col(volume)).when(F.col("day_change") == 0, rise)
    return df.withColumn("new_volume", fresh).filter(F.col("new_volume") > 0)


def volume_delta_within(df: DataFrame, volume: str = "volume", axis: Axis = MINUTES) -> DataFrame:
    """Rise since the previous row of the same date; the first row of a date goes."""
    rise = F.col(volume) - F.lag(volume).over(axis.within())
    return df.withColumn("new_volume", rise).filter(F.col("new_volume").isNotNull())


def volume_anomalies(df: DataFrame, volume: str = "volume", axis: Axis = MINUTES) -> DataFrame:
    """Rows where the accumulated volume falls."""
    return volume_delta_within(df, volume, axis).filter(F.col("new_volume") < 0)


def with_half_hours(df: DataFrame) -> DataFrame:
    bucket = half_hour_bucket(F.col("index_time"))
    return df.withColumn("subgrid", bucket).withColumn("subgrid_id", half_hour_label(F.col("subgrid")))


def mean_by(df: DataFrame, value: str, groups: Sequence[Column], name: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(value).alias(name))


def mean_by_half_hour(df: DataFrame, value: str = "new_volume", keys: Sequence[str] = ()) -> DataFrame:
    groups = [F.col(c) for c in (*keys, "subgrid", "subgrid_id")]
    means = mean_by(with_half_hours(df), value, groups, "mean_volume")
    return means.orderBy(*keys, F.desc_nulls_last("mean_volume"), "subgrid")


def mean_by_week(
    df: DataFrame, value: str = "new_volume", date: str = "index_date", keys: Sequence[str] = ()
) -> DataFrame:
    groups = [*[F.col(k) for k in keys], week_of_year(F.col(date)).alias("week")]
    means = mean_by(df, value, groups, "average_volume")
    return means.orderBy(*keys, F.desc_nulls_last("average_volume"), "week")


def mean_by_weekday(
    df: DataFrame, value: str = "new_volume", date: str = "index_date", keys: Sequence[str] = ()
) -> DataFrame:
    day = F.col(date)
    groups = [*[F.col(k) for k in keys], weekday_number(day).alias("wday"), weekday_label(day).alias("wday_label")]
    return mean_by(df, value, groups, "avg_vol").orderBy(*keys, "wday")
