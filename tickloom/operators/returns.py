"""Log-returns of a padded price series and the calendar signature of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import half_hour_bucket, signature_columns
from ..functions.clock import in_session
from ..functions.numeric import clip_outliers, if_else, is_missing, log_change
from .grid import SLOT, with_index
from .ordered import Axis, MINUTES, lag_rows, minute_axis

THRESHOLD = 0.10


def lag_diff(df: DataFrame, axis: Axis = MINUTES) -> DataFrame:
    """``diff``: seconds since the previous row of the series."""
    lagged = lag_rows(df, {"_before_num": "index_num"}, axis)
    return lagged.withColumn("diff", F.col("index_num") - F.col("_before_num")).drop("_before_num")


def date_change(df: DataFrame, axis: Axis = MINUTES, name: str = "date_change") -> DataFrame:
    """TRUE where the date differs from the previous row's; NULL on the very first row."""
    lagged = lag_rows(df.withColumn("_date", F.col("index_date")), {"_before_date": "_date"}, axis)
    return lagged.withColumn(name, F.col("index_date") != F.col("_before_date")).drop("_date", "_before_date")


def day_change(df: DataFrame, axis: Axis = MINUTES) -> DataFrame:
    """The same as 1 / 0 / NULL."""
    return date_change(df, axis, "day_change").withColumn("day_change", F.col("day_change").cast("int"))


def time_signature(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All calendar columns plus ``diff`` and ``date_change``; one window, one carry."""
    date, seconds = F.col("index_date"), F.col("index_time")
    indexed = with_index(df).withColumns(signature_columns(date, seconds))
    before = {"_before_num": "index_num", "_before_date": "_date"}
    lagged = lag_rows(indexed.withColumn("_date", date), before, minute_axis(keys))
    return lagged.withColumns(
        {
            "diff": F.col("index_num") - F.col("_before_num"),
            "date_change": date != F.col("_before_date"),
        }
    ).drop("_date", "_before_num", "_before_date")


def log_returns(
    df: DataFrame,
    price: str = "last_price",
    overnight: str = "null",
    axis: Axis = MINUTES,
    previous: DataFrame | None = None,
) -> DataFrame:
    """``log_ret`` against the previous row.

    ``overnight`` says what the first row of a segment holds: ``"include"`` the
    move since the previous segment, ``"null"`` nothing, ``"zero"`` 0. Without the
    overnight move no carry is needed, only a window inside the segments. ``previous``
    has for each key the last price ahead of these rows.
    """
    if overnight == "include":
        lagged = lag_rows(df, {"_before": price}, axis, previous)
    elif overnight in ("null", "zero"):
        lagged = df.withColumn("_before", F.lag(price).over(axis.within()))
    else:
        raise ValueError(f"unknown overnight rule {overnight!r}")
    change = log_change(F.col(price), F.col("_before"))
    if overnight == "zero":
        first = F.row_number().over(axis.within()) == 1
        lagged = lagged.withColumn("_first", first)
        change = F.when(F.col("_first"), F.lit(0.0)).otherwise(change)
    return lagged.withColumn("log_ret", change).drop("_before", "_first")


def overnight_to_null(df: DataFrame) -> DataFrame:
    """Blank ``log_ret`` where ``date_change`` is TRUE or unknown."""
    return df.withColumn("log_ret", F.when(~F.col("date_change"), F.col("log_ret")))


def overnight_to_zero(df: DataFrame) -> DataFrame:
    """``log_ret`` 0 where ``date_change`` is TRUE and on the very first row."""
    zeroed = if_else(F.col("date_change"), F.lit(0.0), F.col("log_ret"))
    return df.withColumn("log_ret", F.when(F.col("date_change").isNull(), F.lit(0.0)).otherwise(zeroed))


def clip_returns(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Only ``log_ret`` is clipped; prices stay as they are."""
    return df.withColumn("log_ret", clip_outliers(F.col("log_ret"), threshold))


def half_hour_mean_pad(ticks: DataFrame, grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Grid minutes without a return take the mean return of their half-hour.

    The means have thirteen rows per key; they are joined as an aggregate, not
    spread by a window over all rows of a half-hour. Of a single series, thirteen
    rows are broadcast.
    """
    observed = log_returns(ticks.filter(in_session(F.col("index_time"))), axis=minute_axis(keys))
    bucket = half_hour_bucket(F.col("index_time"))
    means = (
        observed.withColumn("half_hour", bucket)
        .filter(~is_missing(F.col("log_ret")))
        .groupBy(*keys, "half_hour")
        .agg(F.avg("log_ret").alias("_mean"))
    )
    if not keys:
        means = F.broadcast(means)
    padded = grid.join(observed.select(*keys, *SLOT, "log_ret"), [*keys, *SLOT], "left")
    return (
        padded.withColumn("half_hour", bucket)
        .withColumn("was_missing", F.col("log_ret").isNull())
        .join(means, [*keys, "half_hour"], "left")
        .withColumn("log_ret", F.coalesce("log_ret", "_mean"))
        .drop("_mean")
    )
