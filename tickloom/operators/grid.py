"""Session grids, padding, and the joins between a grid and its ticks.

Ticks carry ``index_date`` and ``index_time`` (seconds since midnight), one row
per minute and key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DateType

from ..functions.clock import (
    MINUTE,
    SESSION_CLOSE,
    SESSION_OPEN,
    epoch_seconds,
    in_session,
    minute_range,
    moment,
)
from .ordered import HERE, START, known_price_carry, minute_axis

SLOT = ["index_date", "index_time"]


def trading_dates(ticks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dates with at least one tick, in or out of session."""
    return ticks.select(*keys, "index_date").distinct()


def session_edges(
    ticks: DataFrame, opening: int = SESSION_OPEN, closing: int = SESSION_CLOSE, keys: Sequence[str] = ()
) -> DataFrame:
    """First and last moment of the series, moved to the session's open and close."""
    ends = ticks.groupBy(*keys).agg(
        F.min("index_date").alias("_first"), F.max("index_date").alias("_last")
    )
    return ends.select(
        *keys,
        moment(F.col("_first"), F.lit(opening)).alias("first_dttm"),
        moment(F.col("_last"), F.lit(closing)).alias("last_dttm"),
    )


def session_grid(
    ticks: DataFrame, opening: int = SESSION_OPEN, closing: int = SESSION_CLOSE, keys: Sequence[str] = ()
) -> DataFrame:
    """Every session minute of every trading date."""
    return trading_dates(ticks, keys).withColumn("index_time", F.explode(minute_range(opening, closing)))


def calendar_grid(ticks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every minute from the first tick to the last one, nights and holidays included.

    Dates are exploded first and spread out, so that no task makes the whole span.
    """
    at = epoch_seconds(F.col("index_date"), F.col("index_time"))
    spans = ticks.groupBy(*keys).agg(
        F.min("index_date").alias("_first"),
        F.max("index_date").alias("_last"),
        F.min(at).alias("_head"),
        F.max(at).alias("_tail"),
    )
    days = spans.withColumn("index_date", F.explode(F.sequence("_first", "_last"))).repartition(
        *keys, "index_date"
    )
    minutes = days.withColumn("index_time", F.explode(minute_range(0, 86400 - MINUTE)))
    return minutes.filter(at.between(F.col("_head"), F.col("_tail"))).select(*keys, *SLOT)


def grid_left_join(grid: DataFrame, ticks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Grid rows with the tick of that minute, if there is one."""
    return grid.join(ticks, [*keys, *SLOT], "left")


def signature_full_join(
    grid: DataFrame, ticks: DataFrame, on: Sequence[tuple[str, str]], ordered: bool = False
) -> DataFrame:
    """Full outer join on differently named keys; the output has the left names,
    filled from either side. Sorting is a range shuffle and only done on request."""
    left, right = grid.alias("left"), ticks.alias("right")
    names = dict(on)
    condition = reduce(and_, [F.col(f"left.{l}") == F.col(f"right.{r}") for l, r in on])
    joined = left.join(right, condition, "full").select(
        *[F.coalesce(f"left.{l}", f"right.{r}").alias(l) for l, r in on],
        *[f"left.{c}" for c in grid.columns if c not in names],
        *[f"right.{c}" for c in ticks.columns if c not in names.values()],
    )
    return joined.orderBy(*names) if ordered else joined


def date_semi_join(df: DataFrame, dates: DataFrame, on: Sequence[str] = ("index_date",)) -> DataFrame:
    """Rows whose date also occurs in ``dates``.

    Distinct dates alone are few, 366 a year at most, and are broadcast; with more
    columns the choice is left to the measured size.
    """
    wanted = dates.select(*on).distinct()
    if [wanted.schema[c].dataType for c in on] == [DateType()]:
        wanted = F.broadcast(wanted)
    return df.join(wanted, list(on), "left_semi")


def pad_session(
    ticks: DataFrame,
    price: str = "last_price",
    extras: Sequence[str] = (),
    opening: int = SESSION_OPEN,
    closing: int = SESSION_CLOSE,
    keys: Sequence[str] = (),
    previous: DataFrame | None = None,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Grid, left join and fill-forward in one pass over the ticks.

    Instead of building a grid and joining it, every tick is repeated for the
    minutes up to the next tick of its date, so the only shuffle of the series is
    the one by date. ``extras`` stay NULL on inserted minutes. A date whose ticks
    all lie outside the session is kept and padded flat. A tick between two grid
    minutes matches neither and only marks its date; two ticks in one grid minute
    fail, since either could be its price. The plan reads ``ticks`` twice (rows and
    carry): hand in a staged table.

    ``previous`` has for each key the last known price ahead of these ticks. ``carry``
    gives the prices before and after each date itself (``_before``, ``_after``), for
    ticks that are only some dates of a series.
    """
    axis = minute_axis(keys)
    on_grid = (F.col("index_time") - opening) % MINUTE == 0
    inside = in_session(F.col("index_time"), opening, closing) & on_grid
    session = ticks.withColumn("_price", F.when(inside, F.col(price)))
    if carry is None:
        stored = None if previous is None else previous.withColumnRenamed(price, "_price")
        carry = known_price_carry(session, "_price", axis, stored)

    # Ticks out of session come first; one of them marks the date, the rest go.
    day = Window.partitionBy(*axis.segment_keys)
    queue = day.orderBy("_inside", "index_time")
    marked = (
        session.withColumn("_inside", inside)
        .withColumn("_rank", F.row_number().over(queue))
        .withColumn("_next", F.lead(F.when(F.col("_inside"), F.col("index_time"))).over(queue))
        .withColumn("_held", F.last("_price", ignorenulls=True).over(queue.rowsBetween(START, HERE)))
        .withColumn("_entry", F.min(F.when(F.col("_inside"), F.col("index_time"))).over(day))
        .filter(F.col("_inside") | (F.col("_rank") == 1))
    )
    begin = F.when(F.col("_rank") == 1, F.lit(opening)).otherwise(F.col("index_time"))
    following = F.when(F.col("_inside"), F.col("_next")).otherwise(F.col("_entry"))
    end = F.coalesce(following - MINUTE, F.lit(closing))
    twice = F.col("_inside") & (F.col("_next") == F.col("index_time"))
    failed = F.raise_error(F.lit("two ticks in one grid minute")).cast("array<int>")
    slots = F.when(twice, failed).when(end >= begin, F.sequence(begin, end, F.lit(MINUTE)))
    own = F.col("_slot") == F.col("index_time")
    started = F.col("_slot") >= F.col("index_time")
    return (
        marked.withColumn("_slot", F.explode(slots))
        .join(carry, axis.segment_keys, "left")
        .select(
            *axis.segment_keys,
            F.col("_slot").alias("index_time"),
            F.coalesce(F.when(started, F.col("_held")), "_before", "_after").alias(price),
            *[F.when(own, F.col(c)).alias(c) for c in extras],
        )
    )


def make_series(df: DataFrame, start: str, length: int, step: int = MINUTE) -> DataFrame:
    """``length`` moments from each row's ``start`` (timestamp_ntz), ``step`` seconds apart."""
    offsets = F.explode(F.sequence(F.lit(0), F.lit((length - 1) * step), F.lit(step)))
    zero = F.lit(0)
    return (
        df.withColumn("_offset", offsets)
        .withColumn("index", F.col(start) + F.make_dt_interval(zero, zero, zero, F.col("_offset")))
        .drop("_offset")
    )


def with_index(df: DataFrame) -> DataFrame:
    """Add the moment itself and its epoch seconds."""
    date, seconds = F.col("index_date"), F.col("index_time")
    return df.withColumns({"index": moment(date, seconds), "index_num": epoch_seconds(date, seconds)})
