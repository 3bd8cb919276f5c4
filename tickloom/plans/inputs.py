"""The given tables seen as market data: tapes, padded prices, returns, daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.clock import in_session, minute_of_day
from ..operators.grid import pad_session
from ..operators.ordered import minute_axis
from ..operators.returns import clip_returns, day_change, log_returns
from ..operators.variance import realized_variance
from ..operators.volume import volume_delta
from ..schemas import EVENTS, LINEITEM, ORDERS
from ..session import stage
from ..sources.files import scan_parquet

THRESHOLD = 3.0  # these prices move by factors of e, not by per mille
VOLUME_WRAP = 200_000  # makes the accumulated volume fall now and then


def events(spark: SparkSession, folder: str) -> DataFrame:
    return scan_parquet(spark, f"{folder}/events.parquet", EVENTS)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return scan_parquet(spark, f"{folder}/orders.parquet", ORDERS)


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return scan_parquet(spark, f"{folder}/lineitem.parquet", LINEITEM)


def cents(amount):
    return F.round(amount * 100).cast("bigint")


def moment_in_minute(ts: Column, event_id: Column) -> Column:
    """Microseconds within the minute, then the id, in one decimal; exact for any 64-bit id."""
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("decimal(8,0)")
    return micros * F.lit(str(10**20)).cast("decimal(21,0)") + event_id.cast("decimal(20,0)")


def tape(spark: SparkSession, folder: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per minute: last price, number of events, sum of prices in cents.

    Events are combined before the shuffle; however many fall into one minute,
    each task sends one row for it. The last event of a minute is the latest, and of
    events at the same time the one with the highest id. Both are packed into one
    number, which keeps the aggregate in a hash map, where ordering by a struct of
    time and id would sort all events first.
    """
    ts = F.col("ts")
    slots = events(spark, folder).select(
        *keys,
        F.to_date(ts).alias("index_date"),
        minute_of_day(ts).alias("index_time"),
        moment_in_minute(ts, F.col("event_id")).alias("moment"),
        "value",
    )
    return slots.groupBy(*keys, "index_date", "index_time").agg(
        F.max_by("value", "moment").alias("last_price"),
        F.count(F.lit(1)).alias("no_trades"),
        F.sum(cents(F.col("value"))).alias("q"),
    )


def staged_tape(
    spark: SparkSession, folder: str, columns: Sequence[str] = ("last_price",), keys: Sequence[str] = ()
) -> DataFrame:
    """The tape, written once: at this point the data has shrunk to minutes, and
    what follows reads it twice."""
    minutes = tape(spark, folder, keys).select(*keys, "index_date", "index_time", *columns)
    return stage(minutes, "tape")


def session_tape(spark: SparkSession, folder: str, keys: Sequence[str] = ()) -> DataFrame:
    return tape(spark, folder, keys).filter(in_session(F.col("index_time")))


def padded(spark: SparkSession, folder: str, extras: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    ticks = staged_tape(spark, folder, ["last_price", *extras], keys)
    return pad_session(ticks, extras=extras, keys=keys)


def returns(spark: SparkSession, folder: str, keys: Sequence[str] = ()) -> DataFrame:
    series = padded(spark, folder, keys=keys)
    return clip_returns(log_returns(series, axis=minute_axis(keys)), THRESHOLD)


def daily_rv(spark: SparkSession, folder: str) -> DataFrame:
    return realized_variance(returns(spark, folder))


def voltape(spark: SparkSession, folder: str, keys: Sequence[str] = ()) -> DataFrame:
    """Session minutes with a volume that accumulates over the date."""
    so_far = Window.partitionBy(*keys, "index_date").orderBy("index_time").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    minutes = stage(
        session_tape(spark, folder, keys).select(*keys, "index_date", "index_time", "no_trades", "q"), "voltape"
    )
    changes = day_change(minutes, minute_axis(keys))
    return changes.withColumn("volume", F.sum("q").over(so_far) % VOLUME_WRAP).drop("q")


def clean_volume(spark: SparkSession, folder: str, keys: Sequence[str] = ()) -> DataFrame:
    return volume_delta(voltape(spark, folder, keys), axis=minute_axis(keys))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order date: orders, turnover, mean and largest order in cents."""
    return (
        orders(spark, folder)
        .select(F.to_date("o_orderdate").alias("date"), cents(F.col("o_totalprice")).alias("c"))
        .groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.sum("c").alias("turnover_cents"),
            F.max("c").alias("largest_cents"),
        )
        .withColumn("turnover", F.col("turnover_cents") / 1e6)
    )


def implied_volatility(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in for a volatility index: spread of the values of all events per date."""
    return events(spark, folder).groupBy(F.to_date("ts").alias("index_date")).agg(F.stddev_samp("value").alias("iv"))
