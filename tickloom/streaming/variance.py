"""Daily realized variance kept up to date by the micro-batches of a stream.

Each batch leaves its minutes, the edges of the dates it touched and the variances it
changed in folders of its own number. Done again, a batch overwrites its own folders with
the same rows, so it counts once however often it is delivered. A batch reads the minutes of
the dates it concerns and one row per date of the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clock import in_session, minute_of_day, ordered_moment
from ..functions.numeric import annualise
from ..operators.grid import pad_session
from ..operators.ordered import END, HERE, START, minute_axis
from ..operators.returns import THRESHOLD, clip_returns, log_returns
from ..operators.variance import drop_zero_rv, sum_of_squares


def variance_writer(
    root: str,
    keys: Sequence[str] = (),
    threshold: float = THRESHOLD,
    ts: str = "ts",
    value: str = "value",
    tie: str = "event_id",
) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that takes events and keeps variances under ``root``.

    Events may come in any order, also for dates and minutes seen before. A date's variance
    depends on its own minutes and on the last price before it; when a batch changes that
    price, the dates that open with it are computed again as well.
    """
    keys, axis = list(keys), minute_axis(keys)
    date = [*keys, "index_date"]
    slot = [*date, "index_time"]

    def minutes(spark: SparkSession, dates: DataFrame) -> DataFrame:
        """Last prices of all minutes of the dates, over all batches. Few dates: the join prunes folders."""
        held = spark.read.parquet(f"{root}/minutes").join(F.broadcast(dates.select("index_date").distinct()), "index_date")
        if keys:
            held = held.join(dates.select(*date), date, "left_semi")
        return held.groupBy(*slot).agg(F.max_by("last_price", "at").alias("last_price"))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = ordered_moment(F.col(ts), F.col(tie))
        rows = batch.select(*keys, F.to_date(ts).alias("index_date"), minute_of_day(F.col(ts)).alias("index_time"), F.col(value).alias("_value"), at.alias("_at"))
        rows = rows.filter("index_date IS NOT NULL").groupBy(*slot).agg(F.max_by("_value", "_at").alias("last_price"), F.max("_at").alias("at"))
        of = f"batch={number}"
        rows.write.mode("overwrite").partitionBy("index_date").parquet(f"{root}/minutes/{of}")
        own = spark.read.schema(rows.schema).parquet(f"{root}/minutes/{of}")
        touched = own.select(*date).distinct()
        if touched.isEmpty():
            return

        inside = F.when(in_session(F.col("index_time")) & F.col("last_price").isNotNull(), F.col("index_time"))
        edges = minutes(spark, touched).groupBy(*date).agg(
            F.min_by("last_price", inside).alias("_first_known"), F.max_by("last_price", inside).alias("_last_known")
        )
        edges.write.mode("overwrite").parquet(f"{root}/edges/{of}")
        concerned = affected(spark, touched)
        concerned.write.mode("overwrite").parquet(f"{root}/carry/{of}")
        carry = spark.read.schema(concerned.schema).parquet(f"{root}/carry/{of}")

        padded = pad_session(minutes(spark, carry), keys=keys, carry=carry)
        moved = clip_returns(log_returns(padded, axis=axis), threshold)
        rv = carry.select(*date).join(sum_of_squares(moved, "log_ret", date, "rv"), date, "left")
        rv.write.mode("overwrite").parquet(f"{root}/rv/{of}")

    def affected(spark: SparkSession, touched: DataFrame) -> DataFrame:
        """(keys, index_date, _before, _after) of the dates to be computed: those touched and those that
        take their opening price from one. One row per date: its size follows the calendar."""
        calendar = latest(spark.read.parquet(f"{root}/edges"), date, ["_first_known", "_last_known"])
        across = axis.across()
        earlier, later = across.rowsBetween(START, -1), across.rowsBetween(HERE, END)
        source = F.last(F.when(F.col("_last_known").isNotNull(), F.col("_new")), ignorenulls=True).over(earlier)
        marked = calendar.join(touched.withColumn("_new", F.lit(True)), date, "left")
        marked = marked.withColumn("_new", F.coalesce("_new", F.lit(False)))
        # A touched date without a price of its own may have had none before either: what it hands on is unchanged.
        seen = marked.select(
            *date,
            F.last("_last_known", ignorenulls=True).over(earlier).alias("_before"),
            F.first("_first_known", ignorenulls=True).over(later).alias("_after"),
            (F.col("_new") | F.coalesce(source, F.lit(True))).alias("_due"),
        )
        return seen.filter("_due").drop("_due")

    return write


def latest(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Of each group the values that the last batch has for it."""
    held = rows.groupBy(*by).agg(F.max_by(F.struct(*values), "batch").alias("_held"))
    return held.select(*by, *[F.col(f"_held.{v}").alias(v) for v in values])


def daily_variance(spark: SparkSession, root: str, keys: Sequence[str] = (), form: str = "sqrt_252_rv") -> DataFrame:
    """``(keys, index_date, rv, rv_an)`` as of the last batch; dates without a variance are left out."""
    rv = drop_zero_rv(latest(spark.read.parquet(f"{root}/rv"), [*keys, "index_date"], ["rv"]))
    return rv.withColumn("rv_an", annualise(F.col("rv"), form))


def update_available(events: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run the writer over what the stream can give now and stop."""
    query = events.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
