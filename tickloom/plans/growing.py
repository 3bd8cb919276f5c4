"""Queries over series that grow: streams of events and stores that take new dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schemas import EVENTS
from ..session import staging_path
from ..streaming import bars as bar_ops
from ..streaming.variance import daily_variance, update_available, variance_writer
from . import inputs
from .registry import query
from .sql import r, statement
from .store import SeriesStore

_BARS = f"""SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS bar_start, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS bar_end,
        {r('arg_min(value, row(ts, event_id))')} AS open, {r('max(value)')} AS high, {r('min(value)')} AS low,
        {r('arg_max(value, row(ts, event_id))')} AS close, count(*) AS no_trades FROM events GROUP BY ALL"""


@query("half_hour_bars", _BARS)
def half_hour_bars(spark, folder):
    return bar_ops.bars(inputs.events(spark, folder))


@query(
    "half_hour_bars_stream",
    f"""SELECT * FROM ({_BARS})
    WHERE bar_end <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR""",
)
def half_hour_bars_stream(spark, folder):
    """The bars that are final an hour, in event time, before the last event."""
    found = bar_ops.bars(bar_ops.event_stream(spark, f"{folder}/events.parquet", EVENTS))
    path = staging_path(spark, "bars")
    bar_ops.append_available(found, path, staging_path(spark, "bars-checkpoint"))
    return spark.read.schema(found.schema).parquet(path)


@query(
    "realized_variance_stream",
    statement(f"SELECT index_date, {r('rv')} AS rv, {r('sqrt(252 * rv)')} AS rv_an FROM rv", "rv"),
)
def realized_variance_stream(spark, folder):
    """Events arrive in four files, each with events of all dates."""
    arrivals, root = staging_path(spark, "arrivals"), staging_path(spark, "variances")
    inputs.events(spark, folder).repartition(4, "event_id").write.parquet(arrivals)
    stream = bar_ops.event_stream(spark, arrivals, EVENTS, files_per_batch=1)
    update_available(stream, variance_writer(root, threshold=inputs.THRESHOLD), staging_path(spark, "rv-checkpoint"))
    return daily_variance(spark, root)


def _store(spark, folder) -> SeriesStore:
    """The series in three parts, each a third of the dates."""
    ticks = inputs.staged_tape(spark, folder)
    dates = [row[0] for row in ticks.select("index_date").distinct().orderBy("index_date").collect()]  # a calendar
    store = SeriesStore(spark, staging_path(spark, "store"), threshold=inputs.THRESHOLD)
    cuts = [0, len(dates) // 3, 2 * len(dates) // 3, len(dates)]
    for first, last in zip(cuts, cuts[1:]):
        if first < last:
            store.append(ticks.filter(F.col("index_date").between(dates[first], dates[last - 1])))
    return store


@query(
    "append_returns",
    statement(
        f"""SELECT index_date, index_time, {r('last_price')} AS last_price, {r('log_ret')} AS log_ret,
            count(log_ret) OVER (ORDER BY index_date, index_time) AS no_returns FROM returns""",
        "returns",
    ),
)
def append_returns(spark, folder):
    return _store(spark, folder).returns()


@query(
    "append_every_kth",
    statement(
        f"""SELECT index_date, index_time, {r('log_ret')} AS log_ret FROM (
            SELECT *, row_number() OVER (ORDER BY index_date, index_time) AS n FROM returns WHERE log_ret IS NOT NULL)
        WHERE (n - 1) % 7 = 0""",
        "returns",
    ),
)
def append_every_kth(spark, folder):
    return _store(spark, folder).every_kth_return(7).select("index_date", "index_time", "log_ret")


@query(
    "append_sparse_rv",
    statement(
        f"""SELECT s_grid, index_date, {r('rv_sparse')} AS rv_sparse, {r('sqrt(252 * rv_sparse)')} AS rv_sparse_an
        FROM sparse""",
        "sparse",
    ),
)
def append_sparse_rv(spark, folder):
    return _store(spark, folder).sparse_rv()
