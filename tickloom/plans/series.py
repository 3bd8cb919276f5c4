"""Queries over grids, joins, and order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import SESSION_OPEN, epoch_seconds, in_session, minute_of_day, moment
from ..operators import grid, ordered, returns, volume
from ..operators.profile import null_counts
from ..session import staging_path
from ..sources.files import sink_bucketed, sink_checked
from . import inputs, prepare
from .registry import query
from .sql import MOMENT, clip, ln, r, statement

BUCKETS = 8  # of the stored series; take some thousand dates and keys a bucket

# --- grids and padding ------------------------------------------------------------


@query(
    "session_edges",
    """SELECT CAST(min(CAST(ts AS DATE)) AS TIMESTAMP) + INTERVAL 510 MINUTE AS first_dttm,
        CAST(max(CAST(ts AS DATE)) AS TIMESTAMP) + INTERVAL 900 MINUTE AS last_dttm FROM events""",
)
def session_edges(spark, folder):
    dates = inputs.events(spark, folder).select(F.to_date("ts").alias("index_date"))
    return grid.session_edges(dates)


@query("session_grid", statement(f"SELECT {MOMENT} AS index, index_date, index_time FROM grid", "grid"))
def session_grid(spark, folder):
    dates = inputs.events(spark, folder).select(F.to_date("ts").alias("index_date"))
    return grid.with_index(grid.session_grid(dates)).drop("index_num")


@query(
    "pad_by_time",
    statement(
        f"""SELECT g.index, {r('last_price')} AS last_price, no_trades
        FROM (SELECT unnest(generate_series(min({MOMENT}), max({MOMENT}), INTERVAL 1 MINUTE)) AS index FROM tape) g
        LEFT JOIN (SELECT *, {MOMENT} AS index FROM tape) t ON g.index = t.index""",
        "tape",
    ),
)
def pad_by_time(spark, folder):
    """All minutes of the span, nights included."""
    ticks = inputs.staged_tape(spark, folder, ["last_price", "no_trades"])
    padded = grid.grid_left_join(grid.calendar_grid(ticks), ticks)
    return grid.with_index(padded).select("index", "last_price", "no_trades")


@query(
    "make_series_n",
    statement(
        f"""SELECT index_date, CAST(index_date AS TIMESTAMP) + to_seconds(30600 + 60 * CAST(m.n AS BIGINT)) AS index
        FROM (SELECT DISTINCT index_date FROM tape), range(0, 391) AS m(n)""",
        "tape",
    ),
)
def make_series_n(spark, folder):
    dates = inputs.events(spark, folder).select(F.to_date("ts").alias("index_date")).distinct()
    starts = dates.withColumn("start", moment(F.col("index_date"), F.lit(SESSION_OPEN)))
    return grid.make_series(starts, "start", 391).drop("start")


@query(
    "pad_check",
    statement(
        """SELECT "column", count(*) FILTER (WHERE missing) AS no_missing FROM (
            SELECT unnest(['index_date', 'index_time', 'last_price', 'no_trades']) AS "column",
                unnest([index_date IS NULL, index_time IS NULL, last_price IS NULL, no_trades IS NULL]) AS missing
            FROM padded) GROUP BY 1""",
        "padded",
    ),
)
def pad_check(spark, folder):
    return null_counts(inputs.padded(spark, folder, ["no_trades"]))


@query(
    "pad_check_on_write",
    statement(
        """SELECT "column", count(*) FILTER (WHERE missing) AS no_missing, count(*) AS no_rows,
            count(*) FILTER (WHERE outside) AS no_outside FROM (
            SELECT unnest(['index_date', 'index_time', 'last_price', 'no_trades']) AS "column",
                unnest([index_date IS NULL, index_time IS NULL, last_price IS NULL, no_trades IS NULL]) AS missing,
                index_time NOT BETWEEN 30600 AND 54000 AS outside
            FROM padded) GROUP BY 1""",
        "padded",
    ),
)
def pad_check_on_write(spark, folder):
    """The checks of a padded series, measured by the job that writes it."""
    padded = inputs.padded(spark, folder, ["no_trades"])
    outside = ~in_session(F.col("index_time"))
    missing, counts = sink_checked(padded, staging_path(spark, "checked"), outside=outside)
    rows = [(c, n, counts["rows"], counts["outside"]) for c, n in missing.items()]
    return spark.createDataFrame(rows, "column string, no_missing long, no_rows long, no_outside long")


# --- joins ------------------------------------------------------------------------


@query(
    "grid_left_join",
    statement(f"SELECT index_date, index_time, {r('last_price')} AS last_price, no_trades FROM joined", "joined"),
)
def grid_left_join(spark, folder):
    ticks = inputs.staged_tape(spark, folder, ["last_price", "no_trades"])
    return grid.grid_left_join(grid.session_grid(ticks), ticks)


_FULL = """SELECT coalesce(g.index_date, t.index_date) AS index_date,
    coalesce(g.index_time, t.index_time) AS index_time, g.index_num, t.last_price, t.no_trades
    FROM (SELECT *, CAST(epoch(CAST(index_date AS TIMESTAMP)) AS BIGINT) + index_time AS index_num FROM grid) g
    FULL JOIN tape t ON g.index_date = t.index_date AND g.index_time = t.index_time"""


def _full_join(spark, folder):
    ticks = inputs.staged_tape(spark, folder, ["last_price", "no_trades"])
    date, seconds = F.col("index_date"), F.col("index_time")
    signature = grid.session_grid(ticks).withColumn("index_num", epoch_seconds(date, seconds))
    tidy = ticks.withColumnsRenamed({"index_date": "tidy_date", "index_time": "tidy_time"})
    return grid.signature_full_join(
        signature, tidy, [("index_date", "tidy_date"), ("index_time", "tidy_time")]
    )


@query(
    "signature_full_join",
    statement(
        f"SELECT index_date, index_time, index_num, {r('last_price')} AS last_price, no_trades FROM ({_FULL})",
        "grid",
    ),
)
def signature_full_join(spark, folder):
    return _full_join(spark, folder)


@query(
    "unmatched_rows",
    statement(
        f"""SELECT index_date, index_time, {r('last_price')} AS last_price, no_trades
        FROM ({_FULL}) WHERE index_num IS NULL""",
        "grid",
    ),
)
def unmatched_rows(spark, folder):
    ticks = inputs.staged_tape(spark, folder, ["last_price", "no_trades"])
    return ticks.join(grid.session_grid(ticks), ["index_date", "index_time"], "left_anti")


# --- order-dependent operators -----------------------------------------------------


@query(
    "fill_forward",
    statement(f"SELECT index_date, index_time, {r('last_price')} AS last_price FROM padded", "padded"),
)
def fill_forward(spark, folder):
    """Grid, left join and fill as separate steps."""
    ticks = inputs.staged_tape(spark, folder)
    joined = inputs.stage(grid.grid_left_join(grid.session_grid(ticks), ticks), "joined")
    return ordered.fill_forward(joined, "last_price")


@query(
    "pad_session",
    statement(
        f"SELECT index_date, index_time, {r('last_price')} AS last_price, no_trades FROM padded", "padded"
    ),
)
def pad_session(spark, folder):
    """The same series in one pass over the ticks."""
    return inputs.padded(spark, folder, ["no_trades"])


@query(
    "lag_diff",
    statement(
        """SELECT index_date, index_time, n AS index_num, n - lag(n) OVER (ORDER BY n) AS diff FROM (
            SELECT *, CAST(epoch(CAST(index_date AS TIMESTAMP)) AS BIGINT) + index_time AS n FROM tape)""",
        "tape",
    ),
)
def lag_diff(spark, folder):
    ticks = inputs.staged_tape(spark, folder, [])
    indexed = grid.with_index(ticks).select("index_date", "index_time", "index_num")
    return returns.lag_diff(indexed)


@query("date_change", statement("SELECT index_date, index_time, date_change FROM moves", "moves"))
def date_change(spark, folder):
    ticks = inputs.staged_tape(spark, folder, [])
    return returns.date_change(grid.session_grid(ticks))


@query(
    "day_change",
    statement(
        """SELECT index_date, index_time,
            CAST(index_date <> lag(index_date) OVER (ORDER BY index_date, index_time) AS BIGINT) AS day_change
        FROM tape""",
        "tape",
    ),
)
def day_change(spark, folder):
    return returns.day_change(inputs.staged_tape(spark, folder, []))


_SIGNATURE = f"""SELECT {MOMENT} AS index, index_date, index_time, {r('last_price')} AS last_price,
    CAST(epoch({MOMENT}) AS BIGINT) AS index_num,
    CAST(epoch({MOMENT}) - lag(epoch({MOMENT})) OVER (ORDER BY index_date, index_time) AS BIGINT) AS diff,
    CAST(year(index_date) AS BIGINT) AS year, CAST(CASE WHEN month(index_date) <= 6 THEN 1 ELSE 2 END AS BIGINT) AS half,
    CAST(quarter(index_date) AS BIGINT) AS quarter, CAST(month(index_date) AS BIGINT) AS month,
    strftime(index_date, '%b') AS month_label, CAST(day(index_date) AS BIGINT) AS day,
    index_time // 3600 AS hour, index_time // 60 % 60 AS minute, CAST(isodow(index_date) AS BIGINT) AS wday,
    strftime(index_date, '%a') AS wday_label,
    CAST(date_diff('day', date_trunc('quarter', index_date), index_date) + 1 AS BIGINT) AS qday,
    CAST(dayofyear(index_date) AS BIGINT) AS yday, date_change FROM moves"""


@query("time_signature", statement(_SIGNATURE, "moves"))
def time_signature(spark, folder):
    series = inputs.stage(inputs.padded(spark, folder), "padded")
    return returns.time_signature(series)


@query(
    "log_return",
    statement(f"SELECT index_date, index_time, {r('raw_ret')} AS log_ret FROM moves", "moves"),
)
def log_return(spark, folder):
    series = inputs.stage(inputs.padded(spark, folder), "padded")
    return returns.log_returns(series, overnight="include").drop("last_price")


@query(
    "bucketed_returns",
    statement(
        f"""SELECT index_date, index_time, {r('last_price')} AS last_price, no_trades, {r('log_ret')} AS log_ret
        FROM returns""",
        "returns",
    ),
)
def bucketed_returns(spark, folder):
    """Grid join and returns of a series that is stored by date: no exchange after the write."""
    ticks = inputs.staged_tape(spark, folder, ["last_price", "no_trades"])
    series = grid.pad_session(ticks, extras=["no_trades"])
    path = staging_path(spark, "buckets")
    stored = sink_bucketed(series, f"series_{path[-32:]}", path, ["index_date"], ["index_time"], BUCKETS)
    return returns.clip_returns(returns.log_returns(stored), inputs.THRESHOLD)


@query(
    "overnight_null",
    statement(
        f"""SELECT index_date, index_time, {r('CASE WHEN NOT date_change THEN raw_ret END')} AS log_ret
        FROM moves""",
        "moves",
    ),
)
def overnight_null(spark, folder):
    return returns.log_returns(inputs.padded(spark, folder), overnight="null").drop("last_price")


_ZERO = "CASE WHEN NOT date_change THEN raw_ret ELSE 0.0 END"


@query(
    "overnight_zero",
    statement(f"SELECT index_date, index_time, {r(_ZERO)} AS log_ret FROM moves", "moves"),
)
def overnight_zero(spark, folder):
    return returns.log_returns(inputs.padded(spark, folder), overnight="zero").drop("last_price")


@query(
    "clip_outliers",
    statement(
        f"""SELECT index_date, index_time, {r('last_price')} AS last_price, {r('log_ret')} AS log_ret
        FROM returns""",
        "returns",
    ),
)
def clip_outliers(spark, folder):
    return inputs.returns(spark, folder)


@query(
    "volume_delta",
    statement("SELECT index_date, index_time, volume, day_change, new_volume FROM clean", "clean"),
)
def volume_delta(spark, folder):
    return inputs.clean_volume(spark, folder).drop("no_trades")


_WITHIN = """SELECT index_date, index_time, volume,
    volume - lag(volume) OVER (PARTITION BY index_date ORDER BY index_time) AS new_volume FROM voltape"""


@query(
    "volume_delta_one_day",
    statement(f"SELECT * FROM ({_WITHIN}) WHERE new_volume IS NOT NULL", "voltape"),
)
def volume_delta_one_day(spark, folder):
    return volume.volume_delta_within(inputs.voltape(spark, folder)).drop("no_trades", "day_change")


@query("volume_anomalies", statement(f"SELECT * FROM ({_WITHIN}) WHERE new_volume < 0", "voltape"))
def volume_anomalies(spark, folder):
    return volume.volume_anomalies(inputs.voltape(spark, folder)).drop("no_trades", "day_change")


@query(
    "rolling_sum",
    statement(f"SELECT index_date, index_time, {r('ret')} AS ret_10m FROM roll10", "roll10"),
)
def rolling_sum(spark, folder):
    series = inputs.returns(spark, folder)
    return ordered.rolling_sum(series, "log_ret", 10, "ret_10m").drop("last_price", "log_ret")


@query(
    "rolling_sum_across",
    statement(
        f"""SELECT index_date, index_time, {r('CASE WHEN count(*) OVER w = 30 THEN sum(x) OVER w END')} AS ret_30m
        FROM (SELECT index_date, index_time, {clip(_ZERO)} AS x FROM moves)
        WINDOW w AS (ORDER BY index_date, index_time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
        "moves",
    ),
)
def rolling_sum_across(spark, folder):
    """Zero overnight returns: the windows do cross from one date into the next."""
    zeroed = returns.log_returns(inputs.padded(spark, folder), overnight="zero")
    series = inputs.stage(returns.clip_returns(zeroed, inputs.THRESHOLD), "zeroed")
    return ordered.rolling_sum_across(series, "log_ret", 30, "ret_30m").drop("last_price", "log_ret")


@query(
    "every_kth_row",
    statement(
        f"""SELECT index_date, index_time, {r('log_ret')} AS log_ret FROM (
            SELECT *, row_number() OVER (ORDER BY index_date, index_time) AS rn FROM returns
            WHERE log_ret IS NOT NULL) WHERE (rn - 1) % 7 = 0""",
        "returns",
    ),
)
def every_kth_row(spark, folder):
    known = inputs.returns(spark, folder).filter(F.col("log_ret").isNotNull())
    series = inputs.stage(known.select("index_date", "index_time", "log_ret"), "known")
    return ordered.every_kth_row(series, 7)


@query(
    "half_hour_mean_pad",
    statement(
        f"""SELECT index_date, index_time, half_hour, log_ret IS NULL AS was_missing,
            {r('coalesce(log_ret, mean)')} AS log_ret
        FROM (SELECT *, CAST(least((index_time - 30600) // 1800 + 1, 13) AS BIGINT) AS half_hour FROM grid)
        LEFT JOIN (SELECT index_date, index_time, ret AS log_ret FROM obs) USING (index_date, index_time)
        LEFT JOIN (SELECT CAST(least((index_time - 30600) // 1800 + 1, 13) AS BIGINT) AS half_hour,
            avg(ret) AS mean FROM obs WHERE ret IS NOT NULL AND NOT isnan(ret) GROUP BY 1) USING (half_hour)""".replace(
            "FROM obs",
            f"""FROM (SELECT index_date, index_time, {ln('last_price')} - lag({ln('last_price')})
                OVER (PARTITION BY index_date ORDER BY index_time) AS ret FROM session_tape)""",
        ),
        "grid",
        "session_tape",
    ),
)
def half_hour_mean_pad(spark, folder):
    ticks = inputs.staged_tape(spark, folder)
    padded = returns.half_hour_mean_pad(ticks, grid.session_grid(ticks))
    return padded.select("index_date", "index_time", "half_hour", "was_missing", "log_ret")


# --- from raw bars to the table of returns ------------------------------------------


def _raw_bars(spark, folder):
    """The events of each minute as a bar with the 23 columns of a raw file."""
    value, none = F.col("value"), F.lit(None)
    moment = inputs.moment_in_minute(F.col("ts"), F.col("event_id"))
    bars = (
        inputs.events(spark, folder)
        .groupBy(F.date_format(F.to_date("ts"), "yyyyMMdd").cast("double").alias("d"), minute_of_day(F.col("ts")).alias("t"))
        .agg(
            F.min_by(value, moment).alias("o"),
            F.max(value).alias("h"),
            F.min(value).alias("l"),
            F.max_by(value, moment).alias("c"),
            F.sum(inputs.cents(value)).alias("v"),
            F.avg(value).alias("a"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    columns = [F.lit(".X"), "d", "t", F.lit("Intraday 1Min"), "o", "h", "l", "c", "v", "a", none, "n"]
    columns += [none] * 5 + [F.lit(0)] + [none] * 4 + [F.lit(0)]
    return bars.select(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)])


@query(
    "prepare_returns",
    statement(
        f"""SELECT s.*, {r('log_ret')} AS log_ret, q AS volume, r.no_trades FROM ({_SIGNATURE}) s
        JOIN returns r USING (index_date, index_time) LEFT JOIN tape USING (index_date, index_time)""",
        "returns",
    ),
)
def prepare_returns(spark, folder):
    ticks = inputs.stage(prepare.ticks_from_bars(_raw_bars(spark, folder)), "ticks")
    return prepare.prepare_returns(ticks, inputs.THRESHOLD)


@query(
    "prepare_returns_unpadded",
    statement(
        f"""SELECT trade_id, index_date, index_time, {r('last_price')} AS last_price,
            CAST(index_date <> lag(index_date) OVER w AS BIGINT) AS day_change,
            {r(clip("(CASE WHEN index_date = lag(index_date) OVER w THEN ret ELSE 0.0 END)"))} AS log_ret
        FROM (SELECT *, row_number() OVER (ORDER BY index_date, index_time) AS trade_id,
            {ln('last_price')} - lag({ln('last_price')}) OVER (ORDER BY index_date, index_time) AS ret FROM tape)
        WHERE index_time BETWEEN 30600 AND 54000 WINDOW w AS (ORDER BY index_date, index_time)""",
        "tape",
    ),
)
def prepare_returns_unpadded(spark, folder):
    ticks = inputs.tape(spark, folder).select("index_date", "index_time", "last_price")
    return prepare.prepare_returns_unpadded(ticks, inputs.THRESHOLD)


# --- the same over several series at once ---------------------------------------------

_KEYED = """WITH tape AS (SELECT event_type, CAST(ts AS DATE) AS index_date,
        CAST(hour(ts) * 3600 + minute(ts) * 60 AS BIGINT) AS index_time,
        arg_max(value, row(ts, event_id)) AS last_price FROM events GROUP BY 1, 2, 3),
    grid AS (SELECT event_type, index_date, CAST(m.t AS BIGINT) AS index_time
        FROM (SELECT DISTINCT event_type, index_date FROM tape), range(30600, 54001, 60) AS m(t)),
    padded AS (SELECT event_type, index_date, index_time, coalesce(
            last_value(last_price IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY index_date, index_time
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(last_price IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY index_date, index_time
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS last_price
        FROM grid LEFT JOIN tape USING (event_type, index_date, index_time))
    """


@query(
    "pad_session_by_key",
    _KEYED + f"SELECT event_type, index_date, index_time, {r('last_price')} AS last_price FROM padded",
)
def pad_session_by_key(spark, folder):
    return inputs.padded(spark, folder, keys=["event_type"])


@query(
    "log_return_by_key",
    _KEYED
    + f"""SELECT event_type, index_date, index_time, {r(f'{ln("last_price")} - lag({ln("last_price")}) OVER w')} AS log_ret
        FROM padded WINDOW w AS (PARTITION BY event_type ORDER BY index_date, index_time)""",
)
def log_return_by_key(spark, folder):
    series = inputs.stage(inputs.padded(spark, folder, keys=["event_type"]), "padded")
    axis = ordered.minute_axis(["event_type"])
    return returns.log_returns(series, overnight="include", axis=axis).drop("last_price")
