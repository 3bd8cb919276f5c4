"""Queries over projections, predicates and calendar functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import calendar, clock, numeric
from ..operators.profile import drop_null_columns, null_counts
from ..operators.ranking import every_kth_row, row_id
from ..operators.reshape import relocate, rename_positional
from ..operators.variance import drop_zero_rv, realized_variance
from ..operators.grid import grid_left_join, session_grid
from . import inputs
from .registry import query
from .sql import MOMENT, r, statement

# --- projections, renames, casts -------------------------------------------------


@query(
    "rename_positional",
    f"""SELECT event_id AS id, ts AS moment, user_id AS trader, event_type AS kind,
        {r('value')} AS last_price, props AS note FROM events""",
)
def positional(spark, folder):
    return rename_positional(
        inputs.events(spark, folder), ["id", "moment", "trader", "kind", "last_price", "note"]
    )


def _joined(spark, folder):
    ticks = inputs.staged_tape(spark, folder, ["last_price", "no_trades"])
    return grid_left_join(session_grid(ticks), ticks)


@query(
    "null_counts",
    statement(
        """SELECT "column", count(*) FILTER (WHERE missing) AS no_missing FROM (
            SELECT unnest(['index_date', 'index_time', 'last_price', 'no_trades']) AS "column",
                unnest([index_date IS NULL, index_time IS NULL, last_price IS NULL, no_trades IS NULL]) AS missing
            FROM joined) GROUP BY 1""",
        "joined",
    ),
)
def nulls(spark, folder):
    return null_counts(_joined(spark, folder))


@query(
    "drop_null_columns",
    f"SELECT event_id, ts, user_id, event_type, {r('value')} AS value FROM events",
)
def drop_nulls(spark, folder):
    events = inputs.events(spark, folder).drop("props")
    gappy = events.withColumns(
        {
            "vwap": F.lit(None).cast("double"),
            "open_bid": F.when(F.col("event_id") % 3 == 0, F.col("value")),
        }
    )
    return drop_null_columns(gappy, "any")


@query(
    "drop_all_null_columns",
    f"""SELECT event_id, {r('value')} AS value,
        CASE WHEN event_id % 3 = 0 THEN {r('value')} END AS open_bid FROM events""",
)
def drop_all_nulls(spark, folder):
    gappy = inputs.events(spark, folder).select(
        "event_id",
        "value",
        F.lit(None).cast("double").alias("vwap"),
        F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("open_bid"),
    )
    return drop_null_columns(gappy, "all")


@query(
    "parse_date_int",
    """SELECT o_orderkey, CAST(CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS DOUBLE) AS raw_date,
        CAST(o_orderdate AS DATE) AS tidy_date FROM orders""",
)
def parse_date(spark, folder):
    raw = inputs.orders(spark, folder).select(
        "o_orderkey", F.date_format(F.to_date("o_orderdate"), "yyyyMMdd").cast("double").alias("raw_date")
    )
    return raw.withColumn("tidy_date", clock.parse_date_number(F.col("raw_date")))


@query(
    "time_of_day",
    """SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS tidy_time,
        strftime(ts, '%H:%M:%S') AS tidy_text,
        CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS parsed_time FROM events""",
)
def time_of_day(spark, folder):
    timed = inputs.events(spark, folder).select("event_id", clock.time_of_day(F.col("ts")).alias("tidy_time"))
    return timed.withColumn("tidy_text", clock.clock_text(F.col("tidy_time"))).withColumn(
        "parsed_time", clock.parse_time_of_day(F.col("tidy_text"))
    )


@query("combine_datetime", "SELECT event_id, date_trunc('second', ts) AS tidy_dttm FROM events")
def combine_datetime(spark, folder):
    ts = F.col("ts")
    parts = inputs.events(spark, folder).select(
        "event_id", F.to_date(ts).alias("tidy_date"), clock.time_of_day(ts).alias("tidy_time")
    )
    return parts.select("event_id", clock.moment(F.col("tidy_date"), F.col("tidy_time")).alias("tidy_dttm"))


@query(
    "drop_rename_relocate",
    f"""SELECT CAST(ts AS DATE) AS tidy_date, CAST(hour(ts) AS BIGINT) AS tidy_hour, event_id,
        {r('value')} AS last_price FROM events""",
)
def drop_rename_relocate(spark, folder):
    wide = inputs.events(spark, folder).select(
        "event_id",
        F.col("value").alias("last"),
        "props",
        F.to_date("ts").alias("tidy_date"),
        F.hour("ts").alias("tidy_hour"),
    )
    return relocate(wide.drop("props").withColumnRenamed("last", "last_price"), prefix="tidy")


@query("row_id", "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS trade_id FROM events")
def number_rows(spark, folder):
    return row_id(inputs.events(spark, folder).select("event_id", "ts"), "trade_id", ["ts", "event_id"])


@query(
    "row_id_by_key",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trade_id
    FROM events""",
)
def number_rows_by_key(spark, folder):
    rows = inputs.events(spark, folder).select("event_id", "user_id", "ts")
    return row_id(rows, "trade_id", ["ts", "event_id"], keys=["user_id"]).drop("ts")


@query(
    "every_kth_row_by_key",
    """SELECT event_id, event_type, ts FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)
    WHERE (n - 1) % 7 = 0""",
)
def every_seventh_event(spark, folder):
    rows = inputs.events(spark, folder).select("event_id", "event_type", "ts")
    return every_kth_row(rows, 7, ["ts", "event_id"], keys=["event_type"])


@query(
    "substr_time",
    """SELECT event_id, strftime(ts, '%H:%M:%S') AS time_text, strftime(ts, '%Y-%m-%d') AS date_text,
        substr(event_type, 1, 3) AS kind, substr(event_type, -3) AS kind_end FROM events""",
)
def substr_time(spark, folder):
    text = F.concat_ws(" ", F.to_date("ts"), clock.clock_text(clock.time_of_day(F.col("ts"))))
    return inputs.events(spark, folder).select(
        "event_id",
        F.substring(text, -8, 8).alias("time_text"),
        F.substring(text, 1, 10).alias("date_text"),
        F.substring("event_type", 1, 3).alias("kind"),
        F.substring("event_type", -3, 3).alias("kind_end"),
    )


@query(
    "format_text",
    """SELECT event_id, 'Volume on ' || strftime(ts, '%Y-%m-%d') AS title,
        concat_ws(' ', event_type, CAST(user_id AS VARCHAR)) AS label,
        'user ' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS padded FROM events""",
)
def format_text(spark, folder):
    return inputs.events(spark, folder).select(
        "event_id",
        F.concat(F.lit("Volume on "), F.to_date("ts").cast("string")).alias("title"),
        F.concat_ws(" ", "event_type", "user_id").alias("label"),
        F.format_string("user %06d", "user_id").alias("padded"),
    )


# --- filters ----------------------------------------------------------------------


@query(
    "session_filter",
    statement(
        f"SELECT {MOMENT} AS index, index_time, {r('last_price')} AS last_price FROM session_tape", "session_tape"
    ),
)
def session_filter(spark, folder):
    kept = inputs.tape(spark, folder).filter(clock.in_session(F.col("index_time")))
    return kept.select(
        clock.moment(F.col("index_date"), F.col("index_time")).alias("index"), "index_time", "last_price"
    )


@query(
    "filter_not_null",
    statement(
        f"""SELECT index_date, index_time, {r('log_ret')} AS log_ret FROM returns WHERE log_ret IS NOT NULL""",
        "returns",
    ),
)
def filter_not_null(spark, folder):
    known = inputs.returns(spark, folder).filter(F.col("log_ret").isNotNull())
    return known.select("index_date", "index_time", "log_ret")


@query(
    "filter_zero_volume",
    statement(
        "SELECT count(*) FILTER (WHERE volume <= 0) AS n_zero, count(*) AS n_rows FROM voltape", "voltape"
    ),
)
def filter_zero_volume(spark, folder):
    return inputs.voltape(spark, folder).agg(
        F.count_if(F.col("volume") <= 0).alias("n_zero"), F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "filter_day",
    f"SELECT event_id, ts, {r('value')} AS value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'",
)
def filter_day(spark, folder):
    # Bounds on the stored column reach the parquet scan; a filter on its date would not.
    day, following = F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-11").cast("timestamp_ntz")
    events = inputs.events(spark, folder).filter((F.col("ts") >= day) & (F.col("ts") < following))
    return events.select("event_id", "ts", "value")


@query(
    "filter_time_between",
    statement(
        f"""SELECT index_date, index_time, {r('last_price')} AS last_price FROM tape
        WHERE index_time BETWEEN 45300 AND 45900""",
        "tape",
    ),
)
def filter_time_between(spark, folder):
    noon = F.col("index_time").between(12 * 3600 + 35 * 60, 12 * 3600 + 45 * 60)
    return inputs.tape(spark, folder).filter(noon).select("index_date", "index_time", "last_price")


@query(
    "filter_date_range",
    f"""SELECT o_orderkey, o_orderdate, {r('o_totalprice')} AS o_totalprice FROM orders
        WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1998-01-01'""",
)
def filter_date_range(spark, folder):
    date = F.col("o_orderdate")
    low, high = F.lit("1996-03-01").cast("timestamp_ntz"), F.lit("1998-01-01").cast("timestamp_ntz")
    return inputs.orders(spark, folder).filter((date >= low) & (date < high)).select(
        "o_orderkey", "o_orderdate", "o_totalprice"
    )


@query(
    "drop_zero_rv",
    statement(
        f"""SELECT event_type, index_date, {r('rv')} AS rv FROM (
            SELECT event_type, CAST(ts AS DATE) AS index_date,
                sum(CASE WHEN value > 20 THEN value * value ELSE 0 END) AS rv
            FROM events GROUP BY 1, 2) WHERE rv <> 0"""
    ),
)
def drop_zero(spark, folder):
    large = F.when(F.col("value") > 20, F.col("value") * F.col("value")).otherwise(0.0)
    sums = inputs.events(spark, folder).groupBy("event_type", F.to_date("ts").alias("index_date"))
    return drop_zero_rv(sums.agg(F.sum(large).alias("rv")))


@query(
    "high_rv_days",
    statement(f"SELECT index_date, {r('rv')} AS rv FROM rv WHERE rv > 100", "rv"),
)
def high_rv_days(spark, folder):
    return inputs.daily_rv(spark, folder).filter(F.col("rv") > 100).select("index_date", "rv")


@query(
    "flag_columns",
    statement(
        """SELECT hour, minute, n, minute < 30 AS early, n > 10 AS busy, hour_code,
            hour_code BETWEEN 5 AND 10 AS core FROM (
            SELECT *, dense_rank() OVER (ORDER BY hour) AS hour_code FROM (
                SELECT index_time // 3600 AS hour, index_time // 60 % 60 AS minute,
                    CAST(sum(no_trades) AS BIGINT) AS n FROM tape GROUP BY 1, 2))""",
        "tape",
    ),
)
def flag_columns(spark, folder):
    ts = F.col("ts")
    counts = (
        inputs.events(spark, folder)
        .groupBy(F.hour(ts).alias("hour"), F.minute(ts).alias("minute"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most 1,440 rows, one per minute of the day.
    coded = counts.withColumn("hour_code", F.dense_rank().over(Window.orderBy("hour")))
    return coded.withColumns(
        {
            "early": F.col("minute") < 30,
            "busy": F.col("n") > 10,
            "core": F.col("hour_code").between(5, 10),
        }
    )


@query(
    "flag_returns",
    statement(
        """SELECT index_date, index_time, log_ret >= 0 AS gain, abs(log_ret) > 1 AS wide,
            last_price > 35 AS high FROM returns""",
        "returns",
    ),
)
def flag_returns(spark, folder):
    ret = F.col("log_ret")
    return inputs.returns(spark, folder).select(
        "index_date",
        "index_time",
        (ret >= 0).alias("gain"),
        (F.abs(ret) > 1).alias("wide"),
        (F.col("last_price") > 35).alias("high"),
    )


# --- calendar and scalar functions ------------------------------------------------


def _dates(spark, folder):
    """Every order with its date."""
    return inputs.orders(spark, folder).select("o_orderkey", F.to_date("o_orderdate").alias("d"))


def _calendar_query(name, columns, sql):
    """Register a query that adds calendar columns to the orders."""

    @query(name, f"SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, {sql} FROM orders")
    def run(spark, folder):
        return _dates(spark, folder).withColumns(columns(F.col("d")))

    return run


def _big(expression, name):
    return f"CAST({expression} AS BIGINT) AS {name}"


_calendar_query(
    "semester",
    lambda d: {"half": calendar.semester(d)},
    _big("CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END", "half"),
)
_calendar_query("quarter", lambda d: {"quarter": F.quarter(d)}, _big("quarter(o_orderdate)", "quarter"))
_calendar_query(
    "month_label",
    lambda d: {"month": F.month(d), "month_label": calendar.month_label(d)},
    _big("month(o_orderdate)", "month") + ", strftime(o_orderdate, '%b') AS month_label",
)
_calendar_query(
    "wday_iso", lambda d: {"wday": calendar.weekday_number(d)}, _big("isodow(o_orderdate)", "wday")
)
_calendar_query(
    "wday_label",
    lambda d: {"wday": calendar.weekday_number(d), "wday_label": calendar.weekday_label(d)},
    _big("isodow(o_orderdate)", "wday") + ", strftime(o_orderdate, '%a') AS wday_label",
)
_calendar_query(
    "qday",
    lambda d: {"qday": calendar.day_of_quarter(d)},
    _big("date_diff('day', date_trunc('quarter', o_orderdate), o_orderdate) + 1", "qday"),
)
_calendar_query("yday", lambda d: {"yday": F.dayofyear(d)}, _big("dayofyear(o_orderdate)", "yday"))
_calendar_query(
    "week",
    lambda d: {"week": calendar.week_of_year(d)},
    _big("(dayofyear(o_orderdate) - 1) // 7 + 1", "week"),
)
_calendar_query(
    "mweek",
    lambda d: {"mweek": calendar.week_of_month(d)},
    _big("(day(o_orderdate) + isodow(date_trunc('month', o_orderdate)) - 2) // 7 + 1", "mweek"),
)
_calendar_query(
    "mday7",
    lambda d: {"mday7": calendar.weekday_instance(d)},
    _big("(day(o_orderdate) - 1) // 7 + 1", "mday7"),
)


@query(
    "calendar_parts",
    "SELECT event_id, "
    + ", ".join(_big(f"{part}(ts)", part) for part in ("year", "month", "day", "hour", "minute"))
    + " FROM events",
)
def calendar_parts(spark, folder):
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute}
    return inputs.events(spark, folder).select("event_id", *[f("ts").alias(n) for n, f in parts.items()])


@query("epoch_seconds", f"SELECT event_id, {_big('floor(epoch(ts))', 'index_num')} FROM events")
def epoch(spark, folder):
    ts = F.col("ts")
    seconds = clock.epoch_seconds(F.to_date(ts), clock.time_of_day(ts))
    return inputs.events(spark, folder).select("event_id", seconds.alias("index_num"))


_HALF_HOUR = "least((index_time - 30600) // 1800 + 1, 13)"
LABELS_SQL = "[" + ", ".join(f"'{label}'" for label in calendar.HALF_HOUR_LABELS) + "]"


@query(
    "half_hour_bucket",
    statement(
        f"""SELECT index_date, index_time, CAST({_HALF_HOUR} AS BIGINT) AS subgrid,
            {LABELS_SQL}[{_HALF_HOUR}] AS subgrid_id FROM session_tape""",
        "session_tape",
    ),
)
def half_hour_bucket(spark, folder):
    bucket = calendar.half_hour_bucket(F.col("index_time"))
    return inputs.session_tape(spark, folder).select(
        "index_date",
        "index_time",
        bucket.alias("subgrid"),
        calendar.half_hour_label(bucket).alias("subgrid_id"),
    )


@query(
    "half_hour_bucket_legacy",
    statement(
        f"""SELECT index_date, index_time, CAST(CASE WHEN h = 8 THEN 1
            WHEN h BETWEEN 9 AND 13 THEN 2 * (h - 8) + CASE WHEN m >= 30 THEN 1 ELSE 0 END
            WHEN h = 14 THEN 12 ELSE 13 END AS BIGINT) AS tidy_half_hour
        FROM (SELECT *, index_time // 3600 AS h, index_time // 60 % 60 AS m FROM session_tape)""",
        "session_tape",
    ),
)
def half_hour_legacy(spark, folder):
    bucket = calendar.half_hour_bucket_legacy(F.col("index_time"))
    return inputs.session_tape(spark, folder).select("index_date", "index_time", bucket.alias("tidy_half_hour"))


@query(
    "math",
    f"""SELECT event_id, CASE WHEN value > 0 THEN {r('ln(value)')} END AS log_value,
        {r('abs(value - 20)')} AS distance, {r('sqrt(value)')} AS root,
        {r('value * value')} AS square, user_id % 7 AS remainder FROM events""",
)
def math(spark, folder):
    value = F.col("value")
    return inputs.events(spark, folder).select(
        "event_id",
        F.when(value > 0, numeric.natural_log(value)).alias("log_value"),
        F.abs(value - 20).alias("distance"),
        F.sqrt(value).alias("root"),
        (value * value).alias("square"),
        F.pmod("user_id", F.lit(7)).alias("remainder"),
    )


@query(
    "if_else",
    statement(
        """SELECT index_date, index_time,
            CASE WHEN no_trades IS NULL THEN NULL WHEN no_trades > 1 THEN 'many' ELSE 'one' END AS label
        FROM joined""",
        "joined",
    ),
)
def if_else(spark, folder):
    """Unknown in, unknown out."""
    label = numeric.if_else(F.col("no_trades") > 1, F.lit("many"), F.lit("one"))
    return _joined(spark, folder).select("index_date", "index_time", label.alias("label"))


@query(
    "case_when",
    statement(
        """SELECT index_date, index_time, CASE WHEN no_trades > 1 THEN 'many' WHEN no_trades = 1 THEN 'one'
            ELSE 'other' END AS label FROM joined""",
        "joined",
    ),
)
def case_when(spark, folder):
    """Unknown counts as false."""
    n = F.col("no_trades")
    label = F.when(n > 1, "many").when(n == 1, "one").otherwise("other")
    return _joined(spark, folder).select("index_date", "index_time", label.alias("label"))


@query(
    "annualise",
    statement(
        f"""SELECT index_date, {r('rv')} AS rv, {r('sqrt(252 * rv)')} AS root_of_year,
            {r('252 * sqrt(rv)')} AS year_of_root FROM rv""",
        "rv",
    ),
)
def annualise(spark, folder):
    rv = F.col("rv")
    daily = realized_variance(inputs.returns(spark, folder)).drop("rv_an")
    return daily.withColumns(
        {
            "root_of_year": numeric.annualise(rv, "sqrt_252_rv"),
            "year_of_root": numeric.annualise(rv, "252_sqrt_rv"),
        }
    )
