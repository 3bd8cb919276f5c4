"""Queries over counts, summaries, sorting and reshaping."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import clock
from ..functions.calendar import HALF_HOUR_LABELS, week_of_year
from ..operators import datesets, profile, reshape, volume
from ..operators.grid import date_semi_join, grid_left_join, session_grid
from ..operators.quantiles import grouped_quantiles
from ..operators.ranking import row_id
from . import inputs
from .registry import query
from .sql import CENTS, MINUTE_OF_DAY, r, statement


@query("count_by_hour", "SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1")
def count_by_hour(spark, folder):
    return reshape.sorted_counts(inputs.events(spark, folder).select(F.hour("ts").alias("hour")), "hour")


@query(
    "count_by_minute_in_hour",
    """SELECT CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute, count(*) AS n
        FROM events WHERE hour(ts) IN (8, 15) GROUP BY 1, 2""",
)
def count_by_minute_in_hour(spark, folder):
    timed = inputs.events(spark, folder).select(F.hour("ts").alias("hour"), F.minute("ts").alias("minute"))
    return reshape.sorted_counts(timed.filter(F.col("hour").isin(8, 15)), "hour", "minute")


@query(
    "count_by_date",
    statement(
        """SELECT date_count, count(*) AS n_dates FROM (
            SELECT index_date, count(*) AS date_count FROM padded GROUP BY 1) GROUP BY 1""",
        "padded",
    ),
)
def count_by_date(spark, folder):
    by_date = inputs.padded(spark, folder).groupBy("index_date").agg(F.count(F.lit(1)).alias("date_count"))
    return by_date.groupBy("date_count").agg(F.count(F.lit(1)).alias("n_dates"))


@query("count_by_time", statement("SELECT index_time, count(*) AS n FROM tape GROUP BY 1", "tape"))
def count_by_time(spark, folder):
    return inputs.tape(spark, folder).groupBy("index_time").agg(F.count(F.lit(1)).alias("n")).orderBy(
        "n", "index_time"
    )


@query(
    "distinct_dates",
    """SELECT count(DISTINCT CAST(ts AS DATE)) AS all_dates,
        count(DISTINCT CASE WHEN value > 150 THEN CAST(ts AS DATE) END) AS high_dates,
        count(DISTINCT CAST(ts AS DATE)) - count(DISTINCT CASE WHEN value > 150 THEN CAST(ts AS DATE) END)
            AS missing_dates FROM events""",
)
def distinct_dates(spark, folder):
    # One row per date first, so that the exact count needs no distinct over the events.
    by_date = (
        inputs.events(spark, folder)
        .groupBy(F.to_date("ts").alias("date"))
        .agg(F.max((F.col("value") > 150).cast("int")).alias("_high"))
    )
    return by_date.agg(
        F.count(F.lit(1)).alias("all_dates"),
        F.count_if(F.col("_high") == 1).alias("high_dates"),
        F.count_if(F.col("_high") == 0).alias("missing_dates"),
    )


@query(
    "rows_lost",
    statement(
        """SELECT CAST(sum(a) AS BIGINT) AS rows_before, CAST(sum(k) AS BIGINT) AS rows_after,
            CAST(sum(a - k) AS BIGINT) AS rows_lost, count(*) FILTER (WHERE k = 0) AS dates_lost FROM (
            SELECT index_date, count(*) AS a,
                count(*) FILTER (WHERE index_time BETWEEN 30600 AND 54000) AS k FROM tape GROUP BY 1)""",
        "tape",
    ),
)
def rows_lost(spark, folder):
    return profile.rows_lost(inputs.tape(spark, folder), clock.in_session(F.col("index_time")))


@query(
    "edges",
    f"""(SELECT 'first' AS edge, event_id, ts, {r('value')} AS value FROM events ORDER BY ts, event_id LIMIT 1)
        UNION ALL
        (SELECT 'last', event_id, ts, {r('value')} FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)""",
)
def edges(spark, folder):
    return profile.edges(inputs.events(spark, folder).select("event_id", "ts", "value"), ["ts", "event_id"])


_SUMMARY = f"""SELECT unnest(['Min', 'Median', 'Mean', 'Max', 'Standard Dev']) AS measure,
    unnest([{r('min(new_volume)')}, {r('median(new_volume)')}, {r('avg(new_volume)')},
        {r('max(new_volume)')}, {r('stddev_samp(new_volume)')}]) AS value FROM clean"""


@query("volume_summary", statement(_SUMMARY, "clean"))
def volume_summary(spark, folder):
    return profile.summary_long(inputs.clean_volume(spark, folder), "new_volume")


@query(
    "unpivot_summary",
    f"""SELECT unnest(['rows', 'smallest', 'largest', 'average']) AS measure,
        unnest([CAST(count(*) AS DOUBLE), {r('min(l_extendedprice)')}, {r('max(l_extendedprice)')},
            {r('avg(l_quantity)')}]) AS value FROM lineitem""",
)
def unpivot_summary(spark, folder):
    wide = inputs.lineitem(spark, folder).agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.min("l_extendedprice").alias("smallest"),
        F.max("l_extendedprice").alias("largest"),
        F.avg("l_quantity").alias("average"),
    )
    return wide.unpivot([], wide.columns, "measure", "value")


_CLEAN_BY_KEY = f"""WITH slots AS (
    SELECT event_type, CAST(ts AS DATE) AS index_date, {MINUTE_OF_DAY} AS index_time, count(*) AS no_trades,
        CAST(sum({CENTS}) AS BIGINT) AS q FROM events GROUP BY 1, 2, 3
), accumulated AS (
    SELECT *, CAST(sum(q) OVER (PARTITION BY event_type, index_date ORDER BY index_time
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 200000 AS BIGINT) AS volume,
        index_date <> lag(index_date) OVER (PARTITION BY event_type ORDER BY index_date, index_time) AS fresh
    FROM slots WHERE index_time BETWEEN 30600 AND 54000
), clean AS (
    SELECT * FROM (SELECT *, CASE WHEN fresh THEN volume WHEN NOT fresh THEN volume - lag(volume)
        OVER (PARTITION BY event_type ORDER BY index_date, index_time) END AS new_volume FROM accumulated)
    WHERE new_volume > 0
)
"""


@query(
    "volume_summary_by_key",
    _CLEAN_BY_KEY
    + f"""SELECT event_type, unnest(['Min', 'Median', 'Mean', 'Max', 'Standard Dev']) AS measure,
        unnest([{r('min(new_volume)')}, {r('median(new_volume)')}, {r('avg(new_volume)')},
            {r('max(new_volume)')}, {r('stddev_samp(new_volume)')}]) AS value FROM clean GROUP BY 1""",
)
def volume_summary_by_key(spark, folder):
    keys = ["event_type"]
    return profile.summary_long(inputs.clean_volume(spark, folder, keys), "new_volume", keys)


_PRICES = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "quantiles_by_key",
    "\nUNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS "column", CAST({p} AS DOUBLE) AS p, {r(f'quantile_cont({c}, {p})')} AS quantile
        FROM lineitem GROUP BY 1"""
        for c in _PRICES
        for p in (0, 0.25, 0.5, 0.75, 0.99, 1)
    ),
)
def quantiles_by_key(spark, folder):
    items = inputs.lineitem(spark, folder)
    return grouped_quantiles(items, _PRICES, [0, 0.25, 0.5, 0.75, 0.99, 1], ["l_returnflag"])


@query(
    "distinct_dates_by_key",
    """SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS all_dates,
        count(DISTINCT CASE WHEN value > 150 THEN CAST(ts AS DATE) END) AS high_dates,
        count(DISTINCT CAST(ts AS DATE)) - count(DISTINCT CASE WHEN value > 150 THEN CAST(ts AS DATE) END)
            AS missing_dates FROM events GROUP BY 1""",
)
def distinct_dates_by_key(spark, folder):
    keys = ["event_type"]
    sets = datesets.date_sets(inputs.events(spark, folder), keys, "ts", high=F.col("value") > 150)
    counts = datesets.sizes(sets, keys)
    return counts.select(
        *keys,
        F.col("dates").alias("all_dates"),
        F.col("high").alias("high_dates"),
        (F.col("dates") - F.col("high")).alias("missing_dates"),
    )


@query(
    "missing_dates_by_key",
    """SELECT user_id, count(*) AS all_dates, count(o) AS found_dates, count(*) - count(o) AS missing_dates FROM (
        SELECT user_id, e.date, o.date AS o FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events) e
        LEFT JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'view') o USING (user_id, date))
    GROUP BY 1""",
)
def missing_dates_by_key(spark, folder):
    """Dates on which a user was active without a view, from the sets of two tables."""
    keys, events = ["user_id"], inputs.events(spark, folder)
    views = datesets.date_sets(events.filter("event_type = 'view'"), keys, "ts")
    everything = datesets.date_sets(events, keys, "ts")
    # of the views only dates that are in the table count as found
    return datesets.missing_dates(everything, views, keys)


@query(
    "rows_lost_by_key",
    """SELECT event_type, CAST(sum(a) AS BIGINT) AS rows_before, CAST(sum(k) AS BIGINT) AS rows_after,
        CAST(sum(a - k) AS BIGINT) AS rows_lost, count(*) FILTER (WHERE k = 0) AS dates_lost FROM (
        SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS a, count(*) FILTER (WHERE value > 150) AS k
        FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def rows_lost_by_key(spark, folder):
    events = inputs.events(spark, folder).withColumn("index_date", F.to_date("ts"))
    return profile.rows_lost(events, F.col("value") > 150, keys=["event_type"])


@query(
    "edges_by_key",
    f"""SELECT CASE WHEN a = 1 THEN 'first' ELSE 'last' END AS edge, event_type, event_id, ts, {r('value')} AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS a,
            row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS z FROM events)
    WHERE a = 1 OR z = 1""",
)
def edges_by_key(spark, folder):
    rows = inputs.events(spark, folder).select("event_type", "event_id", "ts", "value")
    return profile.edges(rows, ["ts", "event_id"], ["event_type"])


_LABELS = "CAST(least((index_time - 30600) // 1800 + 1, 13) AS BIGINT)"


# The buckets' names, first to last.
_NAMES = "[" + ", ".join(f"'{HALF_HOUR_LABELS[i]}'" for i in range(13)) + "]"


@query(
    "mean_by_subgrid",
    statement(
        f"""SELECT {_LABELS} AS subgrid, {_NAMES}[{_LABELS}] AS subgrid_id, {r('avg(new_volume)')} AS mean_volume
        FROM clean GROUP BY 1, 2""",
        "clean",
    ),
)
def mean_by_subgrid(spark, folder):
    return volume.mean_by_half_hour(inputs.clean_volume(spark, folder))


@query(
    "mean_by_subgrid_by_key",
    _CLEAN_BY_KEY
    + f"""SELECT event_type, {_LABELS} AS subgrid, {_NAMES}[{_LABELS}] AS subgrid_id, {r('avg(new_volume)')} AS mean_volume
    FROM clean GROUP BY 1, 2, 3""",
)
def mean_by_subgrid_by_key(spark, folder):
    keys = ["event_type"]
    return volume.mean_by_half_hour(inputs.clean_volume(spark, folder, keys), keys=keys)


@query(
    "mean_by_week",
    statement(
        f"""SELECT CAST((dayofyear(index_date) - 1) // 7 + 1 AS BIGINT) AS week,
            {r('avg(new_volume)')} AS average_volume FROM clean GROUP BY 1""",
        "clean",
    ),
)
def mean_by_week(spark, folder):
    return volume.mean_by_week(inputs.clean_volume(spark, folder))


_WEEK_MEANS = f"""SELECT CAST((dayofyear(l_shipdate) - 1) // 7 + 1 AS BIGINT) AS week,
    sum(CAST(l_quantity AS BIGINT)) / count(*) AS m FROM lineitem GROUP BY 1"""


@query(
    "mean_by_weekday",
    statement(
        f"""SELECT CAST(isodow(index_date) AS BIGINT) AS wday, strftime(index_date, '%a') AS wday_label,
            {r('avg(new_volume)')} AS avg_vol FROM clean GROUP BY 1, 2""",
        "clean",
    ),
)
def mean_by_weekday(spark, folder):
    return volume.mean_by_weekday(inputs.clean_volume(spark, folder))


@query(
    "order_by_metric",
    f"""SELECT week, {r('m')} AS average_volume, row_number() OVER (ORDER BY m DESC, week) AS place
        FROM ({_WEEK_MEANS})""",
)
def order_by_metric(spark, folder):
    items = inputs.lineitem(spark, folder).select(
        F.to_date("l_shipdate").alias("index_date"), F.col("l_quantity").cast("bigint").alias("new_volume")
    )
    week = week_of_year(F.col("index_date")).alias("week")
    means = volume.mean_by(items, "new_volume", [week], "average_volume")
    # At most 53 rows.
    best_first = Window.orderBy(F.desc("average_volume"), "week")
    return means.withColumn("place", F.row_number().over(best_first))


_FACTORS = ("l_returnflag", "l_linestatus")
_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _skim_number(c):
    q = ", ".join(f"{r(f'quantile_cont({c}, {p})', 7)} AS p{int(100 * p)}" for p in (0, 0.25, 0.5, 0.75, 1))
    bins = " || ',' || ".join(
        f"CAST(count(*) FILTER (WHERE least(floor(5 * ({c} - lo) / (hi - lo)) + 1, 5) = {b}) AS VARCHAR)"
        for b in range(1, 6)
    )
    return f"""SELECT '{c}' AS "column", 'numeric' AS kind, count(*) FILTER (WHERE {c} IS NULL) AS n_missing,
        {r(f'count({c}) / count(*)', 7)} AS complete_rate, {r(f'avg({c})', 7)} AS mean, {r(f'stddev_samp({c})', 7)} AS sd,
        {q}, {bins} AS hist, CAST(NULL AS DATE) AS date_min, CAST(NULL AS DATE) AS date_median,
        CAST(NULL AS DATE) AS date_max, CAST(NULL AS BIGINT) AS n_unique, CAST(NULL AS VARCHAR) AS top_counts
        FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem)"""


def _skim_other(c, kind, dates, unique, tops):
    return f"""SELECT '{c}', '{kind}', count(*) FILTER (WHERE {c} IS NULL), {r(f'count({c}) / count(*)', 7)},
        NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {dates}, {unique}, {tops} FROM lineitem"""


def _top(c):
    return f"""(SELECT string_agg(l || ': ' || n, ', ' ORDER BY n DESC, l) FROM (
        SELECT {c} AS l, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, l LIMIT 3))"""


_DAY = "CAST(l_shipdate AS DATE)"
_DAYS = "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))"
_SKIM = "\nUNION ALL ".join(
    [
        *[_skim_number(c) for c in _NUMBERS],
        _skim_other(
            "l_shipdate",
            "date",
            f"min({_DAY}), DATE '1970-01-01' + CAST(floor(quantile_cont({_DAYS}, 0.5)) AS INTEGER), max({_DAY})",
            f"count(DISTINCT {_DAY})",
            "NULL",
        ),
        *[_skim_other(c, "factor", "NULL, NULL, NULL", f"count(DISTINCT {c})", _top(c)) for c in _FACTORS],
    ]
)


@query("table_skim", _SKIM, digits=7)
def table_skim(spark, folder):
    return profile.table_skim(inputs.lineitem(spark, folder), _NUMBERS, ["l_shipdate"], _FACTORS)


@query(
    "log_histogram",
    statement(
        """SELECT CAST(least(floor(50 * (x - 5) / (20.0::DOUBLE - 5)) + 1, 50) AS BIGINT) AS bin, count(*) AS n
        FROM (SELECT ln(new_volume) AS x FROM clean) WHERE x BETWEEN 5 AND 20 GROUP BY 1""",
        "clean",
    ),
)
def log_histogram(spark, folder):
    clean = inputs.clean_volume(spark, folder)
    return profile.histogram(clean, F.log("new_volume"), F.lit(5.0), F.lit(20.0), 50)


@query(
    "log_histogram_by_year",
    """SELECT year, CAST(least(floor(50 * (x - lo) / (hi - lo)) + 1, 50) AS BIGINT) AS bin, count(*) AS n FROM (
        SELECT *, min(x) OVER (PARTITION BY year) AS lo, max(x) OVER (PARTITION BY year) AS hi FROM (
            SELECT CAST(year(l_shipdate) AS BIGINT) AS year, ln(l_extendedprice) AS x FROM lineitem
            WHERE year(l_shipdate) >= 1997 AND l_extendedprice > 0))
        GROUP BY 1, 2""",
)
def log_histogram_by_year(spark, folder):
    items = (
        inputs.lineitem(spark, folder)
        .filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_extendedprice") > 0))
        .select(F.year("l_shipdate").alias("year"), F.log("l_extendedprice").alias("x"))
    )
    return profile.histogram_free_range(items, "x", 50, ["year"])


@query(
    "sort_asc_desc",
    statement(
        """SELECT index_date, index_time, no_trades,
            row_number() OVER (ORDER BY no_trades DESC NULLS LAST, index_date, index_time) AS place
        FROM joined""",
        "joined",
    ),
)
def sort_asc_desc(spark, folder):
    """The whole grid in descending order, missing values last, with each row's place."""
    ticks = inputs.staged_tape(spark, folder, ["no_trades"])
    order = [reshape.descending("no_trades"), reshape.ascending("index_date"), reshape.ascending("index_time")]
    rows = grid_left_join(session_grid(ticks), ticks).select("index_date", "index_time", "no_trades")
    return row_id(rows, "place", order)


@query(
    "head_tail",
    statement(
        """(SELECT 'head' AS part, index_time FROM (SELECT DISTINCT index_time FROM tape)
            ORDER BY index_time LIMIT 6) UNION ALL
        (SELECT 'tail', index_time FROM (SELECT DISTINCT index_time FROM tape)
            ORDER BY index_time DESC LIMIT 6)""",
        "tape",
    ),
)
def head_tail(spark, folder):
    times = inputs.events(spark, folder).select(clock.minute_of_day(F.col("ts")).alias("index_time")).distinct()
    first, last = reshape.head(times, 6, "index_time"), reshape.tail(times, 6, "index_time")
    return first.select(F.lit("head").alias("part"), "index_time").unionByName(
        last.select(F.lit("tail").alias("part"), "index_time")
    )


@query(
    "sorted_counts",
    "SELECT event_type, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1, 2",
)
def sorted_counts(spark, folder):
    timed = inputs.events(spark, folder).select("event_type", F.hour("ts").alias("hour"))
    return reshape.sorted_counts(timed, "event_type", "hour")


@query(
    "distinct_rows",
    "SELECT DISTINCT event_type, CAST(isodow(ts) AS BIGINT) AS wday, CAST(hour(ts) AS BIGINT) AS hour FROM events",
)
def distinct_rows(spark, folder):
    return (
        inputs.events(spark, folder)
        .select("event_type", (F.weekday("ts") + 1).alias("wday"), F.hour("ts").alias("hour"))
        .distinct()
    )


@query(
    "unpivot_indices",
    statement(
        f"""SELECT date, unnest(['mexbol_ipc', 'vimex', 'ipc_vix']) AS name,
            unnest([{r('turnover')}, {r('n_orders')}, {r('largest_cents / 100.0')}]) AS value FROM daily""",
        "daily",
    ),
)
def unpivot_indices(spark, folder):
    wide = inputs.daily(spark, folder).select(
        "date",
        F.col("turnover").alias("mexbol_ipc"),
        F.col("n_orders").cast("double").alias("vimex"),
        (F.col("largest_cents") / 100).alias("ipc_vix"),
        F.col("turnover_cents").alias("other"),
    )
    return reshape.unpivot_matching(wide, ["date"], "x")


@query(
    "date_semi_join",
    """SELECT CAST(l_shipdate AS DATE) AS index_date, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
        FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (
            SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)
        GROUP BY 1""",
)
def semi_join(spark, folder):
    urgent = inputs.orders(spark, folder).filter("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
    dates = urgent.select(F.to_date("o_orderdate").alias("index_date"))
    items = inputs.lineitem(spark, folder).select(F.to_date("l_shipdate").alias("index_date"), "l_quantity")
    return (
        date_semi_join(items, dates)
        .groupBy("index_date")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    )
