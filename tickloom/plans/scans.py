"""Queries over readers, writers and table shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import week_of_year
from ..operators.grid import with_index
from ..operators.profile import profile_schema
from ..operators.reshape import bind_rows
from ..schemas import INDICES, NA_TOKENS, ORDERS
from ..session import staging_path
from ..sources import files
from . import inputs
from .registry import query
from .sql import MOMENT, r, statement


@query("scan_parquet", f"SELECT event_id, ts, user_id, event_type, {r('value')} AS value FROM events")
def scan_parquet(spark, folder):
    return inputs.events(spark, folder).select("event_id", "ts", "user_id", "event_type", "value")


@query(
    "scan_csv",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, {r('o_totalprice')} AS o_totalprice,
        o_orderdate, o_orderpriority FROM orders""",
)
def scan_csv(spark, folder):
    path = staging_path(spark, "csv")
    files.sink_csv_overwrite(inputs.orders(spark, folder), path)
    return files.scan_csv(spark, path, ORDERS)


@query(
    "scan_csv_dir",
    f"""SELECT o_orderkey, {r('o_totalprice')} AS o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority
        FROM orders WHERE o_orderstatus = 'F'
        UNION ALL
        SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""",
)
def scan_csv_dir(spark, folder):
    """One directory of part files with three headers: two orders, and a column missing in each."""
    orders = inputs.orders(spark, folder)
    path = staging_path(spark, "csv-parts")
    done, rest = orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'")
    parts = (
        done.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice"),
        done.filter("o_orderkey % 2 <> 0").select("o_totalprice", "o_orderkey"),
        rest.select("o_orderkey", "o_orderpriority"),
    )
    for n, part in enumerate(parts):
        files.sink_csv_overwrite(part, f"{path}/part-{n}")
    return files.scan_csv_directory(spark, path, "o_orderkey bigint, o_totalprice double, o_orderpriority string")


@query(
    "scan_na_tokens",
    f"""SELECT CAST(o_orderdate AS DATE) AS date,
        CASE WHEN o_orderkey % 7 <> 0 THEN {r('o_totalprice')} END AS mexbol_ipc,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey / 4.0 END AS vimex,
        CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN o_orderkey + 0.5::DOUBLE END AS ipc_vix
        FROM orders""",
)
def scan_na_tokens(spark, folder):
    key = F.col("o_orderkey")
    first, second = NA_TOKENS
    text = inputs.orders(spark, folder).select(
        F.to_date("o_orderdate").cast("string").alias("Date"),
        F.when(key % 7 == 0, first).otherwise(F.col("o_totalprice").cast("string")).alias("Index"),
        F.when(key % 11 == 0, second)
        .otherwise((F.col("o_custkey") / F.lit(4.0)).cast("string"))
        .alias("Level"),
        F.when(key % 7 == 0, first)
        .when(key % 11 == 0, second)
        .otherwise((key + F.lit(0.5)).cast("string"))
        .alias("Other level"),
    )
    path = staging_path(spark, "indices")
    files.sink_csv_overwrite(text, path)
    return files.scan_na_tokens(spark, path, INDICES)


@query(
    "sink_parquet",
    statement(
        f"""SELECT {MOMENT} AS index, CAST(year(index_date) AS BIGINT) AS year,
            {r('last_price')} AS last_price, {r('log_ret')} AS log_ret FROM returns""",
        "returns",
    ),
)
def sink_parquet(spark, folder):
    table = with_index(inputs.returns(spark, folder)).withColumn("year", F.year("index_date"))
    path = staging_path(spark, "returns")
    files.sink_parquet(table.select("index", "last_price", "log_ret", "year"), path, ["year"])
    return files.scan_parquet(
        spark, path, "index timestamp_ntz, last_price double, log_ret double, year int"
    )


@query(
    "sink_csv_overwrite",
    f"SELECT o_orderkey, {r('o_totalprice')} AS o_totalprice, o_orderstatus FROM orders",
)
def sink_csv_overwrite(spark, folder):
    table = inputs.orders(spark, folder).select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = staging_path(spark, "overwritten")
    files.sink_csv_overwrite(table.withColumn("o_totalprice", F.lit(0.0)), path)
    files.sink_csv_overwrite(table, path)
    return files.scan_csv(spark, path, table.schema)


_EVENT_TYPES = {
    "event_id": "bigint",
    "ts": "timestamp_ntz",
    "user_id": "bigint",
    "event_type": "string",
    "value": "double",
    "props": "string",
}


@query(
    "profile_schema",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS "type", count(*) AS "rows",
        CAST(arg_min({c}, event_id) AS VARCHAR) AS sample FROM events"""
        for c, t in _EVENT_TYPES.items()
    ),
)
def profile(spark, folder):
    return profile_schema(inputs.events(spark, folder), "event_id")


@query(
    "bind_rows",
    statement(
        f"""SELECT index_date, index_time, {r('last_price')} AS last_price, CAST(NULL AS BIGINT) AS no_trades
        FROM session_tape UNION ALL
        SELECT index_date, index_time, NULL, no_trades FROM tape WHERE index_time NOT BETWEEN 30600 AND 54000""",
        "session_tape",
    ),
)
def bind(spark, folder):
    tape = inputs.staged_tape(spark, folder, ["last_price", "no_trades"])
    slot = ["index_date", "index_time"]
    inside = F.col("index_time").between(30600, 54000)
    return bind_rows(
        tape.filter(inside).select(*slot, "last_price"), tape.filter(~inside).select(*slot, "no_trades")
    )


@query(
    "week_partitions",
    """SELECT CAST(floor((dayofyear(l_shipdate) - 1) / 7) + 1 AS BIGINT) AS week, count(*) AS n,
        count(DISTINCT CAST(l_shipdate AS DATE)) AS dates FROM lineitem
        WHERE week BETWEEN 10 AND 12 GROUP BY 1""",
)
def week_partitions(spark, folder):
    """A partitioned sink read back with a filter that prunes its folders."""
    day = F.to_date("l_shipdate")
    table = inputs.lineitem(spark, folder).select(day.alias("day"), week_of_year(day).alias("week"))
    path = staging_path(spark, "weeks")
    files.sink_parquet(table, path, ["week"])
    back = files.scan_parquet(spark, path, "day date, week int")
    return (
        back.filter(F.col("week").between(10, 12))
        .groupBy("week")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("dates"))
    )
