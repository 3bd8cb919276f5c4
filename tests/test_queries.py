"""Every registered query next to its SQL, and the shape of the plans."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.plans import inputs
from tickloom.plans.catalog import ORACLES, QUERIES
from tools.compare import differences, oracle

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return oracle(SMALL)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PASSIVE = ("Project", "Sort [", "Filter", "AQEShuffleRead", "ShuffleQueryStage", "ColumnarToRow")


def check_plan(text: str) -> None:
    """One-partition exchanges only over aggregated rows; no cross joins; no Python."""
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Python|Pandas|BatchEval", text)
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            active = next(l for l in lines[i + 1 :] if not l.lstrip(" :+-|*()0123456789").startswith(PASSIVE))
            assert re.search(r"Aggregate|TakeOrdered|Limit|LocalTableScan|ReusedExchange", active), (
                f"rows go to one partition:\n{line}\n{active}"
            )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    check_plan(plan(df))
    problem, _ = differences(df, duck, name)
    assert problem == ""


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filter_day"](spark, SMALL))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in text
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan(QUERIES["count_by_hour"](spark, SMALL))


def test_sparse_variance_does_not_shuffle_the_repeated_rows(spark):
    from tickloom.operators.variance import sparse_rv_calendar

    padded = inputs.stage(inputs.padded(spark, SMALL))
    lines = plan(sparse_rv_calendar(padded)).splitlines()
    explode = next(i for i, l in enumerate(lines) if "Generate explode" in l)
    wide = [l for l in lines[:explode] if "Exchange" in l]
    # Above the explode only the table with one row per (s, date) moves.
    aggregate = next(i for i, l in enumerate(lines) if "HashAggregate" in l)
    assert all(lines.index(l) < aggregate for l in wide)


def test_results_do_not_depend_on_the_order_of_the_input(spark, tmp_path):
    shuffled = tmp_path / "shuffled"
    inputs.events(spark, SMALL).orderBy(F.rand(7)).repartition(7).write.parquet(f"{shuffled}/events.parquet")
    for name in ("realized_variance", "row_id", "volume_delta", "sparse_rv_all"):
        one = sorted(QUERIES[name](spark, SMALL).collect())
        assert sorted(QUERIES[name](spark, str(shuffled)).collect()) == one


@pytest.mark.parametrize("name", ["session_filter", "realized_variance", "prepare_returns"])
def test_last_price_follows_the_clock_not_the_ids(spark, tmp_path, name):
    """Ids that run against the clock: the last event of a minute is still the latest."""
    events = inputs.events(spark, SMALL)
    highest = events.agg(F.max("event_id")).first()[0]
    events.withColumn("event_id", F.lit(highest // 2) - F.col("event_id")).write.parquet(f"{tmp_path}/one")
    folder = tmp_path / "tables"
    folder.mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(folder / "events.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    problem, _ = differences(QUERIES[name](spark, str(folder)), connection, name)
    assert problem == ""


def test_invariants_of_the_padded_series(spark):
    padded = inputs.padded(spark, SMALL, ["no_trades"]).cache()
    counts = padded.groupBy("index_date").count()
    assert [r[0] for r in counts.select("count").distinct().collect()] == [391]
    assert padded.filter("last_price IS NULL").count() == 0
    assert padded.filter("index_time NOT BETWEEN 30600 AND 54000").count() == 0
    dates = {r[0] for r in counts.select("index_date").collect()}
    assert dates == {r[0] for r in inputs.events(spark, SMALL).select(F.to_date("ts")).distinct().collect()}
    padded.unpersist()


def test_invariants_of_the_returns(spark):
    from tickloom.operators.returns import log_returns, time_signature

    rows = time_signature(log_returns(inputs.stage(inputs.padded(spark, SMALL)))).cache()
    n_dates = rows.select("index_date").distinct().count()
    assert rows.filter("log_ret IS NULL").count() == n_dates
    assert rows.filter("date_change").count() == n_dates - 1
    assert rows.filter("date_change AND log_ret IS NOT NULL").count() == 0
    zero = log_returns(inputs.padded(spark, SMALL), overnight="zero")
    assert zero.join(rows.filter("date_change"), ["index_date", "index_time"]).filter(zero.log_ret != 0).count() == 0
    rows.unpersist()


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() == 30
    assert set(QUERIES) <= oracle_sql().keys() <= queries().keys()
