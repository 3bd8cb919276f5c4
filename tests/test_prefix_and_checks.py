"""Rolling sums from cumulative sums, and checks measured while writing."""

import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators import variance
from tickloom.operators.ordered import prefix_sums
from tickloom.operators.returns import log_returns
from tickloom.session import SESSION_DEFAULTS
from tickloom.sources.files import scan_parquet, sink_bucketed, sink_checked


@pytest.fixture(scope="module")
def returns(series):
    rows = [(d, m, None if m == 0 or (d, m) in ((1, 7), (2, 30), (2, 31)) else ((d * 37 + m * 11) % 23 - 11) / 7) for d in range(4) for m in range(75)]
    return series(rows, "log_ret")


def test_prefix_sums_equal_frames(returns):
    pairs = [(s, 1) for s in (1, 2, 5, 30, 60)]
    wanted = {(r.s, r.index_date, r.index_time): r.ret for r in variance.rolling_returns(returns, pairs).collect()}
    rows = prefix_sums(returns, "log_ret", {s: f"sum{s}" for s, _ in pairs}).collect()
    found = {(s, r.index_date, r.index_time): r[f"sum{s}"] for r in rows for s, _ in pairs if r[f"sum{s}"] is not None}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)


def test_all_periods_in_one_sort(returns, spark):
    pairs = [(s, 1) for s in range(1, 61)]
    wanted = {(r.s, r.index_date): (r.rv, r.rv_an) for r in variance.rolling_rv(variance.rolling_returns(returns, pairs)).collect()}
    df = variance.rv_of_sums(returns)
    found = {(r.s, r.index_date): (r.rv, r.rv_an) for r in df.collect()}
    assert found.keys() == wanted.keys()
    assert all(abs(a - b) < 1e-9 for k in wanted for a, b in zip(found[k], wanted[k]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"[^\w]Sort \[", final)) == 1 and len(re.findall(r"Exchange hashpartitioning", final)) == 1


@pytest.mark.parametrize("partition_by", [(), ("kind",)])
def test_checks_come_with_the_write(spark, tmp_path, partition_by):
    df = spark.range(100).select(
        F.col("id").alias("a b"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("x"), (F.col("id") % 2).alias("kind")
    )
    spark.sparkContext.setJobGroup(f"checked {partition_by}", "one write")
    missing, counts = sink_checked(df, str(tmp_path / "t"), partition_by, large=F.col("x") > 50, none=F.col("x").isNull() & (F.col("x") > 1))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"checked {partition_by}")
    spark.sparkContext.setJobGroup("", "")
    assert missing == {"a b": 0, "x": 66, "kind": 0} and counts == {"rows": 100, "large": 17, "none": 0}
    # adaptive execution runs the stage before a shuffle as a job of its own
    assert len(jobs) <= 1 + len(partition_by)
    assert scan_parquet(spark, str(tmp_path / "t")).count() == 100
    missing, counts = sink_checked(df.limit(0), str(tmp_path / "t"), partition_by)
    assert counts == {"rows": 0} and set(missing.values()) == {0}


def test_buckets_spare_the_exchange(spark, series, tmp_path):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(name, SESSION_DEFAULTS[name])
    rows = [(d, m, float(d + m % 5 + 1)) for d in range(6) for m in range(30)]
    prices = series(rows, "last_price")
    stored = sink_bucketed(prices, "bucketed_prices", str(tmp_path / "b"), ["index_date"], ["index_time"], 3)
    moved = log_returns(stored)
    other = sink_bucketed(prices.withColumnRenamed("last_price", "p"), "bucketed_ticks", str(tmp_path / "c"), ["index_date"], ["index_time"], 3)
    met = stored.hint("merge").join(other, ["index_date", "index_time"], "left")
    for df in (moved, met):
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    want = sorted(map(tuple, log_returns(prices).collect()), key=str)
    assert sorted(map(tuple, moved.collect()), key=str) == want
    assert met.count() == len(rows) and met.filter("p <> last_price").count() == 0
    spark.conf.unset(name)
