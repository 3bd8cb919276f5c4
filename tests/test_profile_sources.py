import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import profile, ranking, reshape
from tickloom.sources import files


@pytest.mark.parametrize("slices", [1, 7])
def test_numbers_by_key_across_slices(spark, slices):
    draw = random.Random(2)
    data = [(draw.choice(["hot", "hot", None, f"k{draw.randrange(40)}"]), i) for i in range(3000)]
    wanted, seen = {}, {}
    for key, i in data:
        seen[key] = wanted[i] = seen.get(key, 0) + 1
    df = spark.createDataFrame(data, "k string, i long").repartition(3)
    numbered = ranking.row_id(df, "n", ["i"], slices=slices, keys=["k"])
    assert {r.i: r.n for r in numbered.collect()} == wanted
    assert numbered.columns == ["k", "i", "n"]
    every = ranking.every_kth_row(df, 5, ["i"], keys=["k"], slices=slices)
    assert {r.i for r in every.collect()} == {i for i, n in wanted.items() if n % 5 == 1}
    assert ranking.row_id(df.limit(0), "n", ["i"], keys=["k"]).count() == 0


def test_row_id_is_gapless_with_a_hot_key(spark):
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("g"))
    rows = ranking.row_id(hot.repartition(5), "n", ["g", "id"]).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 3001))
    assert [(r.g, r.id) for r in rows] == sorted((r.g, r.id) for r in rows)


def test_slices_split_a_hot_key(spark):
    hot = spark.range(20000).select("id", F.lit(1).alias("g"))
    sizes = ranking.range_segments(hot, ["g", "id"]).groupBy("_segment").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 12000


def test_quantiles_are_exact(spark):
    pick = np.random.default_rng(3)
    a, b = pick.normal(size=5001), pick.integers(0, 4, size=5001).astype(float)
    a[:5] = np.nan
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.column, r.p): r.quantile for r in ranking.exact_quantiles(df, ["a", "b"], probabilities).collect()}
    want = {("a", p): np.quantile(a[5:], p) for p in probabilities} | {("b", p): np.quantile(b, p) for p in probabilities}
    assert got == pytest.approx(want)


def test_small_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    got = {r.p: r.quantile for r in ranking.exact_quantiles(df, ["x"], [0.25, 0.5]).collect()}
    assert got == {0.25: 1.75, 0.5: 3.0}


def test_summary(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (10,)], "x bigint")
    got = {r.measure: r.value for r in profile.summary_long(df, "x").collect()}
    assert got == pytest.approx({"Min": 1, "Median": 3, "Mean": 4.25, "Max": 10, "Standard Dev": 4.031129}, abs=1e-6)


def test_null_columns(spark):
    df = spark.createDataFrame([(1, None, 1), (None, None, 2)], "a int, b int, c int")
    assert {r.column: r.no_missing for r in profile.null_counts(df).collect()} == {"a": 1, "b": 2, "c": 0}
    assert profile.drop_null_columns(df, "any").columns == ["c"]
    assert profile.drop_null_columns(df, "all").columns == ["a", "c"]
    with pytest.raises(ValueError):
        profile.drop_null_columns(df, "some")


def test_skim(spark):
    rows = [(float(i), "ab"[i % 3 == 0], dt.date(2024, 1, 1 + i)) for i in range(10)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "x double, f string, d date")
    got = {r.column: r for r in profile.table_skim(df, ["x"], ["d"], ["f"]).collect()}
    x, d, f = got["x"], got["d"], got["f"]
    assert (x.n_missing, x.mean, x.p25, x.p50, x.p100, x.hist) == (1, 4.5, 2.25, 4.5, 9.0, "2,2,2,2,2")
    assert x.sd == pytest.approx(np.std(range(10), ddof=1)) and x.complete_rate == pytest.approx(10 / 11)
    assert (d.date_min, d.date_max, d.n_unique) == (dt.date(2024, 1, 1), dt.date(2024, 1, 10), 10)
    assert (f.n_unique, f.top_counts) == (2, "a: 6, b: 4")


def test_edges_and_schema(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "k int, v string")
    assert {r.edge: r.v for r in profile.edges(df, ["k"]).collect()} == {"first": "a", "last": "c"}
    shape = {r.column: (r.type, r.rows, r.sample) for r in profile.profile_schema(df, "k").collect()}
    assert shape == {"k": ("int", 3, "1"), "v": ("string", 3, "a")}


def test_rows_lost(spark):
    df = spark.createDataFrame([(1, 5), (1, 50), (2, 50), (3, None)], "index_date int, t int")
    assert tuple(profile.rows_lost(df, F.col("t") < 10).first()) == (4, 1, 3, 2)


def test_rename_and_relocate(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, tidy_b int, c int")
    assert reshape.rename_positional(df, ["x", "y", "z"]).columns == ["x", "y", "z"]
    with pytest.raises(ValueError):
        reshape.rename_positional(df, ["x"])
    assert reshape.relocate(df, prefix="tidy").columns == ["tidy_b", "a", "c"]
    assert reshape.relocate(df, ["a"], after="c").columns == ["tidy_b", "c", "a"]
    assert reshape.relocate(df, ["c"], before="tidy_b").columns == ["a", "c", "tidy_b"]


def test_sorting_puts_missing_last(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r.x for r in df.orderBy(reshape.ascending("x")).collect()] == [1, 2, None]
    assert [r.x for r in df.orderBy(reshape.descending("x")).collect()] == [2, 1, None]
    assert [r.x for r in reshape.tail(df, 2, "x").collect()] == [2, None]


def test_unpivot_by_name(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "date int, vimex double, ipc_vix double, other double")
    assert sorted(r.name for r in reshape.unpivot_matching(df, ["date"], "x").collect()) == ["ipc_vix", "vimex"]


def test_na_tokens(spark, tmp_path):
    path = tmp_path / "indices.csv"
    path.write_text("Dates,MEXBOL,VIMEX,IPC\n2011-01-03,38605.79,#N/A N/A,12.5\n2011-01-04,#NA,20.5,\n")
    rows = files.scan_na_tokens(spark, str(path), schemas.INDICES).orderBy("date").collect()
    assert rows[0].asDict() == {"date": dt.date(2011, 1, 3), "mexbol_ipc": 38605.79, "vimex": None, "ipc_vix": 12.5}
    assert (rows[1].mexbol_ipc, rows[1].vimex, rows[1].ipc_vix) == (None, 20.5, None)


def test_raw_bars_to_ticks(spark):
    from tickloom.functions import clock

    values = [".MXX", 19960102.0, 30960, "Intraday 1Min", *[2777.47] * 4, 0, 2777.47, None, 1, None,
              *[None] * 4, 0, *[None] * 4, 0]
    raw = spark.createDataFrame([tuple(values)], schemas.RAW_BARS)
    assert len(schemas.RAW_BAR_NAMES) == 23 and raw.columns == list(schemas.RAW_BAR_NAMES)
    kept = profile.drop_null_columns(raw)
    assert len(kept.columns) == 13
    date = clock.parse_date_number(F.col("raw_date"))
    row = kept.select(clock.moment(date, F.col("raw_time"))).first()
    assert row[0] == dt.datetime(1996, 1, 2, 8, 36)


def test_sinks_replace_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    files.sink_csv_overwrite(spark.range(5), path)
    files.sink_csv_overwrite(spark.range(2), path)
    assert files.scan_csv(spark, path, "id bigint").count() == 2
    table = str(tmp_path / "table")
    files.sink_parquet(spark.range(10).withColumn("year", F.col("id") % 2), table, ["year"])
    files.sink_parquet(spark.range(4).withColumn("year", F.col("id") % 2), table, ["year"])
    assert spark.read.parquet(table).count() == 4


def test_staging_needs_a_shared_folder(spark):
    from tickloom.session import staging_root

    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_part_files_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,10\n2,20\n")
    (tmp_path / "b.csv").write_text('"y","x"\n30,3\n')
    (tmp_path / "c.csv").write_text("x\n4\n")
    got = files.scan_csv_directory(spark, str(tmp_path), "x int, y int")
    assert sorted(map(tuple, got.collect())) == [(1, 10), (2, 20), (3, 30), (4, None)]
    with pytest.raises(ValueError, match="not in the schema"):
        files.scan_csv_directory(spark, str(tmp_path), "x int")
