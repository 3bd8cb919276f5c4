"""Streams and stores against the same series built at once."""

import datetime as dt
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickloom.functions.clock import minute_of_day
from tickloom.operators import variance
from tickloom.operators.grid import pad_session
from tickloom.operators.ordered import minute_axis
from tickloom.operators.returns import clip_returns, log_returns
from tickloom.plans.store import SeriesStore
from tickloom.schemas import EVENTS
from tickloom.streaming import bars as bar_ops
from tickloom.streaming.variance import daily_variance, update_available, variance_writer


def events(spark, rows):
    """(id, moment, value[, type])"""
    full = [(i, ts, 1, (*more, "a")[0], float(v), None) for i, ts, v, *more in rows]
    return spark.createDataFrame(full, EVENTS)


def arrive(df, folder, number):
    """One more file in the folder, younger than those before."""
    df.coalesce(1).write.mode("append").parquet(str(folder))
    known = getattr(arrive, "known", set())
    for path in set(folder.glob("*.parquet")) - known:
        os.utime(path, (1_700_000_000 + 60 * number,) * 2)
    arrive.known = known | set(folder.glob("*.parquet"))


def at(hour, minute=0, second=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute, second)


def test_late_events_count_until_the_watermark_has_passed(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stream = bar_ops.bars(bar_ops.event_stream(spark, str(folder), EVENTS, files_per_batch=1), keys=["event_type"])
    arrive(events(spark, [(1, at(10, 5), 3), (2, at(10, 5), 4), (3, at(12), 9), (4, at(12), 1, "b")]), folder, 0)
    bar_ops.append_available(stream, out, checkpoint)
    # 10:10 is beyond the watermark of 11:00, 11:40 is not
    arrive(events(spark, [(5, at(10, 10), 100), (6, at(11, 40), 7), (7, at(12, 1), 2)]), folder, 1)
    arrive(events(spark, [(8, at(11, 35), 8), (9, at(20), 1)]), folder, 2)
    bar_ops.append_available(stream, out, checkpoint)
    found = spark.read.parquet(out).orderBy("event_type", "bar_start").collect()
    assert [(r.event_type, r.bar_start, r.bar_end, r.open, r.high, r.low, r.close, r.no_trades) for r in found] == [
        ("a", at(10), at(10, 30), 3, 4, 3, 4, 2),
        ("a", at(11, 30), at(12), 8, 8, 7, 7, 2),
        ("a", at(12), at(12, 30), 9, 9, 2, 2, 2),
        ("b", at(12), at(12, 30), 1, 1, 1, 1, 1),
    ]


def test_bars_do_not_depend_on_the_session_time_zone(spark):
    rows = events(spark, [(1, dt.datetime(2024, 3, 10, 2, 30), 1), (2, dt.datetime(1969, 12, 31, 23, 59, 59), 2)])
    wanted = sorted(bar_ops.bars(rows).collect())
    assert [r.bar_start for r in wanted] == [dt.datetime(1969, 12, 31, 23, 30), dt.datetime(2024, 3, 10, 2, 30)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sorted(bar_ops.bars(rows).collect()) == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def trades(draw, days, kinds=("a",)):
    """Events of random minutes; some dates have none in session, some keys miss dates."""
    rows = []
    for day in days:
        for kind in kinds:
            if draw.random() < 0.2:
                continue
            hours = (7, 16) if draw.random() < 0.2 else range(8, 16)
            for _ in range(draw.randrange(1, 25)):
                rows.append((len(rows), at(draw.choice(hours), draw.randrange(60), draw.randrange(60), day), draw.choice([1, 2, 3, 5]), kind))
    return rows


def minutes(df, keys=()):
    slots = df.select(*keys, F.to_date("ts").alias("index_date"), minute_of_day(F.col("ts")).alias("index_time"), "ts", "event_id", "value")
    return slots.groupBy(*keys, "index_date", "index_time").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_price"))


def rounded(df):
    return sorted(tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in df.collect())


@pytest.mark.parametrize("keys", [[], ["event_type"]])
def test_variances_of_a_stream_and_a_replayed_batch(spark, tmp_path, keys):
    draw = random.Random(3)
    rows = trades(draw, range(1, 9), ("a", "b") if keys else ("a",))
    draw.shuffle(rows)
    batches = [rows[k::3] for k in range(3)]
    folder, root = tmp_path / "in", str(tmp_path / "rv")
    for k, part in enumerate(batches):
        arrive(events(spark, part), folder, k)
    writer = variance_writer(root, keys, threshold=9.0)
    update_available(bar_ops.event_stream(spark, str(folder), EVENTS, files_per_batch=1), writer, str(tmp_path / "checkpoint"))
    padded = pad_session(minutes(events(spark, rows), keys), keys=keys)
    moved = clip_returns(log_returns(padded, axis=minute_axis(keys)), 9.0)
    wanted = rounded(variance.realized_variance(moved, keys).select(*keys, "index_date", "rv", "rv_an"))
    assert len(wanted) > 4
    columns = [*keys, "index_date", "rv", "rv_an"]
    assert rounded(daily_variance(spark, root, keys).select(*columns)) == wanted
    files = sorted(folder.glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    for again in (2, 0):
        writer(spark.read.schema(EVENTS).parquet(str(files[again])), again)
        assert rounded(daily_variance(spark, root, keys).select(*columns)) == wanted
    writer(events(spark, []), 3)
    assert rounded(daily_variance(spark, root, keys).select(*columns)) == wanted


@pytest.mark.parametrize("overnight, keys", [("null", []), ("include", ["event_type"])])
def test_store_in_parts_equals_the_series_at_once(spark, tmp_path, overnight, keys):
    draw = random.Random(11)
    ticks = minutes(events(spark, trades(draw, range(1, 13), ("a", "b") if keys else ("a",))), keys).persist()
    at_once = SeriesStore(spark, str(tmp_path / "one"), keys, 9.0, overnight, periods=[1, 2, 5, 7])
    at_once.append(ticks)
    store = SeriesStore(spark, str(tmp_path / "three"), keys, 9.0, overnight, periods=[1, 2, 5, 7])
    written = {}
    for first, last in ((1, 4), (5, 5), (6, 12)):
        store.append(ticks.filter(F.dayofmonth("index_date").between(first, last)))
        # what is stored is not read again: only the edges of the last part are
        for name in ("returns", "sparse"):
            for path in Path(tmp_path / "three" / name).glob("part=*/*.parquet"):
                written.setdefault(path, path.read_bytes())
                path.write_bytes(b"unreadable")
                path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    for path, content in written.items():
        path.write_bytes(content)
    assert store.parts() == 3
    columns = [*keys, "index_date", "index_time", "last_price", "log_ret", "no_returns"]
    assert rounded(store.returns().select(*columns)) == rounded(at_once.returns().select(*columns))
    assert rounded(store.sparse_rv().select(*keys, "s_grid", "index_date", "rv_sparse")) == rounded(
        at_once.sparse_rv().select(*keys, "s_grid", "index_date", "rv_sparse")
    )
    assert rounded(store.every_kth_return(3).select(*columns)) == rounded(at_once.every_kth_return(3).select(*columns))
    with pytest.raises(ValueError):
        store.append(ticks.filter(F.dayofmonth("index_date") == 12))
    assert store.parts() == 3
    ticks.unpersist()
