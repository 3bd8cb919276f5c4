"""Bars of fixed length from a stream of events, with a watermark for late ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.clock import epoch_micros, ordered_moment, wall_clock

LENGTH, DELAY = "30 minutes", "1 hour"


def event_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files under ``path`` as a stream, at most so many in one micro-batch.

    The path may name a folder or one file: it goes to the source as a pattern, since a
    plain path has to be a folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def bars(
    events: DataFrame,
    length: str = LENGTH,
    delay: str = DELAY,
    keys: Sequence[str] = (),
    ts: str = "ts",
    value: str = "value",
    tie: str = "event_id",
) -> DataFrame:
    """``(keys, bar_start, bar_end, open, high, low, close, no_trades)`` per window of ``length``.

    Works on a stream and on a table alike. Of events at the same time the lower ``tie``
    came first. A stream in append mode gives a bar once, when ``delay`` has passed since
    its end in event time; an event counts if it comes before that. State holds one row
    per key and open window, whatever the number of events: they are combined before the
    shuffle, so a hot key or minute costs one row per task and batch.
    """
    # Watermarks want an instant: the wall clock is read as if it were UTC, in any session.
    slots = events.select(
        *keys,
        F.timestamp_micros(epoch_micros(F.col(ts))).alias("_time"),
        F.col(value).alias("_value"),
        ordered_moment(F.col(ts), F.col(tie)).alias("_at"),
    ).withWatermark("_time", delay)
    held = slots.groupBy(*keys, F.window("_time", length).alias("_bar")).agg(
        F.min_by("_value", "_at").alias("open"),
        F.max("_value").alias("high"),
        F.min("_value").alias("low"),
        F.max_by("_value", "_at").alias("close"),
        F.count(F.lit(1)).alias("no_trades"),
    )
    edges = [wall_clock(F.col(f"_bar.{edge}")).alias(f"bar_{edge}") for edge in ("start", "end")]
    return held.select(*keys, *edges, "open", "high", "low", "close", "no_trades")


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what the stream can give now to the Parquet table at ``path`` and stop.

    The checkpoint folder holds offsets and open windows; the next call goes on from there.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query
