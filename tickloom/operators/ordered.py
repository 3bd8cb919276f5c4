"""Order-dependent operators without a single-partition window.

A series is cut into *segments* that follow each other in the global order
(trading dates for minute series, range partitions for raw ticks). Each operator

1. works inside the segments with a window partitioned by ``keys + segment``,
2. reduces every segment to one row (its edges or its size), with map-side
   combining,
3. orders only those rows globally and carries the edge into the next segment,
4. joins the carry back on ``keys + segment``.

No join is hinted: the carry has one row per segment, and adaptive execution
turns the join into a broadcast when the measured size allows it.

Rows per segment must be bounded. A minute series has at most 1,440 rows per key
and date, whatever the skew of the raw ticks. For anything else take the segments
from :func:`tickloom.operators.ranking.range_segments`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

START, END, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


@dataclass(frozen=True)
class Axis:
    """Names of the columns that fix the order of a series."""

    segment: str = "index_date"
    order: tuple[str, ...] = ("index_time",)
    keys: tuple[str, ...] = ()

    @property
    def segment_keys(self) -> list[str]:
        return [*self.keys, self.segment]

    def position(self) -> Column:
        """One value that orders the rows of a segment."""
        return F.col(self.order[0]) if len(self.order) == 1 else F.struct(*self.order)

    def within(self) -> WindowSpec:
        return Window.partitionBy(*self.segment_keys).orderBy(*self.order)

    def across(self) -> WindowSpec:
        """For tables with one row per segment only."""
        return Window.partitionBy(*self.keys).orderBy(self.segment)


MINUTES = Axis()


def minute_axis(keys: tuple[str, ...] | list[str] = ()) -> Axis:
    return Axis(keys=tuple(keys))


def stored_beside(carry: DataFrame, previous: DataFrame, columns: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """``carry`` with ``{new name: column of previous}``; ``previous`` has one row per key."""
    if keys:
        return carry.join(previous.select(*keys, *[F.col(c).alias(n) for n, c in columns.items()]), list(keys), "left")
    row = previous.select(*columns.values()).first()  # a series without keys: one row
    kinds = [previous.schema[c].dataType for c in columns.values()]
    return carry.withColumns({n: F.lit(row[i] if row else None).cast(kinds[i]) for i, n in enumerate(columns)})


def known_price_carry(
    df: DataFrame, value: str, axis: Axis = MINUTES, previous: DataFrame | None = None
) -> DataFrame:
    """Per segment: ``_before``, the last known value of earlier segments, and
    ``_after``, the first known value of this segment or a later one.

    ``previous`` holds for each key the last known value ahead of all segments, where
    ``df`` continues a series that is stored elsewhere.
    """
    known_at = F.when(F.col(value).isNotNull(), axis.position())
    edges = df.groupBy(*axis.segment_keys).agg(
        F.min_by(value, known_at).alias("_first_known"),
        F.max_by(value, known_at).alias("_last_known"),
    )
    return carried_edges(edges, axis, value, previous)


def carried_edges(
    edges: DataFrame, axis: Axis = MINUTES, value: str = "", previous: DataFrame | None = None
) -> DataFrame:
    """``_before`` and ``_after`` from one row per segment with ``_first_known`` and ``_last_known``."""
    across = axis.across()
    carry = edges.select(
        *axis.segment_keys,
        F.last("_last_known", ignorenulls=True).over(across.rowsBetween(START, -1)).alias("_before"),
        F.first("_first_known", ignorenulls=True).over(across.rowsBetween(HERE, END)).alias("_after"),
    )
    if previous is None:
        return carry
    known = stored_beside(carry, previous, {"_stored": value}, axis.keys)
    return known.withColumn("_before", F.coalesce("_before", "_stored")).drop("_stored")


def fill_forward(df: DataFrame, value: str, axis: Axis = MINUTES) -> DataFrame:
    """NULLs take the last known value, across segments; a gap at the very start
    of the series takes the first known value."""
    carry = known_price_carry(df, value, axis)
    local = F.last(value, ignorenulls=True).over(axis.within().rowsBetween(START, HERE))
    return (
        df.withColumn("_local", local)
        .join(carry, axis.segment_keys, "left")
        .withColumn(value, F.coalesce("_local", "_before", "_after"))
        .drop("_local", "_before", "_after")
    )


def lag_rows(
    df: DataFrame, columns: Mapping[str, str], axis: Axis = MINUTES, previous: DataFrame | None = None
) -> DataFrame:
    """Add ``{new name: source column}`` from the previous row of the whole series.

    Only the first row of the series gets NULL, or the value that ``previous`` has for its key.
    """
    sources = sorted(set(columns.values()))
    place = {source: f"_edge_{i}" for i, source in enumerate(sources)}
    edges = df.groupBy(*axis.segment_keys).agg(
        *[F.max_by(source, axis.position()).alias(place[source]) for source in sources]
    )
    across, within = axis.across(), axis.within()
    carry = edges.select(
        *axis.segment_keys, *[F.lag(name).over(across).alias(name) for name in place.values()]
    )
    if previous is not None:
        stored = {f"_stored_{i}": source for i, source in enumerate(sources)}
        carry = stored_beside(carry, previous, stored, axis.keys)
        filled = {place[source]: F.coalesce(place[source], name) for name, source in stored.items()}
        carry = carry.withColumns(filled).drop(*stored)
    opening = "_opening"
    local = {
        opening: F.row_number().over(within) == 1,
        **{name: F.lag(source).over(within) for name, source in columns.items()},
    }
    joined = df.withColumns(local).join(carry, axis.segment_keys, "left")
    merged = {
        name: F.when(F.col(opening), F.col(place[source])).otherwise(F.col(name))
        for name, source in columns.items()
    }
    return joined.withColumns(merged).drop(opening, *place.values())


def number_rows(
    df: DataFrame, name: str, axis: Axis = MINUTES, where: Column | None = None
) -> DataFrame:
    """Rows of the whole series numbered 1..n in order, without gaps.

    With ``where`` only rows that pass are counted; the others keep the number of
    the last row that passed.
    """
    counted = F.lit(1) if where is None else F.when(where, F.lit(1))
    flagged = df.withColumn("_counted", counted)
    sizes = flagged.groupBy(*axis.segment_keys).agg(F.count("_counted").alias("_size"))
    carry = sizes.select(
        *axis.segment_keys,
        F.coalesce(F.sum("_size").over(axis.across().rowsBetween(START, -1)), F.lit(0)).alias("_offset"),
    )
    local = F.count("_counted").over(axis.within().rowsBetween(START, HERE))
    return (
        flagged.withColumn(name, local)
        .join(carry, axis.segment_keys, "left")
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_counted", "_offset")
    )


def every_kth_row(df: DataFrame, k: int, axis: Axis = MINUTES) -> DataFrame:
    """Rows 1, 1+k, 1+2k ... of the whole series; the phase drifts over segments."""
    numbered = number_rows(df, "_rank", axis)
    return numbered.filter((F.col("_rank") - 1) % k == 0).drop("_rank")


def guarded_sum(value: str, period: int, window: WindowSpec) -> Column:
    """Sum of the last ``period`` rows, NULL when one is absent or NULL."""
    frame = window.rowsBetween(1 - period, HERE)
    return F.when(F.count(value).over(frame) == period, F.sum(value).over(frame))


def rolling_sum(df: DataFrame, value: str, period: int, name: str, axis: Axis = MINUTES) -> DataFrame:
    """Right-aligned rolling sum that starts afresh in each segment.

    Equal to the sum over the whole series whenever each segment opens with NULL,
    as overnight returns do: every window that crosses the border holds that NULL.
    """
    return df.withColumn(name, guarded_sum(value, period, axis.within()))


def prefix_sums(df: DataFrame, value: str, names: Mapping[int, str], axis: Axis = MINUTES) -> DataFrame:
    """Right-aligned rolling sums ``{period: name}`` inside each segment, from cumulative sums.

    A sum over ``period`` rows is the cumulative sum here less the one ``period`` rows ago,
    and is NULL unless as many values became known in between. One sort of the segment
    serves any number of periods, and no frame is walked. Equal to :func:`guarded_sum` up
    to rounding; infinities and NaN spoil the rest of their segment.
    """
    within = axis.within()
    so_far = within.rowsBetween(START, HERE)
    known = df.withColumns({"_sum": F.coalesce(F.sum(value).over(so_far), F.lit(0.0)), "_known": F.count(value).over(so_far)})
    moved = lambda name, period, none: F.col(name) - F.lag(name, period, none).over(within)
    sums = {
        name: F.when(moved("_known", period, 0) == period, moved("_sum", period, 0.0)) for period, name in names.items()
    }
    return known.withColumns(sums).drop("_sum", "_known")


def block_axis(axis: Axis = MINUTES) -> Axis:
    """The axis of a series cut by :func:`sums_across`."""
    return Axis("_block", ("_rank",), axis.keys)


def sums_across(
    df: DataFrame, value: str, names: Mapping[int, str], axis: Axis = MINUTES, block: int = 4096
) -> DataFrame:
    """Right-aligned rolling sums ``{period: name}`` over the whole series.

    Rows are numbered (``_rank``) and cut into blocks (``_block``); the last rows of a
    block, one less than the longest period, are copied ahead of the next block, so that
    each block is a window on its own.
    """
    longest = max(names)
    size = max(block, longest)
    at = F.col("_rank") - 1
    own = F.floor(at / size)
    near_end = (at % size) >= size - (longest - 1)
    targets = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    blocks = number_rows(df, "_rank", axis).withColumn("_own", own).withColumn("_block", F.explode(targets))
    window = block_axis(axis).within()
    return (
        blocks.withColumns({name: guarded_sum(value, period, window) for period, name in names.items()})
        .filter(F.col("_block") == F.col("_own"))
        .drop("_own")
    )


def rolling_sum_across(
    df: DataFrame, value: str, period: int, name: str, axis: Axis = MINUTES, block: int = 4096
) -> DataFrame:
    """Right-aligned rolling sum over the whole series."""
    return sums_across(df, value, {period: name}, axis, block).drop("_rank", "_block")
