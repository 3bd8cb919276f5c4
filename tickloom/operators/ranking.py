"""Global row numbers and exact quantiles of tables of any size and skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row below


def range_segments(
    df: DataFrame,
    order: Sequence[str | Column],
    segment: str = "_segment",
    local: str = "_local",
    slices: int | None = None,
) -> DataFrame:
    """Cut ``df`` into equal slices of the global order and write them once.

    ``segment`` rises with the order, ``local`` numbers the rows of a slice from 1.
    The range exchange draws its borders from a sample, so one hot date, minute or
    key is split like any other stretch of rows as long as ``order`` ends in a
    unique column. No window is needed: the rows are sorted inside each partition
    and the row id that Spark gives holds partition and position. The table is
    staged because a second evaluation could draw other borders. ``order`` takes names
    or sort expressions such as ``F.desc_nulls_last``. ``slices`` is the number of
    slices, by default that of shuffle partitions; take it from the size of the input,
    as a slice is sorted by one task. The result is the same for any number.
    """
    partitions = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_rid", F.monotonically_increasing_id())
    )
    return stage(
        ranged.withColumn(segment, F.shiftright("_rid", LOCAL_BITS))
        .withColumn(local, F.col("_rid").bitwiseAND((1 << LOCAL_BITS) - 1) + 1)
        .drop("_rid"),
        "ranges",
    )


def row_id(
    df: DataFrame,
    name: str,
    order: Sequence[str | Column],
    slices: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Consecutive numbers 1..n in the given order; end ``order`` in a unique column.

    With ``keys`` every key has numbers of its own; NULL is a key like any other. The rows
    are cut by key and order at once, so one key may span many slices and one slice hold
    many keys: a key that owns a third of the rows is split like any other stretch. What
    is joined back has one row per key and slice that meet, at most keys + slices rows.
    """
    sliced = range_segments(df, [*keys, *order], slices=slices)
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    held = sliced.groupBy(*keys, "_segment").agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_size"))
    # The rows of a key in a slice adjoin: what lies ahead of them there is taken off again.
    ahead = F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1
    offsets = held.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_segment").alias("_of"), ahead.alias("_offset")
    )
    if not keys:
        # One row per shuffle partition: the bound does not depend on the data.
        offsets = F.broadcast(offsets)
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return (
        sliced.join(offsets, [F.col("_segment") == F.col("_of"), *same])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_segment", "_of", "_local", "_offset", *[f"_key_{i}" for i in range(len(keys))])
    )


def every_kth_row(
    df: DataFrame, k: int, order: Sequence[str | Column], keys: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Rows 1, 1+k, 1+2k ... of each key in order, for tables without segments of bounded size."""
    numbered = row_id(df, "_number", order, slices, keys)
    return numbered.filter((F.col("_number") - 1) % k == 0).drop("_number")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, copies)`` of several numeric columns in one pass.

    ``column`` is the place in ``columns``: a small integer sorts and hashes faster
    than a name; :func:`with_names` puts the name back. Copies are combined before
    the shuffle, so a value that fills a third of the table arrives as one row per
    task. NULL and NaN are left out.
    """
    places = [F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]
    long = df.select(F.inline(F.array(*places)))
    return (
        long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def with_names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    return df.withColumn("column", F.element_at(names, F.col("column") + 1))


def ranked_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts cut into ordered slices, written once; see :func:`range_segments`."""
    return range_segments(value_counts(df, columns), ["column", "value"])


def quantiles_of_ranked(ranked: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``(column, p, quantile)``: exact, linear between neighbours.

    The rank of a value is the number of smaller values, counted slice by slice.
    Only the slices that hold a wanted rank are sorted.
    """
    slices = ranked.groupBy("column", "_segment").agg(F.sum("copies").alias("_held"))
    by_column = Window.partitionBy("column")
    before = by_column.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    counted = slices.select(
        "column",
        "_segment",
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_below"),
        F.col("_held"),
        (F.sum("_held").over(by_column) - 1).alias("_top"),
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("p"),
                (F.col("_top") * p).alias("at"),
                F.floor(F.col("_top") * p).alias("low"),
                F.ceil(F.col("_top") * p).alias("high"),
            )
            for p in probabilities
        ]
    )
    touched = lambda t: (t["low"] < F.col("_below") + F.col("_held")) & (t["high"] >= F.col("_below"))
    # One row per wanted slice: at most (columns x probabilities x 2) rows, whatever the data.
    needed = counted.select("column", "_segment", "_below", F.filter(wanted, touched).alias("_targets")).filter(
        F.size("_targets") > 0
    )
    running = (
        Window.partitionBy("column", "_segment")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranks = (
        ranked.join(F.broadcast(needed), ["column", "_segment"])
        .withColumn("_end", F.col("_below") + F.sum("copies").over(running))
        .select("column", "value", "copies", "_end", F.inline("_targets"))
    )
    holds = lambda rank: (F.col(rank) < F.col("_end")) & (F.col(rank) >= F.col("_end") - F.col("copies"))
    ends = (
        ranks.filter(holds("low") | holds("high"))
        .groupBy("column", "p")
        .agg(
            F.max(F.when(holds("low"), F.col("value"))).alias("_v0"),
            F.max(F.when(holds("high"), F.col("value"))).alias("_v1"),
            F.max(F.col("at") - F.col("low")).alias("_share"),
        )
    )
    return ends.select(
        "column", "p", (F.col("_v0") + F.col("_share") * (F.col("_v1") - F.col("_v0"))).alias("quantile")
    )


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """``(column, p, quantile)`` with column names; see :func:`quantiles_of_ranked`."""
    return with_names(quantiles_of_ranked(ranked_values(df, columns), probabilities), columns)
