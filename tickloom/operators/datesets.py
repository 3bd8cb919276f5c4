"""Sets of dates by key as bitmaps: exact, mergeable, counted without a second distinct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def date_sets(df: DataFrame, keys: Sequence[str] = (), date: str = "index_date", **where: Column) -> DataFrame:
    """``(keys, bucket, dates, ...)``: the dates of each key, one bit a day.

    A bucket covers 32,768 days, so a key has one row as a rule. Each name in ``where``
    adds a set of the dates on which some row passes that condition. Bitmaps are filled
    before the shuffle: a hot key or date costs one row per task.
    """
    day = F.unix_date(F.to_date(date)).cast("long")
    rows = df.filter(F.col(date).isNotNull()).select(
        *keys, day.alias("_day"), *[F.coalesce(c, F.lit(False)).alias(f"_{name}") for name, c in where.items()]
    )
    bit = F.bitmap_bit_position("_day")
    sets = {"dates": bit, **{name: F.when(F.col(f"_{name}"), bit) for name in where}}
    return rows.groupBy(*keys, F.bitmap_bucket_number("_day").alias("bucket")).agg(
        *[F.bitmap_construct_agg(c).alias(name) for name, c in sets.items()]
    )


def merged(first: DataFrame, *others: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The union, key by key, of sets made from different tables or parts of one."""
    rows = first
    for other in others:
        rows = rows.unionByName(other)
    names = [c for c in first.columns if c not in (*keys, "bucket")]
    return rows.groupBy(*keys, "bucket").agg(*[F.bitmap_or_agg(c).alias(c) for c in names])


def sizes(sets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, ...)``: how many dates each set has."""
    names = [c for c in sets.columns if c not in (*keys, "bucket")]
    return sets.groupBy(*keys).agg(*[F.sum(F.bitmap_count(c)).alias(c) for c in names])


def missing_dates(wanted: DataFrame, found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, all_dates, found_dates, missing_dates)`` for the keys of ``wanted``.

    What is missing is what the union has more than ``found`` has; no dates are listed.
    """
    a = wanted.select(*keys, "bucket", F.col("dates").alias("_bits"), F.lit(True).alias("_wanted"))
    b = found.select(*keys, "bucket", F.col("dates").alias("_bits"), F.lit(False).alias("_wanted"))
    of = lambda flag: F.bitmap_or_agg(F.when(F.col("_wanted") == flag, F.col("_bits")))
    both = a.unionByName(b).groupBy(*keys, "bucket").agg(
        of(True).alias("_a"), of(False).alias("_b"), F.bitmap_or_agg("_bits").alias("_all"), F.max("_wanted").alias("_known")
    )
    counted = both.groupBy(*keys).agg(
        F.sum(F.bitmap_count("_a")).alias("all_dates"),
        F.sum(F.bitmap_count("_b")).alias("found_dates"),
        F.sum(F.bitmap_count("_all") - F.bitmap_count("_b")).alias("missing_dates"),
        F.max("_known").alias("_known"),
    )
    return counted.filter("_known").drop("_known")
