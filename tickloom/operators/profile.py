"""Counts, summaries and column profiles of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import equal_width_bin
from ..session import stage
from .quantiles import grouped_quantiles
from .ranking import quantiles_of_ranked, range_segments, ranked_values, with_names

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def profile_schema(df: DataFrame, order: str) -> DataFrame:
    """``(column, type, rows, sample)``: shape of a table with the first value of each column.

    One scan; "first" follows the given order column.
    """
    fields = df.schema.fields
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min_by(F.col(f.name).cast("string"), order).alias(f.name) for f in fields],
    )
    types = F.create_map(*[F.lit(x) for f in fields for x in (f.name, f.dataType.simpleString())])
    long = one.unpivot(["_rows"], [f.name for f in fields], "column", "sample")
    return long.select("column", types[F.col("column")].alias("type"), F.col("_rows").alias("rows"), "sample")


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, no_missing)`` in one pass over the table."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], list(df.columns), "column", "no_missing")


def drop_null_columns(df: DataFrame, rule: str = "any") -> DataFrame:
    """Drop columns with any NULL, or (``rule="all"``) with nothing but NULLs.

    The schema of the result depends on the data, so one row of counts is fetched.
    """
    if rule not in ("any", "all"):
        raise ValueError(f"unknown rule {rule!r}")
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)],
    ).first()
    bound = 1 if rule == "any" else max(counts["_rows"], 1)
    return df.drop(*[c for i, c in enumerate(df.columns) if counts[f"_{i}"] >= bound])


def rows_lost(df: DataFrame, keep: Column, date: str = "index_date", keys: Sequence[str] = ()) -> DataFrame:
    """Rows and dates that a filter removes, from one aggregate."""
    kept = F.coalesce(keep, F.lit(False))
    by_date = df.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_all"), F.count_if(kept).alias("_kept"))
    return by_date.groupBy(*keys).agg(
        F.sum("_all").alias("rows_before"),
        F.sum("_kept").alias("rows_after"),
        F.sum(F.col("_all") - F.col("_kept")).alias("rows_lost"),
        F.count_if(F.col("_kept") == 0).alias("dates_lost"),
    )


def edges(df: DataFrame, position: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """First and last row, of each key, as two rows, found without sorting."""
    row, at = F.struct(*df.columns), F.struct(*position)
    ends = df.groupBy(*keys).agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))
    return ends.unpivot(list(keys), ["first", "last"], "edge", "_row").select("edge", "_row.*")


def value_moments(ranked: DataFrame, bins: int = 1) -> DataFrame:
    """Count, mean, range, distinct values, sample deviation and equal-width
    histogram per column, from value counts.

    Deviations are taken from the mean, not from a sum of squares, so the counts
    are read twice: for the mean and range, and for what depends on them.
    """
    v, n = F.col("value"), F.col("copies")
    sums = ranked.groupBy("column").agg(
        F.sum(n).alias("_n"),
        (F.sum(v * n) / F.sum(n)).alias("_mean"),
        F.min(v).alias("_low"),
        F.max(v).alias("_high"),
        F.count(F.lit(1)).alias("_unique"),
    )
    placed = ranked.join(F.broadcast(sums), "column").withColumn(  # one row per column
        "_bin", equal_width_bin(v, F.col("_low"), F.col("_high"), bins)
    )
    counts = [F.sum(F.when(F.col("_bin") == b, n).otherwise(0)) for b in range(1, bins + 1)]
    squares = F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean")))
    return placed.groupBy("column", "_n", "_mean", "_low", "_high", "_unique").agg(
        F.when(F.col("_n") > 1, F.sqrt(squares / F.greatest(F.col("_n") - 1, F.lit(1)))).alias("_sd"),
        F.concat_ws(",", *[c.cast("string") for c in counts]).alias("_hist"),
    )


def summary_long(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, measure, value)``: min, exact median, mean, max and sample deviation.

    Of one table ``df`` is read once; all five come from its value counts. By key the
    medians come from :func:`grouped_quantiles`, which reads a staged table again.
    """
    if keys:
        return _summary_by_key(df, value, list(keys))
    ranked = ranked_values(df, [value])
    wide = (
        value_moments(ranked)
        .join(quantiles_of_ranked(ranked, [0.5]), "column")
        .select(
            F.col("_low").alias("Min"),
            F.col("quantile").alias("Median"),
            F.col("_mean").alias("Mean"),
            F.col("_high").alias("Max"),
            F.col("_sd").alias("Standard Dev"),
        )
    )
    return wide.unpivot([], wide.columns, "measure", "value")


def _summary_by_key(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    rows = stage(df.select(*keys, F.col(value).cast("double").alias("_value")), "values")
    known = rows.filter("_value IS NOT NULL AND NOT isnan(_value)")
    moments = known.groupBy(*keys).agg(
        F.min("_value").alias("Min"),
        F.avg("_value").alias("Mean"),
        F.max("_value").alias("Max"),
        F.stddev_samp("_value").alias("Standard Dev"),
    )
    medians = grouped_quantiles(rows, ["_value"], [0.5], keys)
    medians = medians.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("quantile").alias("Median"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    wide = moments.join(medians, same).drop(*[f"_key_{i}" for i in range(len(keys))])
    return wide.unpivot(keys, ["Min", "Median", "Mean", "Max", "Standard Dev"], "measure", "value")


def histogram(
    df: DataFrame, value: Column, low: Column, high: Column, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Counts per equal-width bin; values outside [low, high] are dropped."""
    binned = df.withColumn("bin", equal_width_bin(value, low, high, bins)).filter(F.col("bin").isNotNull())
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def histogram_free_range(df: DataFrame, value: str, bins: int, by: Sequence[str]) -> DataFrame:
    """Counts per bin where every group has its own range.

    The ranges, one row per group, are staged: their true size then decides whether
    the rows can stay where they are or must be shuffled to their range.
    """
    ranges = stage(df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high")), "ranges")
    return histogram(df.join(ranges, list(by)), F.col(value), F.col("_low"), F.col("_high"), bins, by)


def table_skim(
    df: DataFrame,
    numbers: Sequence[str],
    dates: Sequence[str] = (),
    factors: Sequence[str] = (),
    bins: int = 5,
    top: int = 3,
) -> DataFrame:
    """One row per column: missing values, moments, exact quartiles, histogram,
    distinct values and most frequent values, as far as the kind of column has them.

    The rows are read once, for a table of how often each column holds each value, text or
    NULL; numbers and dates (as days) share a column of it. It is written, and everything
    else is read from it. A table without rows gives none.
    """
    every = [*numbers, *dates, *factors]
    counts = _cell_counts(df, numbers, dates, factors)
    known = counts.filter("value IS NOT NULL AND NOT isnan(value)").select("column", "value", "copies")
    ranked = range_segments(known, ["column", "value"])
    kinds = {**dict.fromkeys(numbers, "numeric"), **dict.fromkeys(dates, "date"), **dict.fromkeys(factors, "factor")}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])

    missing = F.coalesce(F.sum(F.when(F.col("value").isNull() & F.col("level").isNull(), F.col("copies"))), F.lit(0))
    sizes = counts.groupBy("column").agg(F.sum("copies").alias("_rows"), missing.alias("n_missing"))
    base = with_names(sizes, every).select(
        "column",
        kind[F.col("column")].alias("kind"),
        "n_missing",
        ((F.col("_rows") - F.col("n_missing")) / F.col("_rows")).alias("complete_rate"),
    )

    shape = value_moments(ranked, bins)
    quartiles = (
        quantiles_of_ranked(ranked, QUARTILES)
        .groupBy("column")
        .agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(f"_p{int(100 * p)}") for p in QUARTILES])
    )

    numeric = with_names(shape.join(quartiles, "column"), [*numbers, *dates])
    skim = base.join(numeric, "column", "left")
    if factors:
        skim = skim.join(_top_values(with_names(counts.filter("level IS NOT NULL"), every), factors, top), "column", "left")
    else:
        skim = skim.withColumns({"_levels": F.lit(None).cast("long"), "top_counts": F.lit(None).cast("string")})

    is_number, is_date = F.col("kind") == "numeric", F.col("kind") == "date"
    number = lambda c: F.when(is_number, F.col(c))
    date = lambda c: F.when(is_date, F.date_from_unix_date(F.floor(F.col(c)).cast("int")))
    return skim.select(
        "column",
        "kind",
        "n_missing",
        "complete_rate",
        number("_mean").alias("mean"),
        number("_sd").alias("sd"),
        *[number(f"_p{int(100 * p)}").alias(f"p{int(100 * p)}") for p in QUARTILES],
        number("_hist").alias("hist"),
        date("_p0").alias("date_min"),
        date("_p50").alias("date_median"),
        date("_p100").alias("date_max"),
        F.when(is_date, F.col("_unique")).otherwise(F.col("_levels")).alias("n_unique"),
        "top_counts",
    )


def _cell_counts(
    df: DataFrame, numbers: Sequence[str], dates: Sequence[str], factors: Sequence[str]
) -> DataFrame:
    """``(column, value, level, copies)``, written once; ``column`` is a place among all columns."""
    values = [*[F.col(c) for c in numbers], *[F.unix_date(F.to_date(d)) for d in dates], *[F.lit(None)] * len(factors)]
    levels = [*[F.lit(None)] * (len(numbers) + len(dates)), *[F.col(c) for c in factors]]
    cells = [
        F.struct(F.lit(i).alias("column"), v.cast("double").alias("value"), x.cast("string").alias("level"))
        for i, (v, x) in enumerate(zip(values, levels))
    ]
    long = df.select(F.inline(F.array(*cells)))
    return stage(long.groupBy("column", "value", "level").agg(F.count(F.lit(1)).alias("copies")), "cells")


def _top_values(levels: DataFrame, factors: Sequence[str], top: int) -> DataFrame:
    """``(column, _levels, top_counts)`` with the most frequent levels as text.

    The number of levels may be large, so the top ones come from a sort with a
    limit per column rather than from one window over all levels.
    """
    best = None
    for factor in factors:
        one = levels.filter(F.col("column") == factor).orderBy(F.desc("copies"), "level").limit(top)
        best = one if best is None else best.unionByName(one)
    entry = F.struct((-F.col("copies")).alias("order"), "level", "copies")
    ordered = F.array_sort(F.collect_list(entry))  # at most ``top`` entries
    text = F.transform(ordered, lambda e: F.format_string("%s: %d", e["level"], e["copies"]))
    tops = best.groupBy("column").agg(F.concat_ws(", ", text).alias("top_counts"))
    return levels.groupBy("column").agg(F.count(F.lit(1)).alias("_levels")).join(tops, "column")
