"""Exact quantiles of many groups by narrowing ranges of values; no group is sorted or gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage

#: Ranges that a span is cut into by one pass.
RANGES = 1024
#: Values of a span, at most, that are sorted in one array instead of cut further.
FEW = 4096
#: Groups whose spans may be broadcast to the rows (some 10 MB).
GROUPS = 50_000


def grouped_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    ranges: int = RANGES,
    few: int = FEW,
) -> DataFrame:
    """``(keys, column, p, quantile)``: exact, linear between neighbours, NULL and NaN left out.

    The first pass finds size and extremes of every group. Each further pass cuts the spans
    in which a wanted rank lies into equal ranges and counts the rows of each range, with
    its own extremes; the range that holds the rank is the next span. Counts are combined
    before the shuffle, so a pass moves at most ``ranges`` rows per task and span, whether
    a group has ten rows or a third of the table. A span of one value is done, one of up to
    ``few`` rows is sorted at last. The extremes of a span get ranges of their own, so every
    pass makes progress, also against outliers and infinities. ``df`` is read two to four
    times as a rule: hand in a staged table.
    """
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))
    cells = F.array(*[F.struct(F.lit(i).alias("_column"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    # + 0.0 makes one zero of the two
    long = df.select(group.alias("_g"), F.inline(cells)).filter("_v IS NOT NULL AND NOT isnan(_v)")
    long = long.withColumn("_v", F.col("_v") + F.lit(0.0))
    of, span = ["_g", "_column"], ["_g", "_column", "_lo", "_hi"]
    sizes = stage(
        long.groupBy(*of).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes"
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    asked = sizes.select(*of, "_n", wanted.alias("p")).withColumn("_at", (F.col("_n") - 1) * F.col("p"))
    ends = asked.select(*of, F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).distinct()
    state = ends.join(sizes, of).select(*span, "_rank", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_held"))
    state = stage(state, "ranks")
    solved = None
    while True:
        single = F.col("_lo") == F.col("_hi")
        small = ~single & (F.col("_held") <= few)
        now = state.filter(single).select(*of, "_rank", F.col("_lo").alias("_value"))
        solved = now if solved is None else solved.unionByName(now)
        if not state.filter(small).isEmpty():
            inside = _inside(long, state.filter(small)).groupBy(*span).agg(F.array_sort(F.collect_list("_v")).alias("_values"))
            at = F.element_at("_values", (F.col("_rank") - F.col("_below") + 1).cast("int"))
            solved = solved.unionByName(state.filter(small).join(inside, span).select(*of, "_rank", at.alias("_value")))
        state = state.filter(~single & ~small)
        if state.isEmpty():
            break
        place = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * ranges)
        place = F.greatest(F.lit(0), F.least(place.cast("int"), F.lit(ranges - 1)))
        edge = F.when(F.col("_v") == F.col("_lo"), -1).when(F.col("_v") == F.col("_hi"), ranges).otherwise(place)
        counted = (
            _inside(long, state)
            .groupBy(*span, edge.alias("_range"))
            .agg(F.count(F.lit(1)).alias("_count"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        )
        before = Window.partitionBy(*span).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
        offset = F.col("_rank") - F.col("_below") - F.col("_before")
        state = stage(
            state.join(counted, span)
            .filter((offset >= 0) & (offset < F.col("_count")))
            .select(
                *of,
                F.col("_first").alias("_lo"),
                F.col("_last").alias("_hi"),
                "_rank",
                (F.col("_below") + F.col("_before")).alias("_below"),
                F.col("_count").alias("_held"),
            ),
            "ranks",
        )
    solved = stage(solved, "values")
    low = solved.select(*of, F.col("_rank").alias("_low"), F.col("_value").alias("_v0"))
    high = solved.select(*of, F.col("_rank").alias("_high"), F.col("_value").alias("_v1"))
    both = asked.withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at")}).join(low, [*of, "_low"]).join(high, [*of, "_high"])
    share = F.col("_at") - F.col("_low")
    between = F.when(share > 0, F.col("_v0") + share * (F.col("_v1") - F.col("_v0"))).otherwise(F.col("_v0"))
    names = F.array(*[F.lit(c) for c in columns])
    return both.select(
        *[F.col(f"_g.{k}").alias(k) for k in keys],
        F.element_at(names, F.col("_column") + 1).alias("column"),
        "p",
        between.alias("quantile"),
    )


def _inside(long: DataFrame, state: DataFrame) -> DataFrame:
    """Rows that lie in a span, with its ends. Spans of a group do not overlap."""
    of = ["_g", "_column"]
    spans = state.select(*of, "_lo", "_hi").distinct().groupBy(*of).agg(F.collect_list(F.struct("_lo", "_hi")).alias("_spans"))
    if state.select(*of).distinct().count() <= GROUPS:
        spans = F.broadcast(spans)  # else adaptive execution splits the rows of a hot group
    own = F.filter("_spans", lambda s: F.col("_v").between(s["_lo"], s["_hi"]))
    met = long.join(spans, of).withColumn("_span", F.get(own, F.lit(0)))
    return met.filter("_span IS NOT NULL").select(*of, "_v", "_span.*")
