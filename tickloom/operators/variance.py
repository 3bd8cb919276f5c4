"""Realized variance, its sparse estimators, signature curves, autocorrelation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import annualise, is_missing, log_change
from .ordered import Axis, MINUTES, START, HERE, block_axis, guarded_sum, minute_axis, prefix_sums, sums_across

SPARSE_GRID = range(1, 61)
ROLLING_PERIODS = (5, 10, 15, 30)
# The pairs (minutes summed, rows skipped) that are studied.
ROLLING_GRID = (
    (5, 1), (10, 1), (10, 2), (15, 1), (15, 3), (15, 5), (30, 1), (30, 3), (30, 5), (30, 10),
)


def sum_of_squares(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Missing values are left out, as are groups that have nothing else."""
    known = F.when(~is_missing(F.col(value)), F.col(value) * F.col(value))
    return df.groupBy(*by).agg(F.sum(known).alias(name)).filter(F.col(name).isNotNull())


def drop_zero_rv(df: DataFrame, name: str = "rv") -> DataFrame:
    """NULL goes as well as zero."""
    return df.filter(F.col(name) != 0)


def realized_variance(
    returns: DataFrame, keys: Sequence[str] = (), form: str = "sqrt_252_rv", keep_zero: bool = False
) -> DataFrame:
    """Per date the sum of squared returns and its annualised root."""
    rv = sum_of_squares(returns, "log_ret", [*keys, "index_date"], "rv")
    rv = rv if keep_zero else drop_zero_rv(rv)
    return rv.withColumn("rv_an", annualise(F.col("rv"), form))


def sparse_rv_calendar(
    prices: DataFrame,
    grid: Iterable[int] = SPARSE_GRID,
    overnight: str = "include",
    price: str = "last_price",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Realized variance of prices sampled every ``s`` minutes, for all ``s`` at once.

    A minute takes part in sampling ``s`` when ``s`` divides its minute of the hour;
    the opening row of every date but the first is left out. So the first return
    of a date reaches back to the last sample of the previous date:
    ``overnight="include"`` keeps it, ``"exclude"`` drops it.

    Each row is repeated once per divisor (5.2 times on average for 1..60) rather
    than once per ``s``. All row-level work is partitioned by ``keys + date``, which
    serves every ``s``, so the repeated rows are never shuffled. Returns across
    dates need only the first and the last sample of each ``(s, date)``; they are
    taken from that small table and added to the sums.
    """
    return sparse_rv_of_ends(sparse_ends(prices, grid, price, keys), overnight, keys)


def sparse_ends(
    prices: DataFrame, grid: Iterable[int] = SPARSE_GRID, price: str = "last_price", keys: Sequence[str] = ()
) -> DataFrame:
    """One row per ``(s, date)``: the sum of squares inside the date, its first and last
    sample, and the price of its opening row."""
    periods = sorted(set(grid))
    date = [*keys, "index_date"]
    day = Window.partitionBy(*date).orderBy("index_time")
    minute = F.floor(F.pmod(F.col("index_time"), F.lit(3600)) / 60).cast("int")
    divisors = F.array(
        *[F.array(*[F.lit(s) for s in periods if m % s == 0]).cast("array<int>") for m in range(60)]
    )
    long = (
        prices.select(*date, "index_time", F.col(price).alias("_price"))
        .withColumn("_opening", F.row_number().over(day) == 1)
        .withColumn("s_grid", F.explode(F.element_at(divisors, minute + 1)))
        .withColumn("_sample", F.when(~F.col("_opening"), F.col("_price")))
    )
    within_s = Window.partitionBy(*date, "s_grid").orderBy("index_time")
    move = log_change(F.col("_sample"), F.lag("_sample").over(within_s))
    known = ~is_missing(F.col("_move"))
    at = F.when(~F.col("_opening"), F.col("index_time"))
    return (
        long.withColumn("_move", move)
        .groupBy(*date, "s_grid")
        .agg(
            F.sum(F.when(known, F.col("_move") * F.col("_move"))).alias("_inside"),
            F.min_by("_sample", at).alias("_first"),
            F.max_by("_sample", at).alias("_last"),
            F.max(F.when(F.col("_opening"), F.col("_price"))).alias("_open"),
        )
    )


def _chained(ends: DataFrame, keys: Sequence[str], carried: DataFrame | None) -> DataFrame:
    """``ends`` with ``_debut``, ``_chain``, the last sample of the date, and ``_carried``, that of the stored dates."""
    # The opening row of a key's first date has no date before it and so counts as a sample.
    debut = F.col("index_date") == F.min("index_date").over(Window.partitionBy(*keys))
    if carried is None:
        known = ends.withColumn("_carried", F.lit(None).cast("double"))
    else:
        on = [*keys, "s_grid"]
        known = ends.join(carried.select(*on, F.col("sample").alias("_carried")), on, "left")
        if keys:
            seen = carried.select(*keys, F.lit(True).alias("_seen")).distinct()
            known = known.join(seen, list(keys), "left")
            debut = debut & F.col("_seen").isNull()
        elif not carried.isEmpty():
            debut = F.lit(False)
    chained = known.withColumn("_debut", debut).drop("_seen")
    return chained.withColumn("_chain", F.coalesce("_last", F.when(F.col("_debut"), F.col("_open"))))


def sparse_rv_of_ends(
    ends: DataFrame, overnight: str = "include", keys: Sequence[str] = (), carried: DataFrame | None = None
) -> DataFrame:
    """Sparse variances from :func:`sparse_ends`; ``carried`` are the :func:`last_samples` of earlier dates."""
    if overnight not in ("include", "exclude"):
        raise ValueError(f"unknown overnight rule {overnight!r}")
    earlier = Window.partitionBy(*keys, "s_grid").orderBy("index_date").rowsBetween(START, -1)
    before = F.when(F.col("_debut"), F.col("_open"))
    if overnight == "include":
        before = before.otherwise(F.coalesce(F.last("_chain", ignorenulls=True).over(earlier), "_carried"))
    entry = _chained(ends, keys, carried).withColumn("_entry", log_change(F.col("_first"), before))
    crossing = F.when(~is_missing(F.col("_entry")), F.col("_entry") * F.col("_entry"))
    total = F.when(
        F.col("_inside").isNotNull() | crossing.isNotNull(),
        F.coalesce("_inside", F.lit(0.0)) + F.coalesce(crossing, F.lit(0.0)),
    )
    rv = entry.select(*keys, "s_grid", "index_date", total.alias("rv_sparse")).filter("rv_sparse IS NOT NULL")
    return rv.withColumn("rv_sparse_an", annualise(F.col("rv_sparse")))


def last_samples(ends: DataFrame, keys: Sequence[str] = (), carried: DataFrame | None = None) -> DataFrame:
    """``(keys, s_grid, sample)``: the last price sampled every ``s`` minutes up to the end of these dates."""
    on = [*keys, "s_grid"]
    at = F.when(F.col("_chain").isNotNull(), F.col("index_date"))
    latest = _chained(ends, keys, carried).groupBy(*on).agg(F.max_by("_chain", at).alias("sample"))
    if carried is None:
        return latest
    both = latest.join(carried.select(*on, F.col("sample").alias("_carried")), on, "full")
    return both.select(*on, F.coalesce("sample", "_carried").alias("sample"))


def signature_curve(sparse: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean sparse variance over all dates, per sampling period."""
    return sparse.groupBy(*keys, "s_grid").agg(F.avg("rv_sparse").alias("mean_rv_sparse"))


def rolling_returns(
    returns: DataFrame,
    pairs: Iterable[tuple[int, int]] = ROLLING_GRID,
    axis: Axis = MINUTES,
    value: str = "log_ret",
    across: bool = False,
) -> DataFrame:
    """Long table ``(s, k, ..., ret)``: sums over ``s`` rows, of which, after the
    NULLs are gone, every ``k``-th of the whole series is kept.

    All sums and all row numbers come from one window over each segment. That equals
    sums over the whole series where each segment opens with NULL, as overnight
    returns do; a later segment that opens otherwise fails. With ``across`` windows run from
    one segment into the next, for overnight returns of zero: rows are then numbered
    and cut into blocks, and ``returns`` is read several times, so hand in a staged table.
    """
    pairs = list(pairs)
    periods = sorted({s for s, _ in pairs})
    rows = returns.select(*axis.segment_keys, *axis.order, value)
    if across:
        place = block_axis(axis)
        sums = sums_across(rows, value, {s: f"_sum{s}" for s in periods}, axis)
    else:
        place = axis
        sums = rows.withColumns({f"_sum{s}": guarded_sum(value, s, axis.within()) for s in periods})
    day = place.within()
    sizes = sums.groupBy(*place.segment_keys).agg(
        F.min_by(F.col(value).isNotNull(), place.position()).alias("_open"),
        *[F.count(f"_sum{s}").alias(f"_size{s}") for s in periods],
    )
    earlier = place.across().rowsBetween(START, -1)
    offset = lambda s: F.coalesce(F.sum(f"_size{s}").over(earlier), F.lit(0))
    if not across:
        crossed = F.col("_open") & F.lag("_open").over(place.across()).isNotNull()
        failed = F.raise_error(F.lit("a later segment does not open with NULL; use across=True")).cast("bigint")
        within = offset
        offset = lambda s: F.when(crossed, failed).otherwise(within(s))
    carry = sizes.select(*place.segment_keys, *[offset(s).alias(f"_offset{s}") for s in periods])
    ranked = sums.withColumns(
        {f"_rank{s}": F.count(f"_sum{s}").over(day.rowsBetween(START, HERE)) for s in periods}
    ).join(carry, place.segment_keys, "left")
    choices = F.array(
        *[
            F.struct(
                F.lit(s).alias("s"),
                F.lit(k).alias("k"),
                F.col(f"_sum{s}").alias("ret"),
                ((F.col(f"_rank{s}") + F.col(f"_offset{s}") - 1) % k == 0).alias("kept"),
            )
            for s, k in pairs
        ]
    )
    # entries that are not kept never become rows
    kept = F.filter(choices, lambda c: c["kept"] & c["ret"].isNotNull())
    return ranked.select(*axis.segment_keys, *axis.order, F.inline(kept)).drop("kept")


def rolling_rv(rolled: DataFrame, keys: Sequence[str] = (), form: str = "252_sqrt_rv") -> DataFrame:
    """Realized variance per ``(s, k, date)`` of the rolled returns."""
    rv = sum_of_squares(rolled, "ret", [*keys, "s", "k", "index_date"], "rv")
    return rv.withColumn("rv_an", annualise(F.col("rv"), form))


def rv_of_sums(
    returns: DataFrame, periods: Iterable[int] = SPARSE_GRID, keys: Sequence[str] = (), form: str = "252_sqrt_rv"
) -> DataFrame:
    """``(keys, s, index_date, rv, rv_an)`` of the sums over every ``s`` rows of a date, for all ``s`` at once.

    The sums come from cumulative sums and are squared and added up where they stand: one
    exchange by date, one sort, and one row per date on its way out, for any number of periods.
    """
    periods = sorted(set(periods))
    date = [*keys, "index_date"]
    sums = prefix_sums(returns.select(*date, "index_time", "log_ret"), "log_ret", {s: f"_{s}" for s in periods}, minute_axis(keys))
    wide = sums.groupBy(*date).agg(*[F.sum(F.col(f"_{s}") * F.col(f"_{s}")).alias(f"_{s}") for s in periods])
    entries = F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"_{s}").alias("rv")) for s in periods])
    rv = wide.select(*date, F.inline(entries)).filter("rv IS NOT NULL")
    return rv.select(*keys, "s", "index_date", "rv", annualise(F.col("rv"), form).alias("rv_an"))


def sparse_rv_rolling(
    returns: DataFrame, periods: Iterable[int] = ROLLING_PERIODS, keys: Sequence[str] = (), across: bool = False
) -> DataFrame:
    """Every ``s``-th of the sums over ``s`` rows, squared and summed per date."""
    rolled = rolling_returns(returns, [(s, s) for s in periods], minute_axis(keys), across=across)
    rv = sum_of_squares(rolled, "ret", [*keys, "s", "index_date"], "rv_sparse")
    return rv.withColumn("rv_sparse_an", annualise(F.col("rv_sparse"))).withColumnRenamed("s", "s_grid")


def estimators_by_date(
    rv: DataFrame, sparse: DataFrame, periods: Iterable[int] = ROLLING_PERIODS, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per date of ``rv`` with a column per sparse estimator.

    One conditional aggregate and one join take the place of a join per estimator.
    """
    on = [*keys, "index_date"]
    wide = sparse.groupBy(*on).agg(
        *[F.max(F.when(F.col("s_grid") == s, F.col("rv_sparse"))).alias(f"rv_s{s}") for s in periods]
    )
    return rv.select(*on, "rv").join(wide, on, "left")


def estimators_by_joins(
    rv: DataFrame, sparse: DataFrame, periods: Iterable[int] = ROLLING_PERIODS, keys: Sequence[str] = ()
) -> DataFrame:
    """The same table as a chain of left joins."""
    on = [*keys, "index_date"]
    joined = rv.select(*on, "rv")
    for s in periods:
        one = sparse.filter(F.col("s_grid") == s).select(*on, F.col("rv_sparse").alias(f"rv_s{s}"))
        joined = joined.join(one, on, "left")
    return joined


def signature_wide(estimators: DataFrame, periods: Iterable[int] = ROLLING_PERIODS) -> DataFrame:
    """Mean of each estimator, long: ``(s, avg_rv_sparse, minutes)``. NULLs are skipped."""
    columns = {"s1": ("rv", 1), **{f"s{s}": (f"rv_s{s}", s) for s in periods}}
    means = estimators.agg(*[F.avg(source).alias(name) for name, (source, _) in columns.items()])
    minutes = F.regexp_replace("s", "^s", "").cast("int")
    return means.unpivot([], list(columns), "s", "avg_rv_sparse").withColumn("minutes", minutes)


def acf(
    daily: DataFrame, value: str, order: str, max_lag: int = 100, keys: Sequence[str] = ()
) -> DataFrame:
    """Autocorrelations at lags 1..max_lag of a series with one row per date.

    Deviations are from the mean of all rows and no lag is corrected for its
    shorter length. Each row is sent to the ``max_lag`` later rows it meets.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    series = daily.select(
        *keys,
        F.row_number().over(whole.orderBy(order)).alias("_t"),
        (F.col(value) - F.avg(value).over(whole)).alias("_dev"),
    )
    centred = series.withColumn("_total", F.sum(F.col("_dev") * F.col("_dev")).over(whole))
    lags = F.explode(F.sequence(F.lit(1), F.lit(max_lag)))
    sent = centred.withColumn("lag", lags).select(
        *keys, "lag", "_total", (F.col("_t") + F.col("lag")).alias("_t"), F.col("_dev").alias("_earlier")
    )
    return (
        sent.join(centred.drop("_total"), [*keys, "_t"])
        .groupBy(*keys, "lag")
        .agg(F.sum(F.col("_earlier") * F.col("_dev")).alias("_cross"), F.max("_total").alias("_total"))
        .select(*keys, "lag", (F.col("_cross") / F.when(F.col("_total") != 0, F.col("_total"))).alias("acf"))
    )
