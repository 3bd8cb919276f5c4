"""Daily models built on realized variance. Inputs have one row per date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import TRADING_DAYS, is_missing, log_change, natural_log
from .ordered import HERE

HAR_SPANS = {"ln_rv_d": 1, "ln_rv_w": 5, "ln_rv_m": 21}
HORIZON = 21


def trend_smooth(daily: DataFrame, value: str, order: str, half_width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Centred moving average over ``2 * half_width + 1`` dates, fewer at the ends."""
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half_width, half_width)
    return daily.withColumn("smooth", F.avg(value).over(around))


def local_trend(daily: DataFrame, value: str, order: str, half_width: int, keys: Sequence[str] = ()) -> DataFrame:
    """``trend``: a line fitted around each date, at that date.

    The ``2 * half_width + 1`` nearest rows in order, fewer at the ends, take part with
    tricube weights of their distance in days, zero at the farthest. NULLs and NaNs take
    no part; dates without a value get a trend from their neighbours. Where the rows give
    no slope the weighted mean stands in. The fit needs five weighted sums over a short
    array, so a date costs its neighbourhood, not the series.
    """
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half_width, half_width)
    day = F.unix_date(F.to_date(order)).cast("double")
    point = F.when(~is_missing(F.col(value)), F.struct(day.alias("x"), F.col(value).cast("double").alias("y")))
    near = daily.withColumn("_near", F.collect_list(point).over(around))  # NULLs are not collected
    centred = F.transform("_near", lambda p: F.struct((p["x"] - day).alias("x"), p["y"].alias("y")))
    reach = F.array_max(F.transform("_near", lambda p: F.abs(p["x"] - day)))
    near = near.withColumns({"_near": centred, "_reach": reach})
    share = lambda p: F.abs(p["x"]) / F.col("_reach")
    weight = lambda p: F.when(F.col("_reach") == 0, F.lit(1.0)).otherwise(F.pow(1 - F.pow(share(p), F.lit(3.0)), F.lit(3.0)))
    weighed = F.transform("_near", lambda p: F.struct(weight(p).alias("w"), p["x"].alias("x"), p["y"].alias("y")))
    near = near.withColumn("_near", weighed)
    total = lambda term: F.aggregate("_near", F.lit(0.0), lambda a, p: a + term(p))
    sums = {
        "_w": total(lambda p: p["w"]),
        "_wx": total(lambda p: p["w"] * p["x"]),
        "_wxx": total(lambda p: p["w"] * p["x"] * p["x"]),
        "_wy": total(lambda p: p["w"] * p["y"]),
        "_wxy": total(lambda p: p["w"] * p["x"] * p["y"]),
    }
    spread = F.col("_w") * F.col("_wxx") - F.col("_wx") * F.col("_wx")
    line = (F.col("_wxx") * F.col("_wy") - F.col("_wx") * F.col("_wxy")) / spread
    mean = F.when(F.col("_w") > 0, F.col("_wy") / F.when(F.col("_w") > 0, F.col("_w")))
    fitted = F.when(F.abs(spread) > 1e-9, line).otherwise(mean)
    return near.withColumns(sums).withColumn("trend", fitted).drop("_near", "_reach", *sums)


def har_features(
    daily: DataFrame, rv: str, order: str, horizon: int = HORIZON, keys: Sequence[str] = ()
) -> DataFrame:
    """Logs of the mean variance over the last 1, 5 and 21 dates, and of the mean
    over the next ``horizon`` dates. Incomplete spans are NULL."""
    dates = Window.partitionBy(*keys).orderBy(order)

    def log_mean(first: int, last: int, length: int):
        frame = dates.rowsBetween(first, last)
        return F.when(F.count(rv).over(frame) == length, natural_log(F.avg(rv).over(frame)))

    spans = {name: log_mean(1 - n, HERE, n) for name, n in HAR_SPANS.items()}
    return daily.select(*keys, order, rv).withColumns({**spans, "ln_rv_next": log_mean(1, horizon, horizon)})


def har_fit(features: DataFrame) -> DataFrame:
    """``(term, estimate)`` of the least-squares fit on the rows without NULL.

    The fit reduces the rows to one small matrix of sums on the executors; the
    driver solves a system of four unknowns.
    """
    inputs = list(HAR_SPANS)
    complete = features.select(*inputs, "ln_rv_next").dropna()
    rows = VectorAssembler(inputCols=inputs, outputCol="_inputs").transform(complete)
    fit = LinearRegression(featuresCol="_inputs", labelCol="ln_rv_next", solver="normal").fit(rows)
    estimates = [("(Intercept)", float(fit.intercept))]
    estimates += [(name, float(b)) for name, b in zip(inputs, fit.coefficients)]
    return features.sparkSession.createDataFrame(estimates, "term string, estimate double")


def rv_iv_join(rv: DataFrame, iv: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rv.join(iv, [*keys, "index_date"])


def variance_risk_premium(both: DataFrame, iv: str = "iv", rv: str = "rv") -> DataFrame:
    """Implied minus realized, both as daily variance. ``iv`` is a yearly percentage."""
    daily_iv = F.col(iv) * F.col(iv) / (100.0 * 100.0 * TRADING_DAYS)
    return both.withColumn("iv_var", daily_iv).withColumn("vrp", F.col("iv_var") - F.col(rv))


def next_day_return(closes: DataFrame, price: str, keys: Sequence[str] = ()) -> DataFrame:
    """``ret_next``: log change from this date's close to the next one's."""
    dates = Window.partitionBy(*keys).orderBy("index_date")
    return closes.withColumn("ret_next", log_change(F.lead(price).over(dates), F.col(price)))


def vrp_regression(df: DataFrame, y: str = "ret_next", x: str = "vrp", keys: Sequence[str] = ()) -> DataFrame:
    """Intercept, slope and fit of ``y = alpha + beta * x`` in one aggregate."""
    pairs = df.filter(~is_missing(F.col(y)) & ~is_missing(F.col(x)))
    return pairs.groupBy(*keys).agg(
        F.regr_intercept(y, x).alias("alpha"),
        F.regr_slope(y, x).alias("beta"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def realized_moments(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Realized skewness and kurtosis per date."""
    r = F.col("log_ret")
    sums = (
        returns.filter(~is_missing(r))
        .groupBy(*keys, "index_date")
        .agg(
            F.count(r).alias("n"),
            F.sum(r * r).alias("rv"),
            F.sum(r * r * r).alias("_cube"),
            F.sum(r * r * r * r).alias("_fourth"),
        )
        .filter(F.col("rv") > 0)
    )
    return sums.select(
        *keys,
        "index_date",
        "n",
        "rv",
        (F.sqrt("n") * F.col("_cube") / F.pow("rv", F.lit(1.5))).alias("rskew"),
        (F.col("n") * F.col("_fourth") / (F.col("rv") * F.col("rv"))).alias("rkurt"),
    )
