"""Numeric expressions whose NULL, NaN and zero rules matter here."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TRADING_DAYS = 252


def natural_log(x: Column) -> Column:
    """Logarithm with ``log(0) = -Infinity`` and NaN below zero.

    ``F.log`` gives NULL there, which would read as a missing price.
    """
    return (
        F.when(x > 0, F.log(x))
        .when(x == 0, F.lit(float("-inf")))
        .when(x < 0, F.lit(float("nan")))
    )


def log_change(now: Column, before: Column) -> Column:
    """``log(now / before)``, as a difference so that a zero price cannot fail."""
    return natural_log(now) - natural_log(before)


def is_missing(x: Column) -> Column:
    """NULL or NaN; for floating-point columns."""
    return x.isNull() | F.isnan(x)


def if_else(test: Column, yes, no) -> Column:
    """A conditional that is NULL when the test is NULL (``when`` would say no)."""
    return F.when(test, yes).when(~test, no)


def clip_outliers(x: Column, threshold: float) -> Column:
    """Values with ``abs(x) < threshold`` stay, others become 0, missing stays NULL."""
    return F.when(is_missing(x), F.lit(None)).when(F.abs(x) < threshold, x).otherwise(0.0)


def annualise(rv: Column, form: str = "sqrt_252_rv") -> Column:
    if form == "sqrt_252_rv":
        return F.sqrt(TRADING_DAYS * rv)
    if form == "252_sqrt_rv":
        return TRADING_DAYS * F.sqrt(rv)
    raise ValueError(f"unknown annualisation {form!r}")


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 1..bins on [low, high]; the last bin is closed. NULL outside the range."""
    position = F.floor(bins * (x - low) / F.when(high > low, high - low)).cast("int") + 1
    position = F.coalesce(position, F.lit(1))  # a range of width zero has one bin
    return F.when((x >= low) & (x <= high), F.least(position, F.lit(bins)))
