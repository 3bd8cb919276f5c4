"""Raw one-minute bars -> table of returns, the way the analyses read it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.clock import in_session, parse_date_number
from ..functions.numeric import if_else
from ..operators.grid import pad_session
from ..operators.ordered import minute_axis, number_rows
from ..operators.reshape import rename_positional
from ..operators.returns import (
    THRESHOLD,
    clip_returns,
    day_change,
    log_returns,
    overnight_to_zero,
    time_signature,
)
from ..schemas import RAW_BAR_NAMES
from ..session import stage

# The columns of the returns table, in order.
RETURNS_COLUMNS = (
    "index", "index_date", "index_time", "last_price", "log_ret", "volume", "no_trades", "index_num",
    "diff", "year", "half", "quarter", "month", "month_label", "day", "hour", "minute", "wday",
    "wday_label", "qday", "yday", "date_change",
)


def ticks_from_bars(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bars with 23 columns, named by position; only the needed ones are read."""
    bars = rename_positional(raw, RAW_BAR_NAMES)
    return bars.select(
        *keys,
        parse_date_number(F.col("raw_date")).alias("index_date"),
        F.col("raw_time").alias("index_time"),
        F.col("last").alias("last_price"),
        "volume",
        "no_trades",
    )


def prepare_returns(
    ticks: DataFrame, threshold: float = THRESHOLD, overnight: str = "null", keys: Sequence[str] = ()
) -> DataFrame:
    """Padded, signed and clipped one-minute returns."""
    # The signature reads the padded series twice.
    padded = stage(pad_session(ticks, extras=["volume", "no_trades"], keys=keys), "padded")
    signed = time_signature(padded, keys)
    returns = log_returns(signed, overnight=overnight, axis=minute_axis(keys))
    return clip_returns(returns, threshold).select(*keys, *RETURNS_COLUMNS)


def prepare_returns_unpadded(ticks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The older table: numbered ticks, returns between ticks as they come, no
    padding, and 0 for the first return of a date."""
    numbered = stage(number_rows(stage(ticks, "ticks"), "trade_id"), "numbered")
    moved = log_returns(numbered, overnight="include")
    session = stage(moved.filter(in_session(F.col("index_time"))), "session")
    changed = day_change(session)
    flag = if_else(F.col("day_change") == 1, F.lit(True), F.lit(False))
    zeroed = overnight_to_zero(changed.withColumn("date_change", flag)).drop("date_change")
    return clip_returns(zeroed, threshold)
