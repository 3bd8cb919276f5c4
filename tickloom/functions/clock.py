"""Dates and times of day as column expressions.

A moment is kept as a date plus the seconds since midnight. Both are wall clock
of the exchange; no expression here looks at the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SESSION_OPEN = 8 * 3600 + 30 * 60
SESSION_CLOSE = 15 * 3600
MINUTE = 60
MINUTES_PER_SESSION = (SESSION_CLOSE - SESSION_OPEN) // MINUTE + 1


def parse_date_number(number: Column) -> Column:
    """``19960102`` (any numeric type) -> date."""
    return F.to_date(number.cast("int").cast("string"), "yyyyMMdd")


def time_of_day(ts: Column) -> Column:
    """Whole seconds since midnight."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def minute_of_day(ts: Column) -> Column:
    """Seconds since midnight, cut to the minute."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60


def parse_time_of_day(text: Column) -> Column:
    """``HH:mm:ss`` text -> seconds since midnight."""
    part = lambda i: F.split_part(text, F.lit(":"), F.lit(i)).cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def moment(date: Column, seconds: Column) -> Column:
    """Date and seconds since midnight -> ``timestamp_ntz``."""
    none = F.lit(0)
    return date.cast("timestamp_ntz") + F.make_dt_interval(none, none, none, seconds)


def epoch_seconds(date: Column, seconds: Column) -> Column:
    return F.unix_date(date).cast("long") * 86400 + seconds


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall clock, with or without a time zone."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def wall_clock(instant: Column) -> Column:
    """The UTC wall clock of an instant, to the second, as ``timestamp_ntz``."""
    none = F.lit(0)
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = F.unix_seconds(instant)
    days = F.floor(seconds / 86400).cast("int")
    return zero + F.make_dt_interval(days, none, none, F.pmod(seconds, F.lit(86400)))


def ordered_moment(ts: Column, tie: Column) -> Column:
    """Time and then a 64-bit tie breaker in one decimal, which orders rows without a struct:
    aggregates by it stay in a hash map."""
    return epoch_micros(ts).cast("decimal(18,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + tie.cast("decimal(19,0)")


def clock_text(seconds: Column) -> Column:
    """Seconds since midnight -> ``HH:mm:ss``."""
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(seconds / 3600).cast("int"),
        F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int"),
        F.pmod(seconds, F.lit(60)).cast("int"),
    )


def in_session(seconds: Column, opening: int = SESSION_OPEN, closing: int = SESSION_CLOSE) -> Column:
    """Both ends belong to the session."""
    return seconds.between(opening, closing)


def minute_range(opening: int, closing: int) -> Column:
    """Array of all minutes from ``opening`` to ``closing``, both included."""
    return F.sequence(F.lit(opening), F.lit(closing), F.lit(MINUTE))
