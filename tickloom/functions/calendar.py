"""Calendar features of a date or a time of day."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .clock import SESSION_CLOSE, SESSION_OPEN

# The thirteen half-hour labels of a session, spelt as published.
HALF_HOUR_LABELS = (
    "08:30 - 8:59",
    "09:00 - 9:29",
    "09:30 - 09:59",
    "10:00 - 10:29",
    "10:30 - 10:59",
    "11:00 - 11:29",
    "11:30 - 11:59",
    "12:00 - 12:29",
    "12:30 - 12:59",
    "13:00 - 13:29",
    "13:30 - 13:59",
    "14:00 - 14:29",
    "14:30 - 15:00",
)


def semester(date: Column) -> Column:
    return F.when(F.month(date) <= 6, 1).when(F.month(date) > 6, 2)


def month_label(date: Column) -> Column:
    return F.date_format(date, "MMM")


def weekday_number(date: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(date) + 1


def weekday_label(date: Column) -> Column:
    return F.date_format(date, "EEE")


def day_of_quarter(date: Column) -> Column:
    return F.datediff(date, F.trunc(date, "quarter")) + 1


def week_of_year(date: Column) -> Column:
    """Whole weeks since 1 January, plus one. This is not the ISO week."""
    return F.floor((F.dayofyear(date) - 1) / 7).cast("int") + 1


def week_of_month(date: Column) -> Column:
    """Row of the date in a month calendar whose weeks start on Monday."""
    lead_days = F.weekday(F.trunc(date, "month"))
    return F.floor((F.dayofmonth(date) + lead_days - 1) / 7).cast("int") + 1


def weekday_instance(date: Column) -> Column:
    """1 for the first Monday (Tuesday, ...) of its month, 2 for the second ..."""
    return F.floor((F.dayofmonth(date) - 1) / 7).cast("int") + 1


def half_hour_bucket(seconds: Column) -> Column:
    """Half-hours of the session, 1..13; the last one includes the closing minute.

    NULL outside the session.
    """
    step = F.floor((seconds - SESSION_OPEN) / 1800).cast("int") + 1
    inside = seconds.between(SESSION_OPEN, SESSION_CLOSE)
    return F.when(inside, F.least(step, F.lit(len(HALF_HOUR_LABELS))))


def half_hour_label(bucket: Column) -> Column:
    labels = F.array(*[F.lit(label) for label in HALF_HOUR_LABELS])
    return F.when(bucket.isNotNull(), F.element_at(labels, bucket))


def half_hour_bucket_legacy(seconds: Column) -> Column:
    """Older numbering by clock hour: hour 8 is 1, the hours 9 to 13 have two
    buckets each, the whole of hour 14 is 12, everything else is 13."""
    hour = F.floor(seconds / 3600).cast("int")
    second_half = F.floor(F.pmod(seconds, F.lit(3600)) / 1800).cast("int")
    return (
        F.when(hour == 8, 1)
        .when(hour.between(9, 13), 2 * (hour - 8) + second_half)
        .when(hour == 14, 12)
        .otherwise(13)
    )


def signature_columns(date: Column, seconds: Column) -> dict[str, Column]:
    """Calendar features of one grid row that need no other row."""
    return {
        "year": F.year(date),
        "half": semester(date),
        "quarter": F.quarter(date),
        "month": F.month(date),
        "month_label": month_label(date),
        "day": F.dayofmonth(date),
        "hour": F.floor(seconds / 3600).cast("int"),
        "minute": F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int"),
        "wday": weekday_number(date),
        "wday_label": weekday_label(date),
        "qday": day_of_quarter(date),
        "yday": F.dayofyear(date),
    }
