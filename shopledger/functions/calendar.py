"""Calendar buckets, labels and day arithmetic. Buckets are ``DATE`` columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_US = 86_400_000_000


def week_start(c: Column) -> Column:
    """Monday of the week."""
    return F.trunc(c, "week")


def month_start(c: Column) -> Column:
    return F.trunc(c, "month")


def period_start(c: Column, grain: str) -> Column:
    if grain == "week":
        return week_start(c)
    if grain == "month":
        return month_start(c)
    raise ValueError(f"grain must be 'week' or 'month', not {grain!r}")


def sunday_week(c: Column) -> Column:
    """Week of the year counted from the first Sunday (0 before it)."""
    day = c.cast("date")
    return F.floor((F.dayofyear(day) + F.lit(7) - F.dayofweek(day)) / F.lit(7)).cast("int")


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def month_label(c: Column) -> Column:
    return F.date_format(c, "MMM-yyyy")


def period_label(c: Column, grain: str) -> Column:
    """Display label of a period start."""
    if grain == "month":
        return F.date_format(c, "MMMM yyyy")
    if grain == "week":
        week = F.lpad(sunday_week(c).cast("string"), 2, "0")
        return F.concat(F.lit("Semana "), week, F.lit(" ("), F.date_format(c, "dd-MMM"), F.lit(")"))
    raise ValueError(f"grain must be 'week' or 'month', not {grain!r}")


def as_of_timestamp(as_of: dt.date | None) -> Column:
    """Midnight of the reference day; today when none is given."""
    day = F.current_date() if as_of is None else F.lit(as_of)
    return day.cast("timestamp_ntz")


def whole_days(end: Column, start: Column) -> Column:
    """Elapsed time in days, rounded down (not a difference of calendar dates)."""
    elapsed = F.timestamp_diff(
        "MICROSECOND", start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    )
    return F.floor(elapsed / F.lit(float(_DAY_US))).cast("bigint")
