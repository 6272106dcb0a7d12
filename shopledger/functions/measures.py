"""Aggregates and numeric display rules.

Sums keep the full double. Each value is split without loss into a multiple of 1/10,000
and a small rest. The multiples are summed exactly as ``bigint``, in a high and a low part,
and the rests as doubles, so that values with up to four decimals give the same sum under
any partitioning, task order or retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000
_LOW_BITS = 20
_LARGE = 1e11


def exact_sum(c: Column) -> Column:
    """Sum of the values; nulls and NaN are skipped, and a group without values gives 0.

    A value beyond ``_LARGE`` has no decimals worth an exact part and is summed as a double.
    """
    value = _number(c)
    small = F.abs(value) < F.lit(_LARGE)
    whole = F.rint(F.when(small, value).otherwise(F.lit(0.0)) * F.lit(float(SCALE)))
    rest = F.sum(value - whole / F.lit(float(SCALE)))
    units = whole.cast("bigint")
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("double")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("double")
    total = (high * F.lit(float(1 << _LOW_BITS)) + low) / F.lit(float(SCALE)) + rest
    return F.coalesce(total, F.lit(0.0))


def _number(c: Column) -> Column:
    """The value as a double; NaN is no value."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def exact_mean(c: Column) -> Column:
    """Mean over the values that are neither null nor NaN; null when there are none."""
    return F.try_divide(exact_sum(c), F.count(_number(c)).cast("double"))


def rint_to(c: Column, places: int) -> Column:
    """Round half to even on the scaled double."""
    factor = F.lit(float(10**places))
    return F.rint(c * factor) / factor


def percent_or_zero(part: Column, whole: Column, places: int = 2) -> Column:
    """``part / whole`` in percent, rounded; 0/0 gives 0.

    A non-zero part over zero gives null: there is no useful infinite percentage.
    """
    ratio = rint_to(F.try_divide(part, whole) * F.lit(100.0), places)
    return F.when((part == 0) & (whole == 0), F.lit(0.0)).otherwise(ratio)


def number_text(c: Column, places: int = 0) -> Column:
    """Thousands-separated text, for a last display projection."""
    return F.format_number(c, places)


def integer_text(c: Column) -> Column:
    """The whole part as text."""
    return c.cast("bigint").cast("string")


def money_text(c: Column, places: int = 2) -> Column:
    """Currency text such as ``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(c, places))
