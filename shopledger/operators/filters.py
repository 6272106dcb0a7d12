"""Filters and the option lists that feed them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the choice that stands for "no filter".
ALL = "Todos"

Dates = tuple[dt.date, dt.date]


def date_range(
    df: DataFrame, column: str, dates: Dates | None, *, end_of_day: bool = False
) -> DataFrame:
    """Keep rows with ``dates[0] <= column <= dates[1]``.

    Both bounds are midnights, so later times on the last day fall outside unless
    ``end_of_day`` is set.
    """
    if dates is None:
        return df
    low = F.lit(dates[0]).cast("timestamp_ntz")
    c = F.col(column)
    if end_of_day:
        high = F.lit(dates[1] + dt.timedelta(days=1)).cast("timestamp_ntz")
        return df.where((c >= low) & (c < high))
    return df.where((c >= low) & (c <= F.lit(dates[1]).cast("timestamp_ntz")))


def in_list(
    df: DataFrame,
    column: str,
    values: Sequence | DataFrame | None,
    *,
    empty: str = "none",
) -> DataFrame:
    """Membership filter; ``None`` means the filter is not applied.

    ``empty`` says what an empty selection keeps: ``"none"`` or ``"all"`` rows.
    A long selection can be a one-column DataFrame, which becomes a semi join.
    """
    if empty not in ("none", "all"):
        raise ValueError(f"empty must be 'none' or 'all', not {empty!r}")
    if values is None:
        return df
    if isinstance(values, DataFrame):
        keys = values.toDF(column)
        return df.join(keys, column, "left_semi").select(*df.columns)
    if not values and empty == "all":
        return df
    return df.where(F.col(column).isin(list(values)))


def equal_to(df: DataFrame, choices: Mapping[str, object]) -> DataFrame:
    """Equality on each named column, skipping ``None`` and the ``ALL`` choice."""
    for column, value in choices.items():
        if value is not None and value != ALL:
            df = df.where(F.col(column) == F.lit(value))
    return df


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The non-null values of a column, once each, in ascending order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def selected(column: str, values: Iterable | None, *, empty: str = "all") -> Column:
    """Membership as a condition that is never null; ``None`` does not restrict.

    ``empty`` says whether an empty choice admits ``"all"`` rows or ``"none"``.
    """
    if values is None or (not values and empty == "all"):
        return F.lit(True)
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def within(column: str, dates: Dates | None) -> Column:
    """Date range as a condition that is never null; ``None`` does not restrict."""
    if dates is None:
        return F.lit(True)
    low, high = (F.lit(d).cast("timestamp_ntz") for d in dates)
    return F.coalesce(F.col(column).between(low, high), F.lit(False))


def option_rows(
    df: DataFrame,
    options: Mapping[str, tuple[str, Column]],
    times: tuple[str, Column] | None = None,
) -> DataFrame:
    """Several distinct lists and the day bounds of a time column in one pass.

    The result has rows ``(option, value)``. ``options`` maps a list's name to its
    column and to the condition under which a row contributes; ``times`` is a time
    column and its condition, reported as ``date_min`` and ``date_max``. Rows are
    expanded in memory and reduced before they are shuffled; the short lists are sorted last.
    """
    no_text, no_day = F.lit(None).cast("string"), F.lit(None).cast("date")
    entries = [
        F.when(
            condition & F.col(c).isNotNull(),
            F.struct(
                F.lit(name).alias("option"),
                F.col(c).cast("string").alias("value"),
                no_day.alias("day"),
            ),
        )
        for name, (c, condition) in options.items()
    ]
    if times is not None:
        day = F.to_date(times[0])
        date = F.struct(F.lit("date").alias("option"), no_text.alias("value"), day.alias("day"))
        entries.append(F.when(times[1] & day.isNotNull(), date))
    grouped = (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .where("e IS NOT NULL")
        .groupBy("e.option", "e.value")
        .agg(F.min("e.day").alias("lo"), F.max("e.day").alias("hi"))
    )
    bounds = F.array(_option("date_min", F.col("lo")), _option("date_max", F.col("hi")))
    listed = F.array(F.struct("option", "value"))
    rows = F.when(F.col("option") == "date", bounds).otherwise(listed)
    return grouped.select(F.inline(rows)).orderBy("option", "value")


def _option(name: str, day: Column) -> Column:
    return F.struct(F.lit(name).alias("option"), day.cast("string").alias("value"))


def date_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row with the smallest and the largest value of a time column."""
    return df.agg(F.min(column).alias("first_on"), F.max(column).alias("last_on"))
