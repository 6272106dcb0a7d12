"""Purchase forecast by vendor, day and calendar month."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import exact_sum, month_name, month_start
from shopledger.operators import (
    date_range,
    dense_fill,
    in_list,
    month_spine,
    option_rows,
)
from shopledger.operators.filters import Dates, selected

# Fixed value: name of the row with the column totals.
TOTAL = "TOTAL"


def filter_purchases(
    forecast: DataFrame,
    dates: Dates | None = None,
    vendors: Sequence[str] | None = None,
    pos: Sequence[str] | None = None,
    types: Sequence[str] | None = None,
    *,
    end_of_day: bool = False,
) -> DataFrame:
    """Purchases in a date range of some vendors, orders and types.

    An empty selection keeps no rows; ``None`` leaves the filter out.
    """
    rows = date_range(forecast, "wanted_on", dates, end_of_day=end_of_day)
    rows = in_list(rows, "vendor", vendors)
    rows = in_list(rows, "po", pos)
    return in_list(rows, "type", types)


def purchase_options(
    forecast: DataFrame,
    types: Sequence[str] | None = None,
    vendors: Sequence[str] | None = None,
    pos: Sequence[str] | None = None,
) -> DataFrame:
    """Types, vendors, orders and date bounds; each list depends on those before it."""
    by_type = selected("type", types)
    by_vendor = by_type & selected("vendor", vendors)
    by_po = by_vendor & selected("po", pos)
    return option_rows(
        forecast,
        {"type": ("type", F.lit(True)), "vendor": ("vendor", by_type), "po": ("po", by_vendor)},
        ("wanted_on", by_po),
    )


def purchase_totals(forecast: DataFrame) -> DataFrame:
    """Total amount and pieces."""
    return forecast.agg(
        exact_sum(F.col("total")).alias("total"), exact_sum(F.col("quantity")).alias("pieces")
    )


def by_vendor(forecast: DataFrame) -> DataFrame:
    """Amount and pieces per vendor."""
    rows = forecast.where(F.col("vendor").isNotNull())
    return rows.groupBy("vendor").agg(
        exact_sum(F.col("total")).alias("total"), exact_sum(F.col("quantity")).alias("pieces")
    )


def by_day(forecast: DataFrame) -> DataFrame:
    """Amount and pieces per calendar day."""
    rows = forecast.where(F.col("wanted_on").isNotNull())
    return (
        rows.groupBy(F.to_date("wanted_on").alias("wanted_on"))
        .agg(exact_sum(F.col("total")).alias("total"), exact_sum(F.col("quantity")).alias("pieces"))
        .orderBy("wanted_on")
    )


def calendar(
    forecast: DataFrame,
    years: Sequence[int] | None = None,
    types: Sequence[str] | None = None,
) -> DataFrame:
    """Quantity per type for all twelve months of each year, with the column totals.

    Long form; ``is_total`` tells the totals apart from a type of the same name.
    """
    chosen = _chosen(forecast, years, types)
    rows = _with_totals(_monthly(chosen))
    first_months = F.array_sort(F.collect_set(F.trunc("wanted_on", "year")))
    twelve = F.flatten(
        F.transform(
            first_months,
            lambda d: F.sequence(d, F.add_months(d, 11), F.expr("INTERVAL 1 MONTH")),
        )
    )
    spine = chosen.agg(twelve.alias("spine")).scalar()
    filled = dense_fill(rows, ["is_total", "type"], "month", ["quantity"], spine)
    month = F.col("month")
    return filled.select(
        "is_total",
        "type",
        F.year(month).alias("year"),
        F.month(month).alias("month"),
        month_name(month).alias("month_name"),
        "quantity",
    )


def calendar_wide(
    forecast: DataFrame, years: Sequence[int], types: Sequence[str] | None = None
) -> DataFrame:
    """The calendar with one ``yyyy-MM`` column per month of the given years."""
    columns = [f"{y:04d}-{m:02d}" for y in sorted(years) for m in range(1, 13)]
    rows = _with_totals(_monthly(_chosen(forecast, years, types)))
    wide = (
        rows.withColumn("month", F.date_format("month", "yyyy-MM"))
        .groupBy("is_total", "type")
        .pivot("month", columns)
        .agg(F.first("quantity"))
    )
    return wide.na.fill(0.0, columns).drop("is_total")


def month_type_series(
    forecast: DataFrame,
    years: Sequence[int] | None = None,
    types: Sequence[str] | None = None,
) -> DataFrame:
    """Quantity for every month from first to last and every type."""
    chosen = _chosen(forecast, years, types)
    spine = month_spine(chosen, month_start(F.col("wanted_on")))
    return dense_fill(_monthly(chosen), ["type"], "month", ["quantity"], spine)


def _chosen(
    forecast: DataFrame, years: Sequence[int] | None, types: Sequence[str] | None
) -> DataFrame:
    rows = in_list(forecast, "type", types).dropna(subset=["type", "wanted_on"])
    if years is not None:
        spans = [_within_year(int(y)) for y in dict.fromkeys(years)]
        rows = rows.where(reduce(lambda a, b: a | b, spans, F.lit(False)))
    return rows


def _within_year(year: int) -> Column:
    """A date range, which reaches the scan."""
    first, next_ = (F.lit(dt.date(y, 1, 1)).cast("timestamp_ntz") for y in (year, year + 1))
    return (F.col("wanted_on") >= first) & (F.col("wanted_on") < next_)


def _monthly(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type", month_start(F.col("wanted_on")).alias("month")).agg(
        exact_sum(F.col("quantity")).alias("quantity")
    )


def _with_totals(monthly: DataFrame) -> DataFrame:
    """Monthly rows plus one total per month, from the already grouped rows."""
    sets = [["type", "month"], ["month"]]
    return monthly.groupingSets(sets, "type", "month").agg(
        (F.grouping("type") == 1).alias("is_total"),
        exact_sum(F.col("quantity")).alias("quantity"),
    ).withColumn("type", F.when(F.col("is_total"), F.lit(TOTAL)).otherwise(F.col("type")))
