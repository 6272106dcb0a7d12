"""Forecast against sales, and the sales ladder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import exact_sum, month_label, month_start, period_label, period_start
from shopledger.operators import (
    dense_fill,
    distinct_sorted,
    fill_months,
    in_list,
    side_by_side,
    sorted_by,
    top_k,
)
from shopledger.operators.combine import tagged_union

MEASURES = ["forecast", "sold"]


def ladder_by_customer(ladder: DataFrame, customers: Sequence[str] | None = None) -> DataFrame:
    """Ladder amount per customer."""
    rows = in_list(ladder, "customer", customers).where(F.col("customer").isNotNull())
    return rows.groupBy("customer").agg(exact_sum(F.col("amount")).alias("amount"))


def ladder_by_month(ladder: DataFrame, customers: Sequence[str] | None = None) -> DataFrame:
    """Ladder amount for every month from the first to the last one, with a label."""
    rows = in_list(ladder, "customer", customers).where(F.col("month").isNotNull())
    monthly = rows.groupBy(month_start(F.col("month")).alias("month")).agg(
        exact_sum(F.col("amount")).alias("amount")
    )
    filled = fill_months(monthly, "month", ["amount"])
    return filled.withColumn("label", month_label(F.col("month"))).orderBy("month")


def periods(sales: DataFrame, grain: str) -> DataFrame:
    """The sales periods that occur, with their display label."""
    starts = sales.select(period_start(F.col("invoice_date"), grain).alias("period"))
    listed = starts.where("period IS NOT NULL").distinct()
    return listed.withColumn("label", period_label(F.col("period"), grain)).orderBy("period")


def totals(forecast: DataFrame, sales: DataFrame) -> DataFrame:
    """Total forecast and total sold."""
    both = forecast.select(
        F.col("amount").alias("forecast"), F.lit(None).cast("double").alias("sold")
    ).unionByName(
        sales.select(F.lit(None).cast("double").alias("forecast"), F.col("amount").alias("sold"))
    )
    return both.agg(*[exact_sum(F.col(m)).alias(m) for m in MEASURES])


def grid(forecast: DataFrame, sales: DataFrame, grain: str) -> DataFrame:
    """Forecast, sold and difference for every observed period and customer.

    The periods are read from the shuffle that the grid itself is made of. For that, both must
    ask for the same columns and filter nothing before it: whether a customer is named is told
    by the aggregate, and the condition on the periods, which always holds, names the rest.
    """
    tables = {
        "forecast": (_with_period(forecast, "ship_on", grain), "amount"),
        "sold": (_with_period(sales, "invoice_date", grain), "amount"),
    }
    facts = tagged_union(tables, ["period", "customer"]).groupBy("period", "customer").agg(
        *[exact_sum(F.col(m)).alias(m) for m in MEASURES],
        F.bool_or(F.col("customer").isNotNull()).alias("named"),
    )
    asked = F.count_if(F.isnan("forecast") | F.isnan("sold") | F.col("named")) >= 0
    spine = facts.agg(F.when(asked, F.array_sort(F.collect_set("period")))).scalar()
    filled = dense_fill(facts.where("named"), ["customer"], "period", MEASURES, spine)
    return filled.withColumn("difference", F.col("sold") - F.col("forecast"))


def top_customers(
    sales: DataFrame, k: int = 5, period: dt.date | None = None, grain: str = "month"
) -> DataFrame:
    """Customers with the most sales, optionally in one period."""
    return top_k(_sold(sales, period, grain), "customer", "sold", "sum", k, descending=True)


def bottom_customers(
    sales: DataFrame, k: int = 5, period: dt.date | None = None, grain: str = "month"
) -> DataFrame:
    """Customers with the least sales, smallest first."""
    return top_k(_sold(sales, period, grain), "customer", "sold", "sum", k, descending=False)


def by_customer(
    forecast: DataFrame,
    sales: DataFrame,
    period: dt.date | None = None,
    grain: str = "month",
    customers: Sequence[str] | None = None,
) -> DataFrame:
    """Sold and forecast per customer, least sold first.

    Without a period the forecast ends at the last invoice date.
    """
    if period is None:
        last_sale = sales.agg(F.max("invoice_date").alias("last_on")).scalar()
        planned, sold = forecast.where(F.col("ship_on") <= last_sale), sales
    else:
        planned = forecast.where(in_period("ship_on", period, grain))
        sold = sales.where(in_period("invoice_date", period, grain))
    compared = _compared(planned, sold, ["customer"])
    return sorted_by(in_list(compared, "customer", customers, empty="all"), "sold", "customer")


def by_month(forecast: DataFrame, sales: DataFrame) -> DataFrame:
    """Sold and forecast for every month from the first to the last one of either."""
    planned = _with_period(forecast, "ship_on", "month")
    sold = _with_period(sales, "invoice_date", "month")
    monthly = _compared(planned, sold, ["period"])
    return fill_months(monthly, "period", MEASURES).orderBy("period")


def customer_series(
    forecast: DataFrame, sales: DataFrame, customer: str, grain: str
) -> DataFrame:
    """One customer's forecast and sold per period, without empty periods, long form."""
    mine = F.col("customer") == F.lit(customer)
    compared = _compared(
        _with_period(forecast.where(mine), "ship_on", grain),
        _with_period(sales.where(mine), "invoice_date", grain),
        ["period", "customer"],
    )
    busy = compared.where(~((F.col("forecast") == 0) & (F.col("sold") == 0)))
    return busy.unpivot(["period", "customer"], MEASURES, "kind", "amount")


def item_detail(
    forecast: DataFrame, sales: DataFrame, customer: str, period: dt.date, grain: str = "month"
) -> DataFrame:
    """Forecast, sold and difference per item of one customer in one period."""
    mine = F.col("customer") == F.lit(customer)
    compared = _compared(
        forecast.where(mine & in_period("ship_on", period, grain)),
        sales.where(mine & in_period("invoice_date", period, grain)),
        ["item"],
    )
    return compared.withColumn("difference", F.col("sold") - F.col("forecast"))


def item_detail_long(detail: DataFrame) -> DataFrame:
    """Long form of the item detail."""
    return detail.unpivot("item", MEASURES, "kind", "amount")


def customers(forecast: DataFrame, sales: DataFrame) -> DataFrame:
    """Customers of either table, sorted."""
    return distinct_sorted(
        forecast.select("customer").unionByName(sales.select("customer")), "customer"
    )


def in_period(column: str, start: dt.date, grain: str) -> Column:
    """Membership in the period beginning at ``start``, as a range the scan can use."""
    if grain == "week":
        end = start + dt.timedelta(days=7)
    elif grain == "month":
        end = dt.date(start.year + start.month // 12, start.month % 12 + 1, 1)
    else:
        raise ValueError(f"grain must be 'week' or 'month', not {grain!r}")
    c = F.col(column)
    return (c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))


def _compared(
    forecast: DataFrame, sales: DataFrame, keys: list[str], *, keep_null_keys: bool = False
) -> DataFrame:
    tables = {"forecast": (forecast, "amount"), "sold": (sales, "amount")}
    return side_by_side(tables, keys, keep_null_keys=keep_null_keys)


def _with_period(df: DataFrame, column: str, grain: str) -> DataFrame:
    return df.withColumn("period", period_start(F.col(column), grain))


def _sold(sales: DataFrame, period: dt.date | None, grain: str) -> DataFrame:
    rows = sales if period is None else sales.where(in_period("invoice_date", period, grain))
    return rows.select("customer", F.col("amount").alias("sold"))

