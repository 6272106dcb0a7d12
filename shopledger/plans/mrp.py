"""Comparison of a material-requirements run before and after execution."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import NO_PO, as_of_timestamp, po_number, vendor_name, whole_days
from shopledger.operators import (
    ALL,
    date_range,
    equal_to,
    in_list,
    keys_only_in_first,
    option_rows,
    side_by_side,
)
from shopledger.operators.filters import Dates

# Labels of the two runs.
BEFORE, AFTER = "Antes", "Después"


def enrich_po(po: DataFrame) -> DataFrame:
    """Add the order number and the vendor read from the combined text."""
    text = F.col("vendor_po_text")
    return po.withColumn("po_number", po_number(text)).withColumn("vendor", vendor_name(text))


def items_by_type(po: DataFrame, no_req: DataFrame) -> DataFrame:
    """Items per type: those with orders plus those without requirement.

    An item in both tables counts once in each.
    """
    tagged = po.select("type", "item", F.lit("po").alias("source")).unionByName(
        no_req.select("type", "item", F.lit("no_req").alias("source"))
    )
    per_source = (
        tagged.where(F.col("type").isNotNull())
        .groupBy("source", "type")
        .agg(F.count_distinct("item").alias("items"))
    )
    return per_source.groupBy("type").agg(F.sum("items").alias("items"))


def requirement_lost(pre_no_req: DataFrame, post_no_req: DataFrame) -> DataFrame:
    """Items with a requirement before the run but not after it."""
    return keys_only_in_first(post_no_req, pre_no_req, "item").orderBy("item")


def requirement_gained(pre_no_req: DataFrame, post_no_req: DataFrame) -> DataFrame:
    """Items with a requirement after the run but not before it."""
    return keys_only_in_first(pre_no_req, post_no_req, "item").orderBy("item")


def late_lines(po: DataFrame, as_of: dt.date | None = None, over: int = 30) -> DataFrame:
    """Numbered order lines more than ``over`` days late (enriched lines)."""
    before = as_of_timestamp(as_of) - dt.timedelta(days=over)
    late = po.where(F.col("arrival_date") < before)  # reaches the scan, unlike the day count
    late = late.withColumn("days_late", whole_days(as_of_timestamp(as_of), F.col("arrival_date")))
    return late.where((F.col("po_number") != NO_PO) & (F.col("days_late") > over)).select(
        "item", "po_number", "vendor", "arrival_date", "days_late", "qty"
    )


def item_count(lines: DataFrame) -> DataFrame:
    """Distinct items of a listing."""
    return lines.agg(F.count_distinct("item").alias("items"))


def no_req_listing(no_req: DataFrame) -> DataFrame:
    """Items without requirement and their vendor."""
    return no_req.select("item", "vendor")


def no_req_by_vendor(pre_no_req: DataFrame, post_no_req: DataFrame) -> DataFrame:
    """Distinct items without requirement per vendor, before and after."""
    tagged = pre_no_req.select("vendor", "item", F.lit(BEFORE).alias("run")).unionByName(
        post_no_req.select("vendor", "item", F.lit(AFTER).alias("run"))
    )
    grouped = tagged.where(F.col("vendor").isNotNull()).groupBy("run", "vendor")
    return grouped.agg(F.count_distinct("item").alias("items"))


def filter_options(
    pre: DataFrame,
    post: DataFrame,
    type_: str = ALL,
    vendor: str = ALL,
    po: str = ALL,
) -> DataFrame:
    """Choices over both runs as ``(option, value)``: each list depends on those before it."""
    columns = ["type", "vendor", "po_number", "item", "arrival_date"]
    both = pre.select(columns).unionByName(post.select(columns))
    by_type = _chosen("type", type_)
    by_vendor = by_type & _chosen("vendor", vendor)
    by_po = by_vendor & _chosen("po_number", po)
    return option_rows(
        both,
        {
            "type": ("type", F.lit(True)),
            "vendor": ("vendor", by_type),
            "po": ("po_number", by_vendor),
            "item": ("item", by_po),
        },
        ("arrival_date", F.lit(True)),
    )


def select_po(po: DataFrame, type_: str, vendor: str, po_no: str | None = None) -> DataFrame:
    """Order lines of one type and vendor, optionally of one order."""
    if not type_ or type_ == ALL or not vendor or vendor == ALL:
        raise ValueError("choose one type and one vendor")
    return equal_to(po, {"type": type_, "vendor": vendor, "po_number": po_no})


def compare(
    pre: DataFrame,
    post: DataFrame,
    type_: str,
    vendor: str,
    po_no: str | None = None,
    items: Sequence[str] | None = None,
    dates: Dates | None = None,
) -> DataFrame:
    """Quantity per item and arrival date before and after, and the difference."""
    sums = side_by_side(
        {
            "qty_before": (select_po(pre, type_, vendor, po_no), "qty"),
            "qty_after": (select_po(post, type_, vendor, po_no), "qty"),
        },
        ["item", "arrival_date"],
    )
    compared = sums.withColumn("difference", F.col("qty_after") - F.col("qty_before"))
    return date_range(in_list(compared, "item", items), "arrival_date", dates)


def compare_long(compared: DataFrame) -> DataFrame:
    """Long form of a comparison."""
    return compared.unpivot(
        ["item", "arrival_date"], ["qty_before", "qty_after"], "run", "qty"
    )


def compare_items(compared: DataFrame) -> DataFrame:
    """How many items a comparison covers, for callers that draw only so many."""
    return compared.agg(F.countDistinct("item").alias("items"))


def due_within(po: DataFrame, as_of: dt.date | None = None, days: int = 7) -> DataFrame:
    """Lines that arrive between today and ``days`` days from now."""
    today = as_of_timestamp(as_of)
    near = (F.col("arrival_date") >= today) & (
        F.col("arrival_date") < today + dt.timedelta(days=days + 1)
    )
    left = po.where(near).withColumn("days_left", _days_left(as_of))
    return left.where(F.col("days_left").between(0, days)).select(
        "item", "arrival_date", "days_left", "qty"
    )


def overdue_lines(po: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Lines whose arrival date has passed, with the days since then."""
    past = po.where(F.col("arrival_date") < as_of_timestamp(as_of))
    left = past.withColumn("days_left", _days_left(as_of)).where("days_left < 0")
    return left.select("item", "arrival_date", F.abs("days_left").alias("days_late"), "qty")


def alert_counts(po: DataFrame, as_of: dt.date | None = None, days: int = 7) -> DataFrame:
    """How many lines are due soon and how many are overdue."""
    left = _days_left(as_of)
    return po.agg(
        F.count_if(left.between(0, days)).alias("due_soon"), F.count_if(left < 0).alias("overdue")
    )


def _days_left(as_of: dt.date | None) -> Column:
    return whole_days(F.col("arrival_date"), as_of_timestamp(as_of))


def _chosen(column: str, value: str) -> Column:
    if value == ALL:
        return F.lit(True)
    return F.coalesce(F.col(column) == F.lit(value), F.lit(False))
