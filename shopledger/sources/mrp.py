"""The hierarchical material-requirements report: item rows with order lines below."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.functions import clean_cell, strip_ws, to_number, to_time
from shopledger.functions.cleaning import ISO_FORMATS
from shopledger.operators.ordered import BUCKET_ROWS, forward_fill
from shopledger.sources.cells import cell, without_edges

# Fixed value: the text in the second cell that marks an order line.
ORDER_MARK = "Purchase Order"


@dataclass(frozen=True)
class MrpTables:
    po: DataFrame
    no_req: DataFrame


def flatten_mrp(
    raw: DataFrame,
    *,
    header_rows: int = 1,
    date_formats=ISO_FORMATS,
    bucket_rows: int | None = BUCKET_ROWS,
    parts: int | None = None,
) -> MrpTables:
    """Split a report into order lines and items without requirement.

    An item row sets item and type for the order lines below it; the type may be
    empty there and is still carried. A row may be an item and an order line at once.
    ``parts`` is the number of partitions in which rows are filled, if it must grow with them.
    """
    body = without_edges(raw, top=header_rows)
    return MrpTables(
        po=_order_lines(body, date_formats, bucket_rows, parts), no_req=_no_requirement(body)
    )


def _order_lines(body: DataFrame, date_formats, bucket_rows: int | None, parts: int | None) -> DataFrame:
    is_item = strip_ws(cell(0)) != ""
    is_order = F.coalesce(F.contains(cell(1), F.lit(ORDER_MARK)), F.lit(False))
    marked = body.select(
        "file",
        "row_no",
        F.when(is_item, F.struct(cell(0).alias("item"), cell(4).alias("type"))).alias("head"),
        F.when(is_order, F.struct(*[cell(i).alias(f"c{i}") for i in (2, 3, 4, 5)])).alias("line"),
    ).where("head IS NOT NULL OR line IS NOT NULL")
    filled = forward_fill(marked, "head", bucket_rows=bucket_rows, parts=parts).where("line IS NOT NULL")
    return filled.select(
        "file",
        "row_no",
        "head.item",
        "head.type",
        to_time(F.col("line.c2"), date_formats).alias("arrival_date"),
        to_time(F.col("line.c3"), date_formats).alias("ship_date"),
        to_number(F.col("line.c4")).alias("qty"),
        F.col("line.c5").alias("vendor_po_text"),
    )


def _no_requirement(body: DataFrame) -> DataFrame:
    need = F.nullif(clean_cell(cell(9)), F.lit(""))
    is_item = strip_ws(cell(0)) != ""
    return body.where(is_item & (need.isNull() | (to_number(need) == 0))).select(
        "file",
        "row_no",
        cell(0).alias("item"),
        cell(4).alias("type"),
        cell(3).alias("vendor"),
        to_number(cell(6)).alias("on_hand"),
        to_number(cell(11)).alias("demand_total"),
    )
