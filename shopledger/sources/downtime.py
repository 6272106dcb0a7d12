"""The indented downtime report: reason headings with work-centre lines below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.functions import code_part, strip_ws, to_number
from shopledger.operators.ordered import BUCKET_ROWS, forward_fill
from shopledger.sources.cells import cell, without_edges

# Section titles that are neither a reason nor a work centre.
SECTION_TITLES = (
    "PRESS - PRESS",
    "WELDING N2 - WELD N2",
    "PROD N4 - PROD N4",
    "DOWN TIME BY WC",
)

# Fixed value: a reason heading such as "D005 - D005".
REASON_HEADING = r"^D[0-9]{3} - "


def read_downtime(raw: DataFrame) -> DataFrame:
    """Lines ``(file, row_no, txt, hours)`` without title row, header row and footer."""
    return without_edges(raw, top=2, bottom=1).select(
        "file", "row_no", cell(0).alias("txt"), to_number(cell(1)).alias("hours")
    )


def flatten_downtime(lines: DataFrame, *, bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """One row per work-centre line with the reason of the heading above it."""
    text = strip_ws(F.col("txt"))
    heading = F.col("line").rlike(REASON_HEADING)
    skipped = (
        F.col("line").startswith("Total")
        | (F.col("line") == "")
        | F.upper("line").isin(*SECTION_TITLES)
    )
    marked = (
        lines.select("file", "row_no", text.alias("line"), "hours")
        .where(F.col("line").isNotNull() & (heading | ~skipped))
        .select(
            "file",
            "row_no",
            "hours",
            F.when(~heading, code_part(F.col("line"))).alias("wc"),
            F.when(heading, code_part(F.col("line"))).alias("reason_id"),
        )
    )
    filled = forward_fill(marked, "reason_id", bucket_rows=bucket_rows)
    return filled.where(F.col("wc").isNotNull() & F.col("reason_id").isNotNull()).select(
        "file", "row_no", "wc", F.col("hours").alias("downtime_h"), "reason_id"
    )
