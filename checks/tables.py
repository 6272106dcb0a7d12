"""Spark side of the views: report tables and raw report sheets of a data folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from shopledger.functions import exact_sum, month_start
from shopledger.operators import number_rows
from shopledger.session import landed

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ORDER_BLOCK = 1 << 20
ITEMS_PER_FILE = 1000
ROWS_PER_TASK = 500_000

# Months covered by the driver tables.
MONTHS = [dt.date(y, m, 1) for y in range(1995, 2002) for m in range(1, 13)]


# Sheets already landed: (application, folder, sheet) -> table.
_LANDED: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    """Report tables derived from one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def sql(self, text: str) -> DataFrame:
        used = {t: df for t, df in self.base.items() if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def view(self, view: views.View, *columns: str) -> DataFrame:
        return self.sql(view.sql(columns or [*view.columns, *view.extra]))

    def timecards(self, *columns: str, ordered: bool = False) -> DataFrame:
        extra = tuple(views.LINE_ORDER) if ordered else ()
        return self.view(views.TIMECARDS, *columns, *extra)

    def po(self, run: str, *columns: str) -> DataFrame:
        return self.view(views.MRP_PO[run], *columns)

    def no_req(self, run: str) -> DataFrame:
        return self.sql(views.no_req_sql(run))

    def parts(self, table: str, each: int = ROWS_PER_TASK) -> int:
        """Partitions for what is derived from a table; they grow with it, so that no task does."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(least, -(-self.base[table].count() // each))

    def landed(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A raw sheet, written on first use and read from there by every loader."""
        return landed_once(self, name, lambda: landed(build(), name))

    def downtime_lines(self) -> DataFrame:
        """The indented downtime report: one file per shift, one heading per reason."""
        order = list(views.LINE_ORDER)
        cards = self.view(
            views.TIMECARDS,
            "wc", "wc_type", "shift", "reason_id", "prod_downtime_h", "timesheet_no", *order,
        ).withColumn("file", F.concat(F.lit("downtime_"), F.col("shift")))
        sheet = F.col("timesheet_no").cast("bigint")
        details = cards.select(
            "file",
            "reason_id",
            F.lit(1).alias("kind"),
            F.floor(sheet / F.lit(ORDER_BLOCK)).alias("block"),
            sheet.alias("sheet"),
            *order,
            F.concat_ws(" - ", "wc", "wc_type").alias("txt"),
            F.col("prod_downtime_h").alias("hours"),
        )
        groups = cards.groupBy("file", "reason_id").agg(
            exact_sum(F.col("prod_downtime_h")).alias("hours")
        )
        around = groups.select(
            "file",
            "reason_id",
            "hours",
            F.explode(F.array(F.lit(0), F.lit(2))).alias("kind"),
        ).select(
            "file",
            "reason_id",
            "kind",
            F.lit(0).cast("bigint").alias("block"),
            F.when(F.col("kind") == 0, F.concat_ws(" - ", "reason_id", "reason_id"))
            .otherwise(F.concat(F.lit("Total "), F.col("reason_id")))
            .alias("txt"),
            F.when(F.col("kind") == 2, F.col("hours")).alias("hours"),
        )
        lines = details.unionByName(around, allowMissingColumns=True)
        return number_rows(
            lines, by=["file"], chunk=["reason_id", "kind", "block"], order=["sheet", *order],
            parts=self.parts("lineitem"),
        ).select("file", "row_no", "txt", "hours")

    def mrp_cells(self, run: str) -> DataFrame:
        """The hierarchical requirements report: one file per thousand items."""
        heads = self.sql(views.items_sql(run)).withColumns(
            {"kind": F.lit(0), "block": F.lit(0).cast("bigint")}
        )
        lines = self.po(
            run,
            "arrival_date", "ship_date", "qty", "vendor_po_text",
            "part_key", "order_key", "line_1", "line_2",
        )
        details = lines.withColumns(
            {"kind": F.lit(1), "block": F.floor(F.col("order_key") / F.lit(ORDER_BLOCK))}
        )
        group = F.floor(F.col("part_key") / F.lit(ITEMS_PER_FILE)).cast("string")
        rows = details.unionByName(heads, allowMissingColumns=True).withColumn(
            "file", F.concat(F.lit(f"{run}_"), group)
        )
        numbered = number_rows(
            rows,
            by=["file"],
            chunk=["part_key", "kind", "block"],
            order=["order_key", "line_1", "line_2"],
            parts=self.parts("lineitem"),
        )
        head = _cells(
            {
                0: F.col("item"),
                3: F.col("vendor"),
                4: F.col("type"),
                6: F.col("on_hand").cast("string"),
                9: F.col("requirement"),
                11: F.col("demand_total").cast("string"),
            }
        )
        detail = _cells(
            {
                1: F.concat(F.lit("Purchase Order "), F.col("order_key").cast("string")),
                2: F.date_format("arrival_date", "yyyy-MM-dd"),
                3: F.date_format("ship_date", "yyyy-MM-dd"),
                4: F.col("qty").cast("bigint").cast("string"),
                5: F.col("vendor_po_text"),
            }
        )
        return numbered.select("file", "row_no", F.when(F.col("kind") == 0, head).otherwise(detail).alias("cells"))

    def sales_ladder_cells(self) -> DataFrame:
        """The sales ladder sheet: one amount column per month."""
        lines = self.view(views.SALES_LADDER)
        keys = ["part_key", "item", "lmx", "customer", "unit_price"]
        wide = _by_month(lines, keys, "line_amount", MONTHS, self.parts("lineitem"))
        header = ["Item", "LMX", "Cliente", "Unit Price"]
        header += [f"{m.isoformat()} 00:00:00.1" for m in MONTHS]
        fixed = [F.col(k) for k in ("item", "lmx", "customer")]
        cells = [*fixed, F.col("unit_price").cast("string"), *_month_cells(MONTHS)]
        rows = wide.select(
            F.lit("ladder").alias("file"),
            (F.col("part_key") + 1).alias("row_no"),
            F.array(*cells).alias("cells"),
        )
        return rows.unionByName(self._header("ladder", header))

    def plan_ladder_cells(self) -> DataFrame:
        """Three plan snapshots: one quantity column per month."""
        lines = self.view(views.PLAN_LADDER).withColumn(
            "file", F.concat(F.lit("plan_"), F.col("snapshot_no").cast("string"))
        )
        wide = _by_month(lines, ["file", "part_key", "item"], "line_qty", MONTHS, self.parts("lineitem"))
        rows = wide.select(
            "file",
            (F.col("part_key") + 1).alias("row_no"),
            F.array("item", *_month_cells(MONTHS)).alias("cells"),
        )
        header = ["Item", *[m.strftime("%d/%m/%Y") for m in MONTHS]]
        heads = [self._header(f"plan_{i}", header) for i in (1, 2, 3)]
        return rows.unionByName(heads[0].unionByName(heads[1]).unionByName(heads[2]))

    def plan_ladder(self, parts: int | None = None) -> DataFrame:
        """The plan ladder in long form; with ``parts``, lines meet by item, for all that is grouped by it."""
        lines = self.view(views.PLAN_LADDER)
        lines = lines.repartition(parts, "item") if parts else lines
        return (
            lines.groupBy(
                "item",
                F.concat(F.lit("Archivo_"), F.col("snapshot_no").cast("string")).alias("snapshot"),
                month_start(F.col("on_date")).alias("plan_date"),
            )
            .agg(exact_sum(F.col("line_qty")).alias("qty"))
            .withColumn("row_no", F.lit(1).cast("bigint"))
        )

    def sales_ladder(self) -> DataFrame:
        """The sales ladder in long form."""
        return self.view(views.SALES_LADDER).groupBy(
            "item", "lmx", "customer", "unit_price", month_start(F.col("on_date")).alias("month")
        ).agg(exact_sum(F.col("line_amount")).alias("amount"))

    def _header(self, file: str, cells: Sequence[str]) -> DataFrame:
        return self.spark.range(1).select(
            F.lit(file).alias("file"),
            F.lit(0).cast("bigint").alias("row_no"),
            F.array(*[F.lit(c) for c in cells]).alias("cells"),
        )


def landed_once(t: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` writes on first use, for this application and folder."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _LANDED:
        _LANDED[key] = build()
    return _LANDED[key]


def _cells(filled: dict):
    empty = F.lit(None).cast("string")
    return F.array(*[filled.get(i, empty) for i in range(12)]).alias("cells")


def _by_month(lines: DataFrame, keys: list[str], measure: str, months: list, parts: int) -> DataFrame:
    """A row for each key with a column a month; lines meet by part once, for both groupings."""
    month = month_start(F.col("on_date")).alias("month")
    return (
        lines.repartition(parts, "part_key")
        .groupBy(*keys, month)
        .agg(exact_sum(F.col(measure)).alias("v"))
        .groupBy(*keys)
        .pivot("month", months)
        .agg(F.first("v"))
    )


def _month_cells(months: list) -> list:
    return [F.col(f"`{m.isoformat()}`").cast("string") for m in months]
