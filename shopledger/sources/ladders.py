"""Wide item-by-date sheets turned into long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopledger.functions import clean_cell, clean_header, to_number, to_time
from shopledger.functions.cleaning import ISO_FORMATS
from shopledger.operators.ordered import join_per_group
from shopledger.sources.cells import cell, first_rows, overflowing

# The leading columns of the sales ladder.
SALES_LADDER_COLUMNS = ("Item", "LMX", "Cliente", "Unit Price")

# Fixed value: snapshots are numbered files, Archivo_1, Archivo_2, …
SNAPSHOT_PREFIX = "Archivo_"


def load_plan_ladder(
    raw: DataFrame,
    *,
    date_formats: Sequence[str] = ("dd/MM/yyyy",),
    files: Sequence[str] | None = None,
) -> DataFrame:
    """Snapshots ``(item, snapshot, plan_date, qty, row_no)`` of an item-by-date plan.

    Snapshots are numbered by file path, or in the order of ``files``. A file with
    fewer than two columns is left out and keeps its number; ``plan_ladder_rejects``
    lists it.
    """
    snapshots = raw.select("file").distinct().withColumn("snapshot", _snapshot(files))
    usable = first_rows(raw).join(overflowing(raw), "file", "left_anti")
    per_file = usable.join(snapshots, "file").where(
        (_columns() >= 2) & F.col("snapshot").isNotNull()
    ).select(
        "file",
        "snapshot",
        F.col("row_no").alias("header_row"),
        F.transform("cells", lambda h, i: F.when(i > 0, _day(h, date_formats))).alias("days"),
    )
    body = join_per_group(raw, per_file).where("row_no > header_row")
    pairs = F.explode(F.arrays_zip("days", "cells")).alias("e")
    long = body.select(cell(0).alias("item"), "snapshot", "row_no", "days", "cells").select(
        "item", "snapshot", "row_no", pairs
    )
    return long.where(F.col("e.days").isNotNull() & F.col("e.cells").isNotNull()).select(
        "item",
        "snapshot",
        F.col("e.days").alias("plan_date"),
        to_number(F.col("e.cells")).alias("qty"),
        "row_no",
    )


def plan_ladder_rejects(raw: DataFrame) -> DataFrame:
    """``(file, reason)`` of every file that ``load_plan_ladder`` leaves out for its content."""
    few = first_rows(raw).where(_columns() < 2)
    return _rejects(raw, few.select("file", F.lit("fewer than two columns").alias("reason")))


def sales_ladder_rejects(raw: DataFrame) -> DataFrame:
    """``(file, reason)`` of every file that ``load_sales_ladder`` leaves out."""
    lacks = F.array_except(
        F.array(*[F.lit(c) for c in SALES_LADDER_COLUMNS]), F.transform("cells", clean_header)
    )
    reason = F.concat(F.lit("missing columns: "), F.array_join(lacks, ", "))
    return _rejects(raw, first_rows(raw).where(F.size(lacks) > 0).select("file", reason.alias("reason")))


def _columns() -> Column:
    return F.size(F.filter("cells", lambda c: c.isNotNull()))


def _rejects(raw: DataFrame, unfit: DataFrame) -> DataFrame:
    wide = overflowing(raw)
    told = wide.select("file", F.lit("too many columns").alias("reason"))
    return told.unionByName(unfit.join(wide, "file", "left_anti"))


def load_sales_ladder(
    raw: DataFrame, *, date_formats: Sequence[str] = ISO_FORMATS
) -> DataFrame:
    """Amounts ``(item, lmx, customer, unit_price, month, amount)`` of a sales ladder.

    A ladder lists its dates twice, first for units and then for amounts. An amount
    column is the second occurrence of a date, or a date marked with the suffix
    ``.1``. Files without the four leading columns are left out; ``sales_ladder_rejects``
    lists them.
    """
    names = F.transform("cells", clean_header)
    required = F.array(*[F.lit(c) for c in SALES_LADDER_COLUMNS])
    per_file = (
        first_rows(raw)
        .join(overflowing(raw), "file", "left_anti")
        .select("file", F.col("row_no").alias("header_row"), names.alias("names"))
        .where(F.size(F.array_except(required, "names")) == 0)
        .select(
            "file",
            "header_row",
            F.array(
                *[F.array_position("names", c).cast("int") - 1 for c in SALES_LADDER_COLUMNS]
            ).alias("positions"),
            F.transform("names", lambda h, i: _amount_month(h, i, date_formats)).alias("months"),
        )
    )
    body = join_per_group(raw, per_file).where("row_no > header_row")
    fixed = [clean_cell(F.get("cells", F.get("positions", F.lit(i)))) for i in range(4)]
    typed = [
        fixed[0].alias("item"),
        fixed[1].alias("lmx"),
        fixed[2].alias("customer"),
        to_number(fixed[3]).alias("unit_price"),
    ]
    pairs = F.explode(F.arrays_zip("months", "cells")).alias("e")
    kept = ["item", "lmx", "customer", "unit_price"]
    long = body.select(*typed, "months", "cells").select(*kept, pairs)
    return long.where("e.months IS NOT NULL AND e.cells IS NOT NULL").select(
        *kept,
        F.col("e.months").alias("month"),
        to_number(F.col("e.cells")).alias("amount"),
    ).where("amount IS NOT NULL")


def _snapshot(files: Sequence[str] | None) -> Column:
    if files is None:
        number = F.row_number().over(Window.orderBy("file"))
        return F.concat(F.lit(SNAPSHOT_PREFIX), number.cast("string"))
    position = F.array_position(F.array(*[F.lit(f) for f in files]), F.col("file"))
    return F.when(position > 0, F.concat(F.lit(SNAPSHOT_PREFIX), position.cast("string")))


def _amount_month(header: Column, position: Column, date_formats: Sequence[str]) -> Column:
    before = F.filter(F.slice("names", F.lit(1), position), lambda h: h == header)
    marked = header.rlike(r"\.1$")
    day = _day(F.regexp_replace(header, r"\.1$", ""), date_formats)
    return F.when(marked | (F.size(before) == 1), day)


def _day(header: Column, date_formats: Sequence[str]) -> Column:
    return to_time(header, date_formats).cast("date")
