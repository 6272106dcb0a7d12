"""Version-to-version plan ladders (item by date, one snapshot per file)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.operators import distinct_sorted


def ladder_cells(long: DataFrame) -> DataFrame:
    """One quantity per item, snapshot and date: the first non-null one in file order."""
    rows = long.dropna(subset=["item", "snapshot", "plan_date", "qty"])
    return rows.groupBy("item", "snapshot", "plan_date").agg(F.min_by("qty", "row_no").alias("qty"))


def ladder_table(long: DataFrame, dates: Sequence[dt.date]) -> DataFrame:
    """Items and snapshots as rows, the given dates as columns, plus an empty release date.

    A column needs to be known before the job starts, so the dates are given; use
    ``ladder_dates`` to list them. Items without a quantity on these dates drop out.
    A cell is reduced to its first quantity before the shuffle, and then put into the slot of
    its date, so a row costs the same whatever the number of dates.
    """
    days = sorted(dates)
    rows = long.dropna(subset=["item", "snapshot", "qty"]).where(F.col("plan_date").isin(days))
    wide = rows.groupBy("item", "snapshot").pivot("plan_date", days).agg(F.min_by("qty", "row_no"))
    return wide.withColumn("release_date", F.lit(""))


def ladder_dates(long: DataFrame) -> DataFrame:
    """The dates of a ladder, sorted."""
    return distinct_sorted(long.where(F.col("qty").isNotNull()), "plan_date")


def item_series(long: DataFrame, item: str) -> DataFrame:
    """One item's quantities by date and snapshot."""
    mine = ladder_cells(long.where(F.col("item") == F.lit(item)))
    return mine.select("snapshot", "plan_date", "qty").orderBy("plan_date", "snapshot")


def ladder_items(long: DataFrame) -> DataFrame:
    """The items of a ladder, sorted."""
    return distinct_sorted(long.where(F.col("qty").isNotNull()), "item")
