"""Time spines and zero-filled grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_spine(rows: DataFrame, month: Column) -> Column:
    """Every month from the first to the last one, as a scalar array of dates.

    Reads nothing but the month column of the rows.
    """
    spine = F.sequence(F.min(month), F.max(month), F.expr("INTERVAL 1 MONTH"))
    return rows.agg(spine.alias("spine")).scalar()


def observed(periods: DataFrame, column: str) -> Column:
    """The periods that occur, as a scalar array of dates.

    Its length is bounded by the calendar, not by the number of rows.
    """
    return periods.agg(F.array_sort(F.collect_set(column)).alias("spine")).scalar()


def fill_months(monthly: DataFrame, month: str, measures: Sequence[str]) -> DataFrame:
    """Add the missing months between the first and the last one, with 0.

    ``monthly`` has one row per month, so it is gathered into a single row, bounded by
    the calendar, and unfolded along its own span: one pass, no join.
    """
    entry = F.struct(F.col(month), F.struct(*[F.col(m) for m in measures]))
    whole = monthly.agg(
        F.min(month).alias("_lo"),
        F.max(month).alias("_hi"),
        F.map_from_entries(F.collect_list(entry)).alias("_cells"),
    )
    spine = F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias(month)
    return _looked_up(whole.select("_cells", spine), [], month, measures)


def dense_fill(
    facts: DataFrame, entity: Sequence[str], period: str, measures: Sequence[str], spine: Column
) -> DataFrame:
    """One row per (entity, spine period), with 0 where ``facts`` has none.

    ``facts`` holds at most one row per (entity, period), so an entity gathers no
    more values than there are periods. The grid is unfolded after the last
    shuffle; it is never itself shuffled or joined. A fact without a period only
    announces its entity.
    """
    values = F.struct(*[F.col(m) for m in measures])
    entry = F.when(F.col(period).isNotNull(), F.struct(F.col(period), values))
    per_entity = facts.groupBy(*entity).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_cells")
    )
    grid = per_entity.select(*entity, "_cells", F.explode(spine).alias(period))
    return _looked_up(grid, entity, period, measures)


def _looked_up(
    grid: DataFrame, entity: Sequence[str], period: str, measures: Sequence[str]
) -> DataFrame:
    found = grid.withColumn("_cell", F.try_element_at("_cells", F.col(period)))
    return found.select(
        period,
        *entity,
        *[F.coalesce(F.col("_cell").getField(m), F.lit(0.0)).alias(m) for m in measures],
    )
