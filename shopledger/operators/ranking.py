"""Grouped measures, sorting and top-k with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import exact_mean, exact_sum

_HOW = {"sum": exact_sum, "avg": exact_mean, "distinct": F.count_distinct}


def sorted_by(df: DataFrame, measure: str, *ties: str, descending: bool = False) -> DataFrame:
    """Sort by a measure with nulls last in both directions, then by the tie columns."""
    return df.orderBy(*_order(measure, ties, descending))


def by_key(
    df: DataFrame, key: str, measure: str, how: str, *, descending: bool = False
) -> DataFrame:
    """One measure per key (``sum``, ``avg`` or ``distinct``), sorted by the measure."""
    return sorted_by(_measured(df, key, measure, how), measure, key, descending=descending)


def top_k(
    df: DataFrame, key: str, measure: str, how: str, k: int = 5, *, descending: bool
) -> DataFrame:
    """The first ``k`` keys by a measure."""
    grouped = _measured(df, key, measure, how)
    return grouped.orderBy(*_order(measure, (key,), descending)).limit(k)


def _measured(df: DataFrame, key: str, measure: str, how: str) -> DataFrame:
    rows = df.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(_HOW[how](F.col(measure)).alias(measure))


def _order(measure: str, ties: tuple[str, ...], descending: bool) -> list[Column]:
    c = F.col(measure)
    first = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return [first, *[F.col(t).asc_nulls_last() for t in ties]]
