"""Operators that bring two tables together.

Comparing two grouped tables is written as one grouped union, not as a full outer
join of two aggregates: values are reduced on the map side, there is one shuffle
instead of three, and a very frequent key never meets a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopledger.functions import exact_sum


def side_by_side(
    tables: Mapping[str, tuple[DataFrame, str]],
    keys: Sequence[str],
    *,
    keep_null_keys: bool = False,
) -> DataFrame:
    """Sum a value of each table per key and put the sums next to each other.

    ``tables`` maps an output column to ``(table, value column)``. A key present in
    only one table gets 0 for the others; rows with a null key are left out unless
    ``keep_null_keys`` is set.
    """
    rows = tagged_union(tables, keys)
    if not keep_null_keys:
        rows = rows.where(_all_present(keys))
    return rows.groupBy(*keys).agg(*[exact_sum(F.col(n)).alias(n) for n in tables])


def tagged_union(tables: Mapping[str, tuple[DataFrame, str]], keys: Sequence[str]) -> DataFrame:
    """The rows of all tables, each with its value in the column of its table and nulls in the others."""
    names = list(tables)
    parts = [
        df.select(
            *keys,
            *[(F.col(value) if n == name else F.lit(None)).cast("double").alias(n) for n in names],
        )
        for name, (df, value) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def keys_only_in_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``first`` that do not occur in ``second``."""
    tagged = first.select(key, F.lit(False).alias("in_second")).unionByName(
        second.select(key, F.lit(True).alias("in_second"))
    )
    grouped = tagged.where(F.col(key).isNotNull()).groupBy(key)
    return grouped.agg(F.bool_or("in_second").alias("in_second")).where("NOT in_second").select(key)


def share_of_total(df: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """Add each measure's share of its column total.

    The totals are one scalar subquery over the already grouped rows. It reads the
    same shuffle as the rows themselves, and no window gathers them in one task.
    """
    totals = df.agg(*[exact_sum(F.col(m)).alias(m) for m in measures])
    total = totals.select(F.struct(*measures)).scalar()
    shares = {
        share: F.try_divide(F.col(m), total.getField(m)) for m, share in measures.items()
    }
    return df.withColumns(shares)


def _all_present(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
