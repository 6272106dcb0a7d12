"""Operators that depend on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from shopledger.session import landed

# Consecutive rows filled in one go; a hot file of 1e12 rows leaves 1.5e7 summaries.
BUCKET_ROWS = 1 << 16

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)

# Consecutive rows that share one copy of their file's header in a join.
JOIN_ROWS = 1 << 12

# Bytes of a table, about, up to which it is handed to every task.
HANDED_OUT = 1 << 26


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in the given order; null keys count as one key.

    Spark cuts each map task's rows to one per key before the shuffle, so a key
    that fills a large part of the table costs one row per map task.
    """
    first = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def forward_fill(
    df: DataFrame,
    column: str,
    *,
    by: Sequence[str] = ("file",),
    order: str = "row_no",
    bucket_rows: int | None = BUCKET_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Replace nulls by the last non-null value before them in the same ``by`` group.

    A plain window puts a whole group in one task. Here a group is cut into buckets
    of consecutive ``order`` numbers, which are unique in a group, and rows are filled inside
    their bucket. What a bucket inherits is carried along one row per bucket, and along one
    row per ``bucket_rows`` buckets, so no window sees more rows than that in a group of
    ``bucket_rows`` cubed. The rows are shuffled once; their last values are taken from the
    same shuffle, into ``parts`` partitions. ``bucket_rows=None`` uses the plain window, for
    many small groups.
    """
    if bucket_rows is None:
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(*_SO_FAR)
        return df.withColumn(column, F.last(column, ignorenulls=True).over(window))

    keys = [*by, "_bucket"]
    dealt = df.withColumn("_bucket", in_block(order, bucket_rows)).repartition(*([parts] if parts else []), *keys)
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(*_SO_FAR)
    filled = dealt.withColumn("_inside", F.last(column, ignorenulls=True).over(inside))
    ends = _last_of_each(dealt, keys, df.columns, column, order)
    inherited = _carried(ends, by, "_bucket", bucket_rows)
    value = F.coalesce("_inside", "_value")
    return filled.join(inherited, keys, "left").withColumn(column, value).select(*df.columns)


def _last_of_each(
    dealt: DataFrame, keys: Sequence[str], columns: Sequence[str], column: str, order: str
) -> DataFrame:
    """``keys`` and ``_value``, the last non-null value, of each bucket.

    ``max_by`` takes whole rows, and the keys come back as values, so that neither columns
    nor filters are pushed into this branch and both branches ask for the same shuffle.
    """
    last = F.max_by(F.struct(*columns), F.when(F.col(column).isNotNull(), F.col(order)))
    named = [F.any_value(k).alias(f"_{i}") for i, k in enumerate(keys)]
    return (
        dealt.groupBy(*keys)
        .agg(last.alias("_last"), *named)
        .select(
            *[F.col(f"_{i}").alias(k) for i, k in enumerate(keys)],
            F.col("_last").getField(column).alias("_value"),
        )
    )


def _carried(ends: DataFrame, by: Sequence[str], order: str, size: int) -> DataFrame:
    """``_value`` made the last one before each bucket: in its area, or else in earlier areas."""
    keys = [*by, "_area"]
    dealt = ends.withColumn("_area", in_block(order, size))
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy(*by).orderBy("_area").rowsBetween(Window.unboundedPreceding, -1)
    areas = dealt.groupBy(*keys).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_far"))
    areas = areas.select(*keys, F.last("_far", ignorenulls=True).over(far).alias("_far"))
    held = dealt.withColumn("_near", F.last("_value", ignorenulls=True).over(near))
    return held.join(areas, keys).select(*by, order, F.coalesce("_near", "_far").alias("_value"))


def number_rows(
    df: DataFrame,
    *,
    by: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str],
    name: str = "row_no",
    parts: int | None = None,
) -> DataFrame:
    """Number the rows of each ``by`` group 1, 2, 3, … along ``chunk`` then ``order``.

    ``chunk`` are leading, non-null sort columns that cut a group into moderate pieces.
    Rows are ranked inside their chunk and shifted by the sizes of the chunks before it,
    so no task sorts a whole group. ``parts`` is the number of partitions, if it must grow
    with the rows.
    """
    keys = [*by, *chunk]
    before = (
        Window.partitionBy(*by).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    shifts = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, shift)
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    dealt = df.repartition(parts, *keys) if parts else df
    return (
        dealt.withColumn("_local", local)
        .join(shifts, keys)
        .select(*df.columns, (F.col("_shift") + F.col("_local")).alias(name))
    )


def join_per_group(
    rows: DataFrame, per_group: DataFrame, *, by: str = "file", order: str = "row_no"
) -> DataFrame:
    """Attach one row per group to all rows of the group without gathering the group.

    The small side is repeated for every block of consecutive rows and the join runs
    on (group, block), so a group that holds most of the table is spread out. It is
    handed down in two steps, to blocks of blocks first, so that no step repeats a
    row more than ``JOIN_ROWS`` times in one task. Groups missing from ``per_group``
    drop out. A small side of at most ``HANDED_OUT`` bytes is handed to every task, and the
    rows stay where they are.
    """
    per_group = landed(per_group, "groups")
    if _bytes(per_group) <= HANDED_OUT:
        return rows.join(F.broadcast(per_group), by)
    blocked = rows.withColumn("_block", in_block(order, JOIN_ROWS))
    blocks = blocked.select(by, "_block").distinct().withColumn("_area", in_block("_block", JOIN_ROWS))
    areas = blocks.select(by, "_area").distinct().join(per_group, by)
    spread = blocks.join(areas, [by, "_area"]).drop("_area")
    return blocked.join(spread, [by, "_block"]).drop("_block")


def handed_out(small: DataFrame, *, stored: bool = False) -> DataFrame:
    """A table for the small side of a join: written once, and handed to every task unless it is too large."""
    table = small if stored else landed(small, "small")
    return F.broadcast(table) if _bytes(table) <= HANDED_OUT else table


def _bytes(table: DataFrame) -> int:
    """About how many bytes the rows of a stored table take."""
    sizes = [F.lit(64)]
    for f in table.schema.fields:
        if isinstance(f.dataType, ArrayType):
            joined = F.coalesce(F.length(F.array_join(F.col(f.name).cast("array<string>"), "")), F.lit(0))
            sizes.append(F.greatest(F.size(f.name), F.lit(0)) * 16 + joined)
        elif f.dataType.simpleString() == "string":
            sizes.append(F.coalesce(F.length(f.name), F.lit(0)))
    return table.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0


def in_block(order: str, size: int) -> Column:
    """The block of ``size`` consecutive numbers that a number is in."""
    return F.expr(f"`{order}` DIV {size}")
