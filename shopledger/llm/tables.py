"""Small shared helpers: tables in the shared folder, partition counts, row keys."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import landed

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def keep(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the folder all executors share, and read from there."""
    return landed(df, name)


def as_text(df: DataFrame, column: str) -> DataFrame:
    """The ids as texts, for pandas, which makes doubles of longs that stand beside nulls."""
    return df.withColumn(column, F.col(column).cast("string"))


def exact_ids(texts):
    """The longs of a pandas column that ``as_text`` made, nulls included."""
    import pandas as pd

    return pd.array([None if t is None else int(t) for t in texts], "Int64")


def parts_for(rows: int, each: int) -> int:
    """Partitions, so that none gets more than about ``each`` rows; grows with the input."""
    return max(1, math.ceil(rows / each))


def width(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame) -> DataFrame:
    """``_row``: a unique long for each row, in the order of ``doc_id`` (null first).

    Where ``doc_id`` is unique and without nulls it is ``doc_id`` itself. Else rows are
    sorted by id and text by range over all tasks and numbered in that order, and the
    numbered table is kept, since row numbers must not change between two reads of it.
    """
    odd = (
        docs.groupBy("doc_id").agg(F.count("*").alias("n"))
        .where("n > 1 OR doc_id IS NULL").limit(1).count()
    )
    if not odd:
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    ranged = docs.repartitionByRange(width(docs), "doc_id", F.xxhash64("text"), F.rand(7))
    sorted_rows = ranged.sortWithinPartitions("doc_id", F.xxhash64("text"))
    return keep(sorted_rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def smallest(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key, cut in every map task before the shuffle."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= most).drop("_rank")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, wherever the optimizer puts the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_groups(array: Column) -> Column:
    """The array cut into arrays of 128; an empty one gives one empty array."""
    last = lambda a: F.shiftright(F.greatest(F.size(a) - 1, F.lit(0)), 7)
    return let(array, lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda g: F.slice(a, g * 128 + 1, 128)))


def running(sizes: Column) -> Column:
    """What the entries before each add up to: within groups, and over the sums of groups."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def placed(groups: Column) -> Column:
        bases = F.aggregate(
            F.transform(groups, total),
            none,
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        each = lambda g, base: F.transform(g, lambda _, i: base + total(F.slice(g, F.lit(1), i)))
        return F.flatten(F.zip_with(groups, bases, each))

    return let(in_groups(sizes), placed)


def whole_rows(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let a step on ``doc_id`` and ``text`` that keeps its rows' columns carry all others in one struct.

    The step sees three columns, so a name that it uses itself can't clash with one of them.
    """

    @functools.wraps(step)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        own = [c for c in ("doc_id", "text") if c in docs.columns]
        others = [c for c in docs.columns if c not in own]
        if not others:
            return step(docs, *args, **kwargs)
        carried = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in others]).alias("carried")
        out = step(docs.select(*own, carried), *args, **kwargs)
        return out.select(*[F.col(c) if c in own else F.col("carried").getField(c).alias(c) for c in docs.columns])

    return run
