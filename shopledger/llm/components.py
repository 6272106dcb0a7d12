"""Connected components of an edge table, in Spark joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep, parts_for

#: Edges of one part; the parts grow in number with the edges.
EACH = 400_000


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """The edges ``a`` > ``b`` of each part made stars, which leaves at most an edge a node and part."""

    def run(frames):
        import pandas as pd

        up: dict[int, int] = {}

        def top(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pd.DataFrame({"a": nodes, "b": [top(x) for x in nodes]}, dtype="int64")

    return edges.repartition(parts, "a").mapInPandas(run, "a long, b long").where("a > b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges ``a``, ``b``; the root is the least node it reaches.

    Alternates two steps that keep the components and shorten the paths: every node hands its
    larger neighbours to its least one, then its smaller neighbours. Minima are taken in map
    tasks first, so a node with very many neighbours costs a row a task. Each round is
    written, and rounds grow with the logarithm of the longest path.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    distinct = keep(edges.where("a <> b").select("a", "b").distinct(), "edges")
    parts = parts_for(distinct.count(), EACH)
    now = keep(_contracted(distinct, parts).distinct(), "edges")
    before = None
    while parts > 1:  # the stars of a single part are the components
        around = both(now)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = larger.where("a <> b").distinct()
        below = star.groupBy("a").agg(F.min("b").alias("m"))
        smaller = star.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            below.select("a", F.col("m").alias("b"))
        )
        now = keep(smaller.where("a <> b").distinct(), "edges")
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if before == told:
            break
        before = told
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
