"""Nearest neighbours by cosine, with vantage-point trees per shard.

On unit vectors, cosine falls as distance grows, so the triangle inequality tells how near
anything behind a tree node can be. A top tree, fitted on a bounded sample, cuts space into
regions; every vector goes to its region, and crowded regions are split into shards by hash.
A query is first searched in its own region, which gives it a radius, and then only in the
shards that its radius reaches. In a shard, the same test prunes the shard's own tree. Bounds
are multiplied by a factor before they are compared with the radius: one searches exactly,
more prunes more and may miss some neighbours.

Equal vectors are one point that carries its smallest ids, so copies of one vector, however
many, weigh no more than a few rows.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do null ids, nor vectors of another length than most have; rows that repeat an id
and its vector count once; ties go to the smaller id; fewer candidates than asked for are
all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep, smallest

#: Rows of the sample that the top tree is fitted on.
SAMPLE = 20_000
LEAF = 48
#: Rounding error of a distance between unit vectors.
SLACK = 1e-6
#: More than the rounding error of a cosine; scores that are so near are compared as they are returned.
CLOSE = 1e-10
#: Pairs of a query and a point that are looked at, and whose scores are worked out, at once.
PAIRS, SCORED = 1_000_000, 50_000


@dataclass
class Node:
    """An inner node has a vantage point, the median distance to it, and two sides; a leaf has members."""

    point: np.ndarray | None = None
    middle: float = 0.0
    inside: Node | None = None
    outside: Node | None = None
    members: np.ndarray | None = None
    leaf: int = -1


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _far(u: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (u @ point), 0.0))


def build(u: np.ndarray, least: int, members: np.ndarray | None = None, seed: int = 0) -> Node:
    """A tree over unit vectors; vantage points are spread by a fixed rule."""
    members = np.arange(len(u)) if members is None else members
    if len(members) <= least:
        return Node(members=members)
    # of a few members, the one whose distances to some others spread most
    rng = np.random.default_rng(seed + len(members))
    tried = members[rng.integers(0, len(members), 6)]
    others = u[members[rng.integers(0, len(members), 64)]]
    point = u[tried[int(np.argmax([_far(others, u[t]).std() for t in tried]))]]
    d = _far(u[members], point)
    middle = float(np.median(d))
    near = d <= middle
    if near.all():
        near = d < middle
    if near.all() or not near.any():  # all equally far
        return Node(members=members)
    return Node(point, middle, build(u, least, members[near], seed + 1), build(u, least, members[~near], seed + 2))


def number_leaves(node: Node, at: int = 0) -> int:
    if node.point is None:
        node.leaf = at
        return at + 1
    return number_leaves(node.outside, number_leaves(node.inside, at))


def route(node: Node, u: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    out = np.zeros(len(u), np.int64)
    todo = [(node, np.arange(len(u)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node.point is None:
            out[rows] = node.leaf
            continue
        near = _far(u[rows], node.point) <= node.middle
        todo += [(node.inside, rows[near]), (node.outside, rows[~near])]
    return out


def reached(node: Node, u: np.ndarray, radius: np.ndarray, factor: float):
    """(leaf, rows) of each leaf and the queries whose radius reaches it."""
    todo = [(node, np.arange(len(u)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node.point is None:
            yield node.leaf, rows
            continue
        d = _far(u[rows], node.point)
        r = radius[rows] + SLACK
        todo += [(node.inside, rows[(d - node.middle) * factor <= r]), (node.outside, rows[(node.middle - d) * factor <= r])]


class Search:
    """The best ``wanted`` points of one shard for a block of queries, by score and then by place in the shard."""

    def __init__(self, v: np.ndarray, queries: np.ndarray, radius: np.ndarray, wanted: int, factor: float):
        self.v, self.asked, self.u, self.q = v, queries, _unit(v), _unit(queries)
        self.v_norm, self.q_norm = np.sqrt((v * v).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
        self.given, self.wanted, self.factor = radius, wanted, factor
        self.cos = np.full((len(queries), wanted), -np.inf)
        self.at = np.full((len(queries), wanted), -1, np.int64)
        self.visit(build(self.u, LEAF), np.arange(len(queries)))

    def score(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The scores of pairs, the same whatever else is in the shard."""
        out = np.empty(len(rows))
        for k in range(0, len(rows), SCORED):
            r, p = rows[k : k + SCORED], points[k : k + SCORED]
            out[k : k + SCORED] = (self.asked[r] * self.v[p]).sum(axis=1) / (self.q_norm[r] * self.v_norm[p])
        return out

    def meet(self, members: np.ndarray, rows: np.ndarray) -> None:
        cos = self.q[rows] @ self.u[members].T
        both = np.hstack([self.cos[rows], cos])
        last = -np.partition(-both, self.wanted - 1, axis=1)[:, self.wanted - 1]
        row, col = np.nonzero(cos >= last[:, None] - CLOSE)
        exact = np.full(cos.shape, -np.inf)
        exact[row, col] = self.score(rows[row], members[col])
        both = np.hstack([self.cos[rows], exact])
        at = np.hstack([self.at[rows], np.where(np.isfinite(exact), members, -1)])
        best = np.lexsort((at, -both), axis=1)[:, : self.wanted]
        self.cos[rows] = np.take_along_axis(both, best, 1)
        self.at[rows] = np.take_along_axis(at, best, 1)

    def radius(self, rows: np.ndarray) -> np.ndarray:
        last = self.cos[rows, self.wanted - 1]
        own = np.where(np.isfinite(last), np.sqrt(np.maximum(2.0 - 2.0 * np.where(np.isfinite(last), last, 0), 0.0)), np.inf)
        return np.minimum(own, self.given[rows]) + SLACK

    def visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.point is None:
            step = max(1, PAIRS // len(node.members))
            for k in range(0, len(rows), step):
                self.meet(node.members, rows[k : k + step])
            return
        d = _far(self.q[rows], node.point)
        near = d <= node.middle
        self.visit(node.inside, rows[near])
        self.visit(node.outside, rows[~near])
        gap = np.abs(d - node.middle) * self.factor <= self.radius(rows)
        self.visit(node.outside, rows[near & gap])
        self.visit(node.inside, rows[~near & gap])


def _points(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(vec_col, lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    return rows.where(F.size("v") == (usual.d if usual else 0)).distinct()


def _matrix(column) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


_CAND = "cls long, cand long, ids array<long>, score double, radius double"


def _search(points: DataFrame, queries: DataFrame, wanted: int, factor: float, block: int) -> DataFrame:
    """Candidates of queries (cls, v, radius, leaf, salt) among the points of the same shard."""
    loads = queries.groupBy("leaf", "salt").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = points.join(loads, ["leaf", "salt"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    asked = queries.join(loads, ["leaf", "salt"]).withColumn(
        "block", F.pmod(F.xxhash64("cls"), "blocks").cast("int")
    )

    def run(own, ask):
        import pandas as pd

        if not len(own) or not len(ask):
            return pd.DataFrame(columns=["cls", "cand", "ids", "score", "radius"])
        own = own.sort_values("cls", ignore_index=True)
        v, q = _matrix(own["v"]), _matrix(ask["v"])
        found = Search(v, q, ask["radius"].to_numpy(float), wanted, factor)
        row, col = np.nonzero(found.at >= 0)
        hit = found.at[row, col]
        reach = found.radius(np.arange(len(q)))
        return pd.DataFrame(
            {
                "cls": ask["cls"].to_numpy()[row],
                "cand": own["cls"].to_numpy()[hit],
                "ids": own["ids"].iloc[hit].to_list(),
                "score": found.cos[row, col],
                "radius": reach[row],
            }
        )

    keys = ["leaf", "salt", "block"]
    asked = asked.select(*[F.col(c).alias(c) for c in ("cls", "v", "radius", *keys)])  # columns of its own
    return dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, _CAND)


def nearest(
    df: DataFrame, is_query, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding",
    shard: int = 4096, block: int = 20_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each row for which ``is_query`` holds.

    ``is_query`` is a condition on ``id``. ``shard`` bounds the points, and ``block`` the
    queries, that meet in one task.
    """
    points = _points(df, id_col, vec_col)
    wanted = k + 1  # a query finds itself
    first = smallest(points, ["v"], ["id"], wanted)
    reps = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    reps = keep(reps.select(F.get("ids", F.lit(0)).alias("cls"), "ids", "v"), "points")
    asked = points.where(is_query).join(reps.select("cls", "v"), "v").select(F.col("id").alias("query_id"), "cls")
    asked = keep(asked, "asked")
    n = reps.count()
    sample = reps.orderBy(F.xxhash64("cls")).limit(SAMPLE).select("v").toPandas()
    if not len(sample):
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    u = _unit(_matrix(sample["v"]))
    top = build(u, max(8, int(len(u) * shard / max(n, 1))))
    number_leaves(top)
    tree = df.sparkSession.sparkContext.broadcast(top)

    def place(frames):
        for frame in frames:
            if len(frame):
                frame["leaf"] = route(tree.value, _unit(_matrix(frame["v"])))
                yield frame

    routed = reps.mapInPandas(place, "cls long, ids array<long>, v array<double>, leaf long")
    loads = routed.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * shard)).cast("int").alias("salts"))
    loads = keep(loads, "loads")  # a row a leaf of the top tree
    routed = routed.join(F.broadcast(loads), "leaf").withColumn("salt", F.pmod(F.xxhash64("cls"), "salts").cast("int"))
    routed = keep(routed, "routed")
    queries = routed.join(asked.select("cls").distinct(), "cls", "left_semi")
    home = keep(
        _search(routed, queries.withColumn("radius", F.lit(float("inf"))), wanted, factor, block), "home"
    )
    reach = home.groupBy("cls").agg(F.min("radius").alias("radius"))
    def spread(frames):
        for frame in frames:
            if not len(frame):
                continue
            v = _unit(_matrix(frame["v"]))
            for leaf, rows in reached(tree.value, v, frame["radius"].to_numpy(float), factor):
                part = frame.iloc[rows]
                yield part.assign(leaf=leaf)

    far = queries.withColumnsRenamed({"leaf": "home", "salt": "own"}).join(reach, "cls").select("cls", "v", "radius", "home", "own")
    wide = far.mapInPandas(spread, "cls long, v array<double>, radius double, home long, own int, leaf long")
    wide = wide.join(F.broadcast(loads), "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    wide = wide.where("NOT (leaf = home AND salt = own)").select("cls", "v", "radius", "leaf", "salt")
    found = home.unionByName(_search(routed, wide, wanted, factor, block)).withColumn("worse", -F.col("score"))
    found = smallest(found, ["cls"], ["worse", "cand"], 2 * wanted).select("cls", "ids", "score")
    each = asked.join(found, "cls").select("query_id", F.explode("ids").alias("vec_id"), "score")
    each = each.where("vec_id <> query_id").withColumn("worse", -F.col("score"))
    ranked = each.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY worse, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
