"""Near-duplicate documents by fingerprints that differ in few bits, found with vantage-point trees.

A fingerprint holds the majority, bit by bit, of the hashes of a text's four-word shingles.
Documents with equal fingerprints are one point from then on.

Points are partitioned by Hamming distance. A tree's node holds a vantage point and a middle
distance; by the triangle inequality a point within ``radius`` of a neighbour is at most
``radius`` nearer to the vantage point or farther from it, so it must look at the other side
only if its own distance is that near to the middle. The tree's leaves are shards: a point
lives in one, and visits the others that its radius overlaps. In a shard, a tree over its own
points prunes in the same way.

Over all 64 bits, distances of unlike texts crowd around 32, and a radius of 4 overlaps most
boundaries. Therefore the bits are cut into three thirds with a tree each: fingerprints that
differ in at most 4 bits differ in at most 1 in one of the thirds, so a radius of 1 in each
tree is enough. What meets is compared over all 64 bits.

A task joins what it links, and returns one link a point. Points that are joined already are
not compared again, so a large group of near copies costs little more than its points.

Defined cases: texts of fewer than four words have their word sequence as the only shingle;
null, empty and wordless texts have fingerprint zero, linked like any other; repeated rows
share a point; null ids keep their rows and never name a component, unless it holds no other
(then it is null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import keep, parts_for

U64 = np.uint64
WORDS, SEED, DISTANCE = 4, 42, 4
#: Points that the trees over shards are fitted on, about; the rest are only placed.
SAMPLE = 20_000
#: Points of a shard as aimed at, and at most; visitors that come to it at once.
SHARD, MOST, VISITORS = 8_192, 32_768, 65_536
LEAF = 64
#: Pairs compared at once, and shingles hashed at once.
PAIRS, PIECE = 1 << 20, 1 << 16


def fingerprint(raw: bytes | None) -> int:
    """The fingerprint of a text in UTF-8."""
    import xxhash

    words = (raw or b"").lower().split()  # bytes: lowers A-Z, splits at \x20 and \x09-\x0d
    if not words:
        return 0
    text, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return hashed(text, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - WORDS + 1].tolist()
    ends = ends[WORDS - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), PIECE):
        some = [hashed(text[a:b], SEED) for a, b in zip(starts[k : k + PIECE], ends[k : k + PIECE])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, point): every row's fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            points = np.array([fingerprint(t.as_py()) for t in batch.column("text")], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(points)], ["doc_id", "point"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, point long")


def bands(count: int) -> list[tuple[int, int]]:
    """(shift, mask) of ``count`` stretches of the 64 bits, alike in width."""
    edges = [64 * k // count for k in range(count + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:])]


def _band(points: np.ndarray, band: tuple[int, int]) -> np.ndarray:
    return (points >> U64(band[0])) & U64(band[1])


def _apart(values: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(values ^ other).astype(np.int16)


@dataclass
class Node:
    """An inner node has a vantage point, the middle distance and two sides; a leaf has members and a number."""

    point: np.uint64 = U64(0)
    middle: int = 0
    inside: Node | None = None
    outside: Node | None = None
    members: np.ndarray | None = None
    leaf: int = -1


def build(values: np.ndarray, least: int, radius: int, members: np.ndarray | None = None, depth: int = 0) -> Node:
    """A tree over values; a node takes the vantage point and the middle that the fewest visits cross."""
    members = np.arange(len(values)) if members is None else members
    if len(members) > least:
        rng = np.random.default_rng(len(members) + depth)
        seen = values[members[rng.integers(0, len(members), 256)]]
        best = (0.95, U64(0), 0)  # a split that prunes nothing is none
        for point in seen[:8]:
            d = _apart(seen, point)
            near = np.cumsum(np.bincount(d, minlength=65)) / len(d)  # the share at each distance or nearer
            middle = np.arange(d.min(), d.max())
            if len(middle):
                more, less = near[np.minimum(middle + radius, 64)], np.where(middle < radius, 0.0, near[middle - radius])
                cost = near[middle] * more + (1.0 - near[middle]) * (1.0 - less)
                least_cost = int(np.argmin(cost))
                best = min(best, (float(cost[least_cost]), point, int(middle[least_cost])))
        if best[0] < 0.95:
            near = _apart(values[members], best[1]) <= best[2]
            if near.any() and not near.all():
                sides = (build(values, least, radius, members[x], depth + 1) for x in (near, ~near))
                return Node(best[1], best[2], *sides)
    return Node(members=members)


def number_leaves(node: Node, at: int = 0) -> int:
    if node.inside is None:
        node.leaf = at
        return at + 1
    return number_leaves(node.outside, number_leaves(node.inside, at))


def reached(node: Node, values: np.ndarray, radius: int):
    """(leaf, rows) of each leaf and of the values whose radius reaches it; with radius 0, where they live."""
    todo = [(node, np.arange(len(values)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node.inside is None:
            yield node, rows
            continue
        d = _apart(values[rows], node.point)
        todo += [(node.inside, rows[d - radius <= node.middle]), (node.outside, rows[d + radius > node.middle])]


class Joined:
    """Which points of a task are joined; ``root`` is the least place each is known to reach."""

    def __init__(self, points: np.ndarray):
        self.points, self.root = points, np.arange(len(points))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def neighbours(self) -> None:
        """Join what is alike and side by side, in some orders; it only saves comparisons."""
        for turn in (0, 13, 26, 39, 52):
            turned = (self.points << U64(turn)) | (self.points >> U64(64 - turn)) if turn else self.points
            by = np.argsort(turned)
            for step in (1, 2, 3):
                i, j = by[:-step], by[step:]
                near = _apart(self.points[i], self.points[j]) <= DISTANCE
                self.join(i[near], j[near])

    def compare(self, members: np.ndarray, rows: np.ndarray) -> None:
        """Join the ``rows`` to the ``members`` they are near to, all pairs that are not joined already."""
        step = max(1, PAIRS // max(1, len(members)))
        for k in range(0, len(rows), step):
            own = self.root[members]
            some = rows[k : k + step]
            if (own == own[0]).all():
                some = some[self.root[some] != own[0]]
            near = _apart(self.points[some][:, None], self.points[members][None, :]) <= DISTANCE
            row, col = np.nonzero(near)
            self.join(some[row], members[col])


def links(own: np.ndarray, visitors: np.ndarray, band: tuple[int, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that is within ``DISTANCE`` between the points of a shard and its visitors."""
    points, place = np.unique(np.concatenate([own, visitors]), return_inverse=True)
    joined = Joined(points)
    joined.neighbours()
    home, asked = np.unique(place[: len(own)]), np.unique(place[len(own) :])
    inner, outer = _band(points[home], band), _band(points[asked], band)
    for leaf, rows in reached(build(inner, LEAF, radius), outer, radius):
        joined.compare(home[leaf.members], asked[rows])
    linked = np.flatnonzero(joined.root != np.arange(len(points)))
    return points[linked].view(np.int64), points[joined.root[linked]].view(np.int64)


def edges(points: DataFrame, n: int, count: int = 3, shard: int = SHARD) -> DataFrame:
    """(a, b): links between different points that keep together all that is within ``DISTANCE``."""
    spark = points.sparkSession
    stretches, radius = bands(count), DISTANCE // count
    some = points.where(F.pmod(F.xxhash64("point"), F.lit(parts_for(n, SAMPLE))) == 0).collect()  # about SAMPLE of them
    sample = np.array([r.point for r in some], np.int64).view(U64)
    trees = []
    for band in stretches:
        tree = build(_band(sample, band), max(8, int(shard * len(sample) / max(n, 1))), radius)
        number_leaves(tree)
        trees.append(tree)
    shared = spark.sparkContext.broadcast(trees)

    def placed(frames):
        import pandas as pd

        for frame in frames:
            raw = frame["point"].to_numpy(np.int64)
            for k, (tree, band) in enumerate(zip(shared.value, stretches)):
                values, home = _band(raw.view(U64), band), np.zeros(len(raw), np.int32)
                for leaf, rows in reached(tree, values, 0):
                    home[rows] = leaf.leaf
                for leaf, rows in reached(tree, values, radius):
                    rows = rows[home[rows] <= leaf.leaf]  # of two that may be near, one visits the other
                    yield pd.DataFrame({"tree": k, "leaf": leaf.leaf, "lives": home[rows] == leaf.leaf, "point": raw[rows]})

    stays = keep(points.mapInPandas(placed, "tree int, leaf int, lives boolean, point long"), "shards")
    loads = stays.groupBy("tree", "leaf").agg(
        F.ceil(F.count_if("lives") / MOST).cast("int").alias("salts"), F.ceil(F.count("*") / VISITORS).cast("int").alias("blocks")
    )
    loads = keep(loads.where("salts > 0"), "loads")  # a row a leaf of the trees
    stays = stays.join(F.broadcast(loads), ["tree", "leaf"])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("point"), F.col(c)).cast("int")
    own = stays.where("lives").withColumn("salt", dealt("salts")).withColumn("block", every("blocks"))
    visit = stays.withColumn("block", dealt("blocks")).withColumn("salt", every("salts"))
    keys = ["tree", "leaf", "salt", "block"]
    met = own.withColumn("visits", F.lit(False)).unionByName(visit.withColumn("visits", F.lit(True)))

    def run(key, frame):
        import pandas as pd

        raw, visits = frame["point"].to_numpy(np.int64).view(U64), frame["visits"].to_numpy(bool)
        a, b = links(raw[~visits], raw[visits], stretches[key[0]], radius)
        return pd.DataFrame({"a": a, "b": b})

    return met.select(*keys, "visits", "point").groupBy(*keys).applyInPandas(run, "a long, b long")


def near_copies(docs: DataFrame, count: int = 3, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    ``count`` is the number of stretches, and of trees; ``shard`` the points of a shard, about.
    """
    rows = keep(fingerprints(docs), "fingerprints")
    points = keep(rows.groupBy("point").agg(F.min("doc_id").alias("first")), "points")
    found = components(edges(points.select("point"), points.count(), count, shard))
    rooted = points.join(found.withColumnRenamed("node", "point"), "point", "left")
    rooted = keep(rooted.select("point", "first", F.coalesce("root", "point").alias("root")), "roots")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(named, "root").select("point", "component_id")
    return rows.join(named, "point").select(
        "doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id"
    )
