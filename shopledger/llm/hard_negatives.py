"""Hard negatives by exact integer scores, multiplied in residue numbers.

Vectors become integers. For each of several small primes, the matrices of the residues are
multiplied in float32: centred residues are so small that sums of a thousand products stay
below 2**24, where float32 is exact. The residues of a product give back the signed score by
Chinese remaindering, in mixed radix with centred digits. As many primes are taken as the
longest vector asks for, since no score exceeds the square of its length.

Anchors and rows are dealt in blocks by hash, and each pair of an anchor block and a row
block meets in one task, which returns the first few rows of each anchor; windows over these
select. The first pass finds the positives of each anchor. The second multiplies again, and
selects for each positive among the rows whose score lies in its band, so that nothing needs
to be kept of the scores between the two.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component,
take no part; a shorter vector counts as filled up with zeros, an empty one scores zero; rows
that repeat an id, its label and its vector count once; rows that share an id but not the
rest are rows of their own; ties go to the smaller id; anchors without positives, and
positives without negatives, give no rows, nor does an empty table; other columns are
ignored. Vectors so long that a score might pass 2**59 are refused with an error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep, parts_for, width

#: The largest primes below 2**8.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
#: Cells of a block of rows and of a block of anchors, and rows that are worth a task.
ROW_CELLS, ANCHOR_CELLS, LEAST_ROWS = 1 << 21, 1 << 19, 2_048
#: Scores worked out at once.
TILE = 1 << 20
LEAST = np.iinfo(np.int64).min
_NAME = ["hash", "id", "label"]


def primes_for(bound: int) -> tuple[int, ...]:
    """The fewest primes that tell all integers from -bound to bound apart."""
    for k in range(1, len(PRIMES) + 1):
        if math.prod(PRIMES[:k]) > 2 * bound:
            return PRIMES[:k]
    raise ValueError(f"scores up to {bound} are beyond the residues")


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """The remainders in -(p//2)..p//2 of integers held as doubles."""
    return x - p * np.rint(x * (1.0 / p))


def residues(v: np.ndarray, primes) -> list[np.ndarray]:
    """For each prime, the centred residues of the integers ``v`` in float32."""
    return [((v + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Inner products modulo ``p``, centred, of rows of centred residues."""
    step = (1 << 24) // (p // 2) ** 2  # so many products are summed without rounding
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], step):
        out = _centred(out + a[:, k : k + step] @ b[:, k : k + step].T, p)
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes) -> np.ndarray:
    """The exact integer inner products of vectors given by their residues."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        rest = _product(a[k], b[k], p)
        for digit, q in zip(digits, primes):
            rest = _centred((rest - digit) * pow(q, -1, p), p)
        digits.append(rest)
    total = digits[-1].astype(np.int64)
    for digit, q in zip(digits[-2::-1], primes[len(digits) - 2 :: -1]):
        total = total * q + digit.astype(np.int64)
    return total


def _placed(row: np.ndarray) -> np.ndarray:
    """The place of each entry among those with the same value of the sorted ``row``."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def _in_order(score: np.ndarray, row: np.ndarray, col: np.ndarray):
    by = np.lexsort((col, -score[row, col], row))
    return row[by], col[by]


def first_of(score: np.ndarray, fit: np.ndarray, most: int):
    """(row, column) of the first ``most`` fitting columns of each row, by falling score, then by column."""
    s = np.where(fit, score, LEAST)
    if most < s.shape[1]:
        last = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
        fit = fit & (s >= last[:, None])
    row, col = _in_order(score, *np.nonzero(fit))
    few = _placed(row) < most
    return row[few], col[few]


def _vectors(df: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(hash, id, label, v) of the rows that take part."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )
    return rows.select(F.xxhash64("id", "label", "v").alias("hash"), "id", "label", "v")


def _matrix(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _met(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], dims: int, primes, choose, names, shape: str) -> DataFrame:
    """What ``choose`` selects from the scores of every pair of an anchor block and a row block.

    ``choose`` gets a tile of scores, the anchors and the rows of that tile, both as frames,
    and returns arrays: the anchor's place and the further columns ``names``.
    """
    most, asked = blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.withColumn("part", F.pmod("hash", F.lit(most)).cast("int")).withColumn("block", every(asked))
    ask = anchors.withColumn("block", F.pmod("hash", F.lit(asked)).cast("int")).withColumn("part", every(most))

    def run(own, ask):
        import pandas as pd

        columns = [*_NAME, *names]
        if not len(own) or not len(ask):
            return pd.DataFrame(columns=columns)
        own = own.sort_values(_NAME[1:] + _NAME[:1], ignore_index=True)
        own = own[~own[_NAME].duplicated()].reset_index(drop=True)
        ask = ask.reset_index(drop=True)
        b = residues(_matrix(own["v"], dims), primes)
        out, step = [], max(1, TILE // len(own))
        for k in range(0, len(ask), step):
            tile = ask.iloc[k : k + step].reset_index(drop=True)
            a = residues(_matrix(tile["v"], dims), primes)
            at, *found = choose(scores(a, b, primes), tile, own)
            out.append(pd.DataFrame({n: tile[n].to_numpy()[at] for n in _NAME} | dict(zip(names, found))))
        return pd.concat(out, ignore_index=True)[columns]

    keys = ["part", "block"]
    return own.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(run, f"hash long, id long, label long, {shape}")


def _firsts(found: DataFrame, keys: list[str], score: str, name: str, most: int) -> DataFrame:
    """``rank`` of the first rows of each key by falling score and then by id, up to ``most``."""
    by = Window.partitionBy(*keys).orderBy(F.col("worse"), F.col(name))
    ranked = found.withColumn("worse", -F.col(score)).withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= most).drop("worse")


def mine(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100),
    scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``. A component becomes ``floor(scale * x)``; a score is
    the inner product of two such vectors. The positives of an anchor are its best other rows of
    its label; the negatives of a positive are the best rows of other labels that score no more
    than it, and at least the share ``least`` of it.
    """
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = _vectors(df, scale, id_col, vec_col, label_col)
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    told = rows.agg(F.count("*").alias("n"), F.max(squares).alias("far"), F.max(F.size("v")).alias("dims")).head()
    if not told.n:
        return df.sparkSession.createDataFrame([], shape)
    part, whole = (x // math.gcd(*least) for x in least)
    bound = int(told.far * (1 + 1e-9)) + 1
    if bound * max(part, whole) >= 1 << 62:
        raise ValueError(f"scores up to {bound} are too large to be compared")
    primes, dims = primes_for(bound), max(1, told.dims)
    anchors = keep(rows.where(is_anchor).distinct(), "anchors")
    n_anchors = anchors.count()
    tasks = min(width(df), parts_for(told.n, LEAST_ROWS))
    blocks = max(tasks, parts_for(told.n * dims, ROW_CELLS)), parts_for(n_anchors * dims, ANCHOR_CELLS)

    def nearest(score, tile, own):
        same = tile["label"].to_numpy()[:, None] == own["label"].to_numpy()[None, :]
        itself = (tile["hash"].to_numpy()[:, None] == own["hash"].to_numpy()[None, :]) & (
            tile["id"].to_numpy()[:, None] == own["id"].to_numpy()[None, :]
        )
        row, col = first_of(score, same & ~itself, positives)
        return row, own["id"].to_numpy()[col], score[row, col]

    found = _met(rows, anchors, blocks, dims, primes, nearest, ["other", "score"], "other long, score long")
    ranked = _firsts(found, _NAME, "score", "other", positives)
    wanted = ranked.groupBy(*_NAME).agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("wanted"))
    wanted = wanted.select(
        *_NAME, F.transform("wanted", lambda w: w["other"]).alias("positive"),
        F.transform("wanted", lambda w: w["score"]).alias("positive_score"),
    )
    asked = keep(anchors.join(wanted, _NAME), "positives")

    def below(score, tile, own):
        ids, top = tile["positive"].tolist(), tile["positive_score"].tolist()
        n = np.array([len(x) for x in top])
        limit = np.full((len(tile), n.max()), LEAST)
        name = np.zeros(limit.shape, np.int64)
        for k in range(len(tile)):
            limit[k, : n[k]], name[k, : n[k]] = top[k], ids[k]
        high, low = limit.max(axis=1), np.array([min(x) for x in top])
        other = tile["label"].to_numpy()[:, None] != own["label"].to_numpy()[None, :]
        row, col = _in_order(score, *np.nonzero(other & (score <= high[:, None]) & (whole * score >= part * low[:, None])))
        s, out = score[row, col], []
        for j in range(limit.shape[1]):
            p = limit[row, j]
            fit = (j < n[row]) & (s <= p)
            fit[fit] = whole * s[fit] >= part * p[fit]
            r, c = row[fit], col[fit]
            few = _placed(r) < negatives
            r, c = r[few], c[few]
            out.append((r, np.full(len(r), j, np.int32), name[r, j], limit[r, j], own["id"].to_numpy()[c], score[r, c]))
        return [np.concatenate(x) for x in zip(*out)]

    names = ["place", "positive_id", "positive_score", "negative_id", "negative_score"]
    kinds = "place int, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _met(rows, asked, blocks, dims, primes, below, names, kinds)
    ranked = _firsts(found, [*_NAME, "place"], "negative_score", "negative_id", negatives)
    return ranked.select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int"), "negative_id",
        "positive_score", "negative_score",
    )
