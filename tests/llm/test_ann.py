"""Nearest neighbours against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from shopledger.llm import ann, queries

from . import odd


def brute(rows, k=5, every=50):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    usual = Counter(len(v) for _, v in rows).most_common(1)[0][0]
    rows = sorted(r for r in rows if len(r[1]) == usual)
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    norms = np.sqrt((m * m).sum(axis=1))
    out = {}
    for q, v, n in zip(ids, m, norms):
        if q % every == 0:
            score = (m * v).sum(axis=1) / (norms * n)
            best = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
            out[int(q)] = [(int(ids[j]), score[j]) for j in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def rows_of(df):
    return [(r.vec_id, r.embedding) for r in df.collect()]


@pytest.mark.parametrize("shard", [4096, 60])
def test_factor_one_is_exact(spark, shard):
    given = odd.small(spark, "embeddings")
    got, want = found(ann.nearest(given, F.col("id") % 50 == 0, shard=shard)), brute(rows_of(given))
    assert got.keys() == want.keys()
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_recall_of_the_query(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = found(ann.nearest(given, F.col("id") % 50 == 0, factor=queries.ANN_FACTOR, shard=200))
    want = brute(rows_of(given))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (None, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0])]
    rows += [(5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (100, [0.5, 0.5])]
    rows += [(k, [1.0, 0.0]) for k in range(200, 240)] + [(k, [1.0, float(k)]) for k in range(8, 14)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got, want = found(ann.nearest(df, F.col("id") % 50 == 0, shard=10)), brute(rows)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert ann.nearest(df.where("vec_id = 0"), F.col("id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("false"), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("shard", [4096, 60])
def test_ties_of_different_vectors(spark, shard):
    """One-hot vectors of several lengths: all that are not along the query tie, and so do all that are."""
    ids = np.random.default_rng(3).permutation(400).tolist()
    rows = [(i, [float(2 ** (k // 40)) if j == k % 40 else 0.0 for j in range(40)]) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (5, 14):
        assert found(ann.nearest(df, F.col("id") % 50 == 0, k=k, shard=shard)) == brute(rows, k)
