"""Whitening against a dense eigenvalue solver and plain integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from shopledger.llm import whitening

from . import odd

SHAPE = "vec_id long, embedding array<double>, id string, x int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SHAPE)


def brute(rows, most=4):
    """(id, component): (n, deviation, size of the whitened value, explained) of each row."""
    fine = [(i, [math.floor(256.0 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(x) for _, x in fine)
    fine = [(i, tuple(x + [0] * (dims - len(x)))) for i, x in fine]
    points = sorted({x for _, x in fine})
    n, total = len(points), [sum(c) for c in zip(*points)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, total)] for x in points])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in fine:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, total))
        at = np.array([float(n * c - s) / n for c, s in zip(x, total)])
        for k in range(min(most, dims)):
            e = values[-1 - k]
            if e > 1e-9 * values[-1]:
                white = abs(at @ vectors[:, -1 - k]) / math.sqrt(e)
                out.setdefault((i, k + 1), []).append((n, deviation if deviation < 2**63 else None, white, e / values.sum()))
    return out


def same(df, rows, **more):
    got = whitening.whiten(df, **more).collect()
    want = brute(rows, **more)
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - white) < 1e-9 * max(1, white) and abs(r.explained - explained) < 1e-12
        assert r.identity_error < 1e-9
    return got


def test_given_vectors(spark):
    df = odd.small(spark, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = same(df, rows)
    assert len(got) == 4 * len(rows)
    white = np.zeros((len(rows), 4))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(np.cov(white.T, bias=True), np.eye(4), atol=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(2**60 + 1, [0.1, 0.2, 0.3]), (2**60 + 1, [0.1, 0.2, 0.3]), (None, [0.4, -0.0, 0.1])]
    rows += [(2, None), (3, [nan, 1.0, 1.0]), (4, [1.0, None, 1.0]), (5, [inf, 1.0, 1.0]), (6, [0.5]), (7, [])]
    rows += [(10 + k, [0.25, 0.5, -0.75]) for k in range(60)] + [(80 + k, [k / 10, -k / 7, (k % 5) / 3]) for k in range(20)]
    df = frame(spark, rows).coalesce(1)
    got = same(df, rows)
    assert {r.vec_id for r in got} == {i for i, _ in rows} - {2, 3, 4, 5}
    assert len({r.whitened for r in got if r.vec_id == 10 and r.component == 1}) == 1


def test_few_points(spark):
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5])]).where("false")).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, [])])).count() == 0
    rows = [(1, [0.5, 0.25]), (2, [1.0, 0.5]), (3, [2.0, 1.0])]  # along one line
    assert {r.component for r in same(frame(spark, rows), rows)} == {1}


def test_large_entries(spark):
    """Far from zero, so that forming products before centring would lose all; deviations beyond a long."""
    rng = np.random.default_rng(2)
    rows = [(k, (1e9 + rng.normal(0, 1.0, 6) * [1e3, 1e2, 10, 1, 1, 1]).tolist()) for k in range(50)]
    same(frame(spark, rows), rows)
    rows = [(k, [(-1) ** k * 1e9 + k, k * 3e6]) for k in range(50)]
    got = same(frame(spark, rows), rows)
    assert all(r.deviation is None for r in got)
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, [(1, [1e300])]))


@pytest.mark.parametrize("d", [1, 2, 7, 64, 65])
def test_factor_and_rotations(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(3 * d, d)) * np.logspace(0, -5, d)
    a = a.T @ a
    l = whitening.cholesky(a)
    assert np.allclose(l @ l.T, a, atol=1e-13 * np.abs(a).max())
    r = whitening.rotated(l)
    values = np.sort((r * r).sum(axis=0))[::-1]
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], rtol=1e-4)
    assert np.allclose(r.T @ r, np.diag((r * r).sum(axis=0)), atol=1e-13 * values[0])
    flat = np.outer(np.arange(1.0, d + 1), np.arange(1.0, d + 1))
    assert whitening.cholesky(flat).shape == (d, 1) and whitening.cholesky(np.zeros((d, d))).shape == (d, 0)
