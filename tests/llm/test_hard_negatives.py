"""Hard negatives against plain Python and SQL."""

from __future__ import annotations

import glob
import math

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from shopledger.llm import hard_negatives, queries

from . import odd

SHAPE = "vec_id long, embedding array<double>, label int, score string, hash int"


def brute(rows, positives=5, negatives=5, every=100):
    """The result for (id, vector, label) rows, which count once each."""
    fine = {
        (i, int(label), tuple(math.floor(256.0 * x) for x in v))
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for anchor in fine:
        if anchor[0] % every:
            continue
        scored = [(-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r) for r in fine if r != anchor]
        scored.sort(key=lambda x: x[:2])
        for p, pid, _ in [x for x in scored if x[2][1] == anchor[1]][:positives]:
            fit = [(s, i) for s, i, r in scored if r[1] != anchor[1] and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(anchor[0], pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 100 == 0, **more).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SHAPE)


def test_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op11_hard_negatives(spark, folder)
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/embeddings.parquet"):
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    want = con.execute(queries.oracle_sql()["op11_hard_negatives"])
    assert got.columns == [c[0] for c in want.description]
    want = sorted(want.fetchall())
    assert len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("cells", [None, 64 * 40])
def test_against_brute_force(spark, monkeypatch, cells):
    """One block, and many blocks of rows and of anchors."""
    if cells:
        monkeypatch.setattr(hard_negatives, "ROW_CELLS", cells)
        monkeypatch.setattr(hard_negatives, "ANCHOR_CELLS", 64 * 2)
    rows = [(r.vec_id, r.embedding, r.label % 3) for r in odd.small(spark, "embeddings").collect()]
    assert mined(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 2), (100, [], 1), (200, [0.25], 2), (300, None, 1)]
    rows += [(400, [1.0, nan], 1), (500, [inf, 1.0], 1), (600, [None, 1.0], 1), (700, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(k, [1.0, 0.5], 1) for k in range(1, 30)] + [(k, [1.0, 0.5], 2) for k in range(30, 60)]
    rows += [(2**60 + k, [0.9, 0.5 + k / 256, 3.0], 3 + k % 2) for k in range(8)] + [(800, [-1.0, -0.0], 3)]
    got = mined(frame(spark, rows))
    assert got == brute(rows) and len(got) > 30
    assert mined(frame(spark, rows), positives=2, negatives=40) == brute(rows, 2, 40)


def test_no_rows(spark):
    assert mined(frame(spark, [(0, [1.0], 1)]).where("false")) == []
    assert mined(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)])) == []
    assert mined(frame(spark, [(100, [1.0], 1), (2, [1.0], 2)])) == []
    assert mined(frame(spark, [(100, [1.0], 1), (2, [1.0], 1)])) == []


def test_wide_and_long_vectors(spark):
    """More dimensions than float32 can sum at once, and scores that need many primes."""
    rng = np.random.default_rng(5)
    wide = [(k, rng.normal(0, 30.0, 3000).tolist(), k % 2) for k in range(0, 300, 10)]
    far = [(k, (rng.normal(0, 1.0, 5) * 1e5).tolist(), k % 2) for k in range(0, 300, 5)]
    assert mined(frame(spark, wide)) == brute(wide)
    assert mined(frame(spark, far)) == brute(far)
    with pytest.raises(ValueError):
        mined(frame(spark, [(0, [1e12], 1)]))


def test_residues_give_back_scores():
    rng = np.random.default_rng(1)
    for size in (1, 100, 10**6, 10**8):
        a, b = (rng.integers(-size, size + 1, (7, 33)) for _ in "ab")
        bound = int(33 * size * size)
        primes = hard_negatives.primes_for(bound)
        got = hard_negatives.scores(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert got.tolist() == [[sum(x * y for x, y in zip(r, s)) for s in b.tolist()] for r in a.tolist()]
    edge = np.array([[2**30]])
    primes = hard_negatives.primes_for(2**60)
    r = hard_negatives.residues(edge, primes)
    assert hard_negatives.scores(r, r, primes).item() == 2**60
    assert hard_negatives.scores(r, hard_negatives.residues(-edge, primes), primes).item() == -(2**60)
