"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Components become integers, and each different integer vector is one point of the fit. Tasks
sum the points exactly, then, with the mean known, the products of their centred entries; a
matrix of dimensions times dimensions is all that leaves a task. Its pivoted Cholesky factor
is rotated from the right until its columns are orthogonal: the squares of their norms are
the eigenvalues, and the columns at length one are the components. Working on the factor
keeps small eigenvalues as exact as large ones, which forming the products again would not.

Defined cases: rows whose vector is null or holds a null or non-finite entry take no part; a
shorter vector counts as filled up with zeros; repeated rows each come back, but are one
point; null and repeated ids are kept as they are; equal eigenvalues share any base of their
space; components whose eigenvalue is zero, but for rounding, are left out, so a table of one
point or none gives no rows; ``deviation`` is null where it is beyond a long; other columns
are ignored. Entries beyond 2**52 once scaled are refused with an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep

EPS = float(np.finfo(float).eps)
#: Tasks whose matrices are summed in one.
MERGED = 16
SHAPE = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def cholesky(a: np.ndarray) -> np.ndarray:
    """``l`` with ``a = l @ l.T``, the largest rest of the diagonal first, up to the rank of ``a``.

    With rows in the order of the pivots, ``l`` is lower triangular.
    """
    rest, columns = a.astype(float).copy(), []
    floor = len(a) * EPS * max(float(a.diagonal().max(initial=0.0)), 0.0)
    while len(columns) < len(a):
        k = int(np.argmax(rest.diagonal()))
        if rest[k, k] <= floor:
            break
        column = rest[:, k] / np.sqrt(rest[k, k])
        rest -= np.outer(column, column)
        rest[k, :] = rest[:, k] = 0.0  # what rounding leaves of a row that is done
        columns.append(column)
    return np.array(columns).T.reshape(len(a), len(columns))


def _pairings(n: int):
    """Rounds of disjoint pairs, in which every two of ``n`` places meet once."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        pairs = [(min(x), max(x)) for x in zip(ring[: len(ring) // 2], ring[::-1]) if max(x) < n]
        yield np.array(pairs, int).reshape(-1, 2).T
        ring = [ring[0], ring[-1], *ring[1:-1]]


def rotated(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``l`` with its columns rotated among each other until all are orthogonal."""
    l = l.copy()
    for _ in range(sweeps):
        worst = 0.0
        for p, q in _pairings(l.shape[1]):
            a, b = l[:, p], l[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            off = np.abs(ab) / np.maximum(np.sqrt(aa * bb), np.finfo(float).tiny)
            worst = max(worst, float(off.max(initial=0.0)))
            zeta = (bb - aa) / np.where(ab == 0, 1.0, 2.0 * ab)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(off <= EPS, 0.0, t)
            c = 1.0 / np.hypot(1.0, t)
            l[:, p], l[:, q] = c * a - c * t * b, c * t * a + c * b
        if worst <= 4 * EPS:
            break
    return l


@dataclass
class Model:
    """The fit: ``n`` points with sums ``total``, unit ``components`` by row, their ``values`` and the ``trace``."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.total) @ self.components.T / np.sqrt(self.values)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``x - total / n`` with the whole part of the mean taken off as an integer."""
    whole, rest = np.array([s // n for s in total], np.int64), np.array([s % n / n for s in total])
    return (x - whole) - rest


def spectrum(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit components by row and their eigenvalues, the largest first, and the trace, of ``scatter / n``."""
    l = rotated(cholesky(scatter / n))
    values = (l * l).sum(axis=0)
    by = np.argsort(-values, kind="stable")
    by = by[values[by] > len(l) * EPS * values.max(initial=0.0)]
    parts = (l[:, by] / np.sqrt(values[by])).T
    for k, part in enumerate(parts):  # one sign of the two
        parts[k] = part * np.sign(part[np.argmax(np.abs(part))])
    return parts, values[by], float(scatter.trace()) / n


def _points(df: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows that take part."""
    fine = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(vec_col, lambda c: F.floor(c.cast("double") * scale))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _matrix(column, dims: int) -> np.ndarray:
    """The vectors of an Arrow column of lists, filled up with zeros."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(ends)
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _summed(points: DataFrame, dims: int, side: int, products) -> np.ndarray:
    """The sum over all points of the matrices of ``side`` columns that ``products`` makes of a batch.

    Each task adds up its own points, then tasks add up the matrices of some others, so that
    the driver gets a number of matrices that does not grow with the input.
    """
    import pyarrow as pa

    def told(total):
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    def make(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                got = products(_matrix(batch.column("x"), dims))
                total = got if total is None else total + got
        yield from told(total)

    def add(batches):
        total = None
        for batch in batches:
            for m in batch.column("m").to_pylist():
                got = np.frombuffer(m, float)
                total = got if total is None else total + got
        yield from told(total)

    parts = points.mapInArrow(make, "m binary")
    summed = parts.repartition(MERGED).mapInArrow(add, "m binary").collect()
    return np.sum([np.frombuffer(r.m, float) for r in summed], axis=0).reshape(-1, side)


def _totals(points: DataFrame, dims: int) -> list[int]:
    """The exact sums of each dimension."""
    import pyarrow as pa

    def make(batches):
        total = [0] * dims
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            for k in range(0, len(x), 1 << 10):  # below 2**62, as entries are below 2**52
                total = [a + b for a, b in zip(total, x[k : k + (1 << 10)].sum(axis=0).tolist())]
        rows = {"dim": pa.array(range(dims), pa.int32()), "total": pa.array([str(t) for t in total], pa.string())}
        yield pa.RecordBatch.from_pydict(rows)

    sums = points.mapInArrow(make, "dim int, total string").groupBy("dim")
    rows = sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row a dimension
    return [int(r.total) for r in sorted(rows, key=lambda r: r.dim)]


def fit(points: DataFrame, dims: int) -> Model | None:
    """The model of different points ``x``; none if there are none."""
    n = points.count()
    if not n:
        return None
    total = _totals(points, dims)

    def products(x):
        c = centred(x, n, total)
        return (c.T @ c).ravel()

    return Model(n, total, *spectrum(_summed(points, dims, dims, products), n))


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum over dimensions of (n*x - total)**2, exact; none where a long can't hold it."""
    far = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if far * far * max(1, x.shape[1]) < 1 << 63:
        d = n * x - np.array(total, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(total, object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def whiten(
    df: DataFrame, most: int = 4, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """A row for each input row and each of the first ``most`` components, in the columns of ``SHAPE``.

    ``deviation`` is a row's squared distance from the mean, times ``n`` squared; ``whitened``
    its place along the component, in standard deviations; ``identity_error`` tells how far the
    covariance of what is returned for the fit list is from the identity.
    """
    import pyarrow as pa

    rows = _points(df, scale, id_col, vec_col)
    told = rows.agg(
        F.max(F.size("x")).alias("dims"), F.max(F.array_max(F.transform("x", lambda x: F.abs(x.cast("double"))))).alias("far")
    ).head()
    if (told.far or 0.0) > 2.0**52:
        raise ValueError(f"entries up to {told.far} are too large to be exact")
    dims = max(1, told.dims or 0)
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    points = keep(rows.select(filled.alias("x")).distinct(), "points")
    model = fit(points, dims)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], SHAPE)
    explained = (model.values / model.trace).tolist()[:most]
    model.components, model.values = model.components[:most], model.values[:most]
    count = len(model.values)

    def squares(x):
        w = model.whiten(x)
        return np.vstack([w.T @ w, w.sum(axis=0)]).ravel()

    got = _summed(points, dims, count, squares) / model.n
    off = got[:count] - np.outer(got[count], got[count]) - np.eye(count)
    error = float(np.abs(off).max())

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            each = np.repeat(np.arange(len(x)), count)
            size = len(each)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("id").take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(size, model.n, np.int64)),
                    "deviation": pa.array(_deviation(x, model.n, model.total), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(model.whiten(x).ravel()),
                    "explained": pa.array(np.tile(explained, len(x)).astype(float)),
                    "identity_error": pa.array(np.full(size, error)),
                }
            )

    return rows.select("id", "x").mapInArrow(run, SHAPE)
