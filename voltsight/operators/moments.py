"""Mergeable centred moments: count, means and co-moment matrix.

Every batch is centred by its own means before products are summed, and partial
results are merged pairwise with the exact correction for the distance of their
means, so a large common offset of a column cancels nothing.  One row of numbers
leaves a task; ``MERGERS`` groups merge them before the last few reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGERS = 32
_ROW = "part int, n bigint, mean array<double>, comoment array<double>"


class Moments:
    """``n`` rows with ``mean`` and ``comoment`` (sum of products of deviations)."""

    def __init__(self, n: int, mean: np.ndarray, comoment: np.ndarray):
        self.n, self.mean, self.comoment = n, mean, comoment

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        if not len(x):
            return cls(0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1])))
        mean = x.mean(axis=0)
        mean += (x - mean).mean(axis=0)         # what rounding left of the mean
        off = x - mean
        return cls(len(x), mean, off.T @ off)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not other.n or not self.n:
            return self if self.n else other
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n),
                       self.comoment + other.comoment + np.outer(gap, gap) * (self.n * other.n / n))

    def block(self, at) -> np.ndarray:
        return self.comoment[np.ix_(at, at)]

    def projected(self, w: np.ndarray) -> Moments:
        """Moments of the linear combinations ``w @ row``."""
        return Moments(self.n, w @ self.mean, w @ self.comoment @ w.T)

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.comoment / max(self.n - ddof, 1)

    def least_squares(self, y: int, xs: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
        """Slopes of ``y`` on ``xs`` with a constant, residual sum of squares, and
        the co-moments of ``xs``.  Columns that determine each other or leave no
        residual are an error, not a number."""
        own, cross = self.block(xs), self.comoment[xs, y]
        scale = np.sqrt(np.diag(own))
        if not scale.all():
            raise ValueError("a regressor is constant")
        beta = np.linalg.solve(own / np.outer(scale, scale), cross / scale) / scale
        ssr = float(self.comoment[y, y] - 2 * beta @ cross + beta @ own @ beta)
        if ssr <= 0:
            raise ValueError("no residual is left: the columns determine each other")
        return beta, ssr, own


def centred_moments(df: DataFrame, cols) -> Moments:
    """Moments of ``cols`` over the rows in which all of them have a value."""
    names = list(cols)
    d = len(names)

    def rows(key, m):
        return pa.RecordBatch.from_pydict({"part": pa.array([key], pa.int32()), "n": [m.n], "mean": [m.mean.tolist()],
                                           "comoment": [m.comoment.ravel().tolist()]})

    def partial(batches):
        total = Moments(0, np.zeros(d), np.zeros((d, d)))
        for b in batches:
            total = total + Moments.of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        if total.n:
            yield rows(TaskContext.get().partitionId() % MERGERS, total)

    def merged(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([rows(t["part"][0].as_py(), _sum(t.sort_by([("n", "ascending")]), d))])

    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).dropna()
    parts = numbers.mapInArrow(partial, _ROW).groupBy("part").applyInArrow(merged, _ROW).toArrow()
    return _sum(parts.sort_by("part"), d)


def _sum(t: pa.Table, d: int) -> Moments:
    total = Moments(0, np.zeros(d), np.zeros((d, d)))
    for n, mean, comoment in zip(*(t[c].to_pylist() for c in ("n", "mean", "comoment"))):
        total = total + Moments(n, np.array(mean), np.array(comoment).reshape(d, d))
    return total
