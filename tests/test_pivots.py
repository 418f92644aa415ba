"""Exact neighbours by pivots against all pairs."""

import numpy as np
import pytest

from voltsight.operators.pivots import PivotIndex
from voltsight.operators.similarity import knn_regress

SCHEMA = "id bigint, v array<double>, y double"


def _frame(spark, pts, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in p], float(sum(p))) for i, p in enumerate(pts)], SCHEMA).repartition(3)


def _plain(q, qids, p, pids, k, exclude_self):
    out = set()
    for v, i in zip(q, qids):
        d = np.linalg.norm(p - v, axis=1)
        keep = [j for j in np.lexsort((pids, d)) if not (exclude_self and pids[j] == i)][:k]
        out |= {(int(i), r + 1, int(pids[j]), round(float(d[j]), 9)) for r, j in enumerate(keep)}
    return out


def _got(df):
    return {(r.id, r.rank, r.neighbor_id, round(r.score, 9)) for r in df.collect()}


@pytest.mark.parametrize("k,pivots,rings,part_rows", [(5, 16, 4, 4096), (20, 7, 1, 16), (3, 1, 8, 9)])
def test_equals_all_pairs_with_ties_and_copies(spark, k, pivots, rings, part_rows):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(size=(60, 3)), np.ones((70, 3)), rng.integers(0, 3, size=(90, 3)), [[50.0, 50, 50]]])
    df = _frame(spark, pts)
    index = PivotIndex(df, "id", "v", pivots, rings, part_rows)
    ids = np.arange(len(pts))
    assert _got(index.search(df, "id", "v", k, True)) == _plain(pts, ids, pts, ids, k, True)
    assert index.pairs <= len(pts) ** 2


def test_far_groups_are_not_scored(spark):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(size=(100, 4)) + 40 * c for c in rng.normal(size=(12, 4))])
    df = _frame(spark, pts)
    ask = pts[::10] + 0.01
    index = PivotIndex(df, "id", "v", 48, 4)
    ids = np.arange(len(ask)) + 10_000
    assert _got(index.search(_frame(spark, ask, 10_000), "id", "v", 5)) == _plain(ask, ids, pts, np.arange(len(pts)), 5, False)
    assert index.pairs < 0.25 * len(ask) * len(pts)


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0], 1.0), (2, [1.0, 0.0], 2.0), (3, None, 3.0), (4, [1.0, None], 4.0), (5, [float("nan"), 0.0], 5.0), (None, [0.0, 0.0], 6.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = PivotIndex(df, "id", "v")
    assert _got(index.search(df, "id", "v", 5)) == {(1, 1, 1, 0.0), (1, 2, 2, 1.0), (2, 1, 2, 0.0), (2, 2, 1, 1.0)}
    assert index.search(df.limit(0), "id", "v", 5).count() == 0
    assert PivotIndex(df.limit(0), "id", "v").search(df, "id", "v", 5).count() == 0
    with pytest.raises(ValueError):
        index.search(spark.createDataFrame([(1, [1.0], 0.0)], SCHEMA), "id", "v", 5)
    with pytest.raises(ValueError):
        PivotIndex(spark.createDataFrame([(1, [1.0], 0.0), (2, [1.0, 2.0], 0.0)], SCHEMA), "id", "v")


@pytest.mark.parametrize("weighted", [False, True])
def test_regression_is_the_same_with_the_index(spark, weighted):
    pts = np.random.default_rng(3).normal(size=(80, 2)).round(1)
    df = _frame(spark, pts)
    plain = {r.id: r.prediction for r in knn_regress(df, df, "id", "id", "v", "y", 5, weighted, True).collect()}
    got = {r.id: r.prediction for r in knn_regress(df, df, "id", "id", "v", "y", 5, weighted, True, PivotIndex(df, "id", "v", 9)).collect()}
    assert plain.keys() == got.keys() and all(got[i] == pytest.approx(plain[i]) for i in plain)
