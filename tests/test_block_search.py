"""Blocked exact search: no row is copied per block, and the result is the plain one."""

import numpy as np
import pytest

from voltsight.operators import similarity as sim


def _frame(spark, pts, ids=None):
    rows = [(int(i), [float(x) for x in p], int(i) % 3) for i, p in zip(range(len(pts)) if ids is None else ids, pts)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, g int").repartition(3)


def _plain(pts, ids, k, cosine):
    unit = pts / np.linalg.norm(pts, axis=1)[:, None]
    out = {}
    for i in np.unique(ids):
        near = []
        for q in np.flatnonzero(ids == i):
            s = -(unit @ unit[q]) if cosine else np.linalg.norm(pts - pts[q], axis=1)
            near += [(round(float(s[j]), 9), int(ids[j])) for j in range(len(pts)) if ids[j] != i]
        out[int(i)] = sorted(near)[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("k,block_rows", [(5, 8), (20, 16), (3, 4096)])
def test_equals_all_pairs_over_many_blocks(spark, metric, k, block_rows):
    rng = np.random.default_rng(11)
    pts = np.concatenate([rng.normal(size=(150, 3)), rng.integers(1, 3, size=(60, 3)), rng.normal(size=(30, 3))])
    ids = np.concatenate([np.arange(210), np.arange(30)])               # thirty ids come twice
    df = _frame(spark, pts, ids)
    got: dict = {}
    top = sim.topk_similar(df, df, "id", "id", "v", "v", k, metric, exclude_self=True, block_rows=block_rows)
    for r in top.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((round(-r.score if metric == "cosine" else r.score, 9), r.neighbor_id))
    want = _plain(pts, ids, k, metric == "cosine")
    assert got.keys() == want.keys()
    for i in want:
        np.testing.assert_allclose([s for s, _ in got[i]], [s for s, _ in want[i]], atol=2e-9)
        if metric == "euclidean":                                       # cosines of copies differ in the last digit
            assert [n for _, n in got[i]] == [n for _, n in want[i]]


def _bytes(df):
    """Bytes that the exchanges of a finished query wrote."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            plan.append(p.executedPlan())
        if "QueryStage" in p.nodeName():
            plan.append(p.plan())
        if p.nodeName() == "Exchange":
            total += p.metrics().get("shuffleBytesWritten").get().value()
        plan += [p.children().apply(i) for i in range(p.children().size())]
    return total


@pytest.mark.parametrize("build", [
    lambda d: sim.topk_similar(d, d, "id", "id", "v", "v", 5, "euclidean", True, block_rows=16),
    lambda d: sim.silhouette_rows(d, "id", "v", "g", 16)], ids=["search", "silhouette"])
def test_shuffled_bytes_grow_with_the_rows(spark, build):
    pts = np.random.default_rng(4).normal(size=(1600, 8))
    small, large = (_bytes(build(_frame(spark, pts[:n]))) for n in (400, 1600))          # 25 and 100 blocks
    assert large < 6 * small                                            # 16 times as many pairs of blocks
