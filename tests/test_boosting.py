"""Histogram boosting against plain Python searches and closed forms."""

import heapq
import json

import numpy as np
import pandas as pd
import pytest

from voltsight.operators import boosting as B


def data(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[:, 2] = rng.integers(0, 5, n)
    y = 3 * (x[:, 0] > 0.4) - 2 * x[:, 1] * (x[:, 2] > 2) + rng.normal(scale=0.3, size=n)
    x[rng.random(n) < 0.1, 1] = np.nan
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})


def plain_score(g, h, s):
    t = np.sign(g) * max(abs(g) - s.alpha, 0)
    return t * t / (h + s.lam)


def plain_split(x, g, s):
    """Every value of every feature as threshold, missing values on either side."""
    best = None
    for f in range(x.shape[1]):
        v = x[:, f]
        for cut in np.unique(v[~np.isnan(v)])[:-1]:
            for ml in (True, False):
                left = (v <= cut) | (np.isnan(v) & ml)
                n = int(left.sum())
                if min(n, len(g) - n) < max(1, s.min_child_rows, s.min_child_hessian):
                    continue
                gain = (plain_score(g[left].sum(), n, s) + plain_score(g[~left].sum(), len(g) - n, s)
                        - plain_score(g.sum(), len(g), s)) / 2
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, cut, ml, left)
    return best


def plain_tree(x, g, s):
    """One split at a time, the leaf of highest gain first; the value of every row."""
    rows, heap, leaves = {0: np.arange(len(g))}, [], 1
    depth = {0: 0}

    def offer(node):
        found = plain_split(x[rows[node]], g[rows[node]], s) if not s.max_depth or depth[node] < s.max_depth else None
        if found:
            heapq.heappush(heap, (-found[0], node, found[4]))

    offer(0)
    while heap and (not s.max_leaves or leaves < s.max_leaves):
        _, node, left = heapq.heappop(heap)
        at, new = rows.pop(node), max(depth) + 1
        for child, part in ((new, at[left]), (new + 1, at[~left])):
            rows[child], depth[child] = part, depth[node] + 1
            offer(child)
        leaves += 1
    out = np.zeros(len(g))
    for at in rows.values():
        t = g[at].sum()
        out[at] = -np.sign(t) * max(abs(t) - s.alpha, 0) / (len(at) + s.lam) * s.step
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(data()).repartition(5)


def test_first_split_equals_search_over_all_thresholds(spark, table):
    pdf = data()
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()
    for s in (B.Settings(rounds=1, max_depth=1, bins=1000, lam=0.0), B.Settings(rounds=1, max_depth=1, bins=1000, alpha=25, lam=7, min_child_rows=40)):
        gain, f, cut, ml, left = plain_split(x, y.mean() - y, s)
        t = B.fit(table, ["a", "b", "c"], "y", s).table(spark).orderBy("node").collect()
        assert (t[0].feature, t[0].threshold) == ("abc"[f], cut) and t[0].gain == pytest.approx(gain)
        for node, rows in ((t[0].left, left), (t[0].right, ~left)):
            g = (y.mean() - y)[rows].sum()
            assert t[node].value == pytest.approx(-np.sign(g) * max(abs(g) - s.alpha, 0) / (rows.sum() + s.lam) * s.step)


@pytest.mark.parametrize("shape", [{"max_depth": 3}, {"max_depth": 0, "max_leaves": 7}, {"max_depth": 4, "max_leaves": 6}])
def test_rounds_equal_plain_boosting(spark, table, shape):
    s = B.Settings(rounds=3, step=0.3, bins=1000, alpha=0.5, lam=2.0, min_child_rows=8, **shape)
    pdf = data()
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()
    margin = np.full(len(y), y.mean())
    for _ in range(s.rounds):
        margin = margin + plain_tree(x, margin - y, s)
    m = B.fit(table, ["a", "b", "c"], "y", s)
    assert np.abs(m.margins(x) - margin).max() < 1e-9
    if s.max_leaves:
        assert max(sum(f < 0 for f in t.feature) for t in m.trees) <= s.max_leaves
    got = B.predict(spark.createDataFrame(pdf), m).select("y", "prediction").toPandas().sort_values(["y", "prediction"])
    want = pd.DataFrame({"y": y, "p": margin}).sort_values(["y", "p"])
    assert np.abs(got["prediction"].to_numpy() - want["p"].to_numpy()).max() < 1e-9


def test_penalties_shrink_leaves():
    g, h = 40.0, 25.0
    assert B.leaf_weight(g, h, B.Settings(step=1, lam=0)) == pytest.approx(-1.6)
    assert B.leaf_weight(g, h, B.Settings(step=1, lam=15)) == pytest.approx(-1.0)
    assert B.leaf_weight(g, h, B.Settings(step=0.5, lam=5, alpha=10)) == pytest.approx(-0.5)
    assert B.leaf_weight(g, h, B.Settings(step=1, alpha=40)) == 0.0
    grid = np.linspace(-3, 3, 60001)
    s = B.Settings(step=1, lam=3, alpha=6)
    assert B.leaf_weight(g, h, s) == pytest.approx(grid[np.argmin(g * grid + (h + s.lam) * grid**2 / 2 + s.alpha * abs(grid))], abs=1e-4)


def test_written_margins_change_nothing(table, monkeypatch):
    s = B.Settings(rounds=5, max_depth=2, rows=0.7, columns=0.7)
    x = data()[["a", "b", "c"]].to_numpy()
    whole = B.fit(table, ["a", "b", "c"], "y", s)
    monkeypatch.setattr(B, "REFRESH", 2)
    again = B.fit(table, ["a", "b", "c"], "y", s)
    assert np.abs(whole.margins(x) - again.margins(x)).max() < 1e-9
    assert {f for t in whole.trees for f in t.feature if f >= 0} == {0, 1, 2}
    back = B.Model.from_dict(json.loads(json.dumps(whole.to_dict())))
    assert (back.margins(x) == whole.margins(x)).all()


def test_logistic_loss_separates(spark):
    pdf = data(400)
    pdf["k"] = (pdf["a"] > 0.4).astype(int)
    df = spark.createDataFrame(pdf)
    m = B.fit(df, ["a", "b", "c"], "k", B.Settings(rounds=4, step=0.5, max_depth=2, bins=1000, loss="logistic"))
    assert m.trees[0].feature[0] == 0 and m.edges[0][m.trees[0].bin[0] - 1] == 0.4
    p = B.predict(df, m).toPandas()
    assert ((p["prediction"] > 0.5) == (p["k"] == 1)).all() and p["prediction"].between(0, 1).all()


def test_odd_rows(spark, table):
    with pytest.raises(ValueError):
        B.fit(table.where("a > 1e9"), ["a"], "y")
    with pytest.raises(ValueError):
        B.fit(table, ["a"], "y", B.Settings(loss="other"))
    flat = spark.sql("SELECT 1.0 AS a, CAST(NULL AS DOUBLE) AS b, CAST(id AS DOUBLE) AS y, 's' AS x FROM range(10)")
    m = B.fit(flat.unionByName(flat.withColumn("y", flat.b)), ["a", "b"], "y", B.Settings(rounds=2))
    assert [len(t.value) for t in m.trees] == [1, 1] and m.base == 4.5
    assert B.predict(flat, m).columns == [*flat.columns, "prediction"]
    assert B.predict(flat.limit(0), m).count() == 0
