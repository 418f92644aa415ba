"""Model registry, expanding-window folds, exact silhouette and vector rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from voltsight import catalog, queries  # noqa: F401
from voltsight.operators import ml
from voltsight.operators import similarity as sim
from voltsight.plans import recommend as rc
from voltsight.plans import registry as rg

TARGETS = (("demand", "demand_12h", ["a", "b"]), ("price", "price_12h", ["b", "c"]))
REGRESSORS = {"linear": ("linear", {}), "tree": ("tree", {"maxDepth": 4})}
CLASSIFIERS = {"forest": ("forest", {"numTrees": 8, "maxDepth": 5})}


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(5)
    n = 260
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(
        series_id=0, ts=pd.date_range("2024-01-01", periods=n, freq="h"), demand_12h=4 * x[:, 0] - x[:, 1] + 10,
        price_12h=np.exp(x[:, 1]) + x[:, 2], split=["train"] * 200 + ["test"] * 60)
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(3)


@pytest.fixture(scope="module")
def registry(spark, split, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("registry"))
    return rg.Registry(spark, rg.train_registry(split, TARGETS, REGRESSORS, CLASSIFIERS, ["a", "b", "c"], path, n_splits=3))


def test_every_model_is_stored_with_its_scores(registry):
    got = {(r.role, r.target, r.name) for r in registry.rows}
    assert got == ({("regressor", t, n) for t in ("demand", "price") for n in REGRESSORS}
                   | {("classifier", t, "forest") for t in ("demand", "price")} | {("cluster", "", "kmeans")})
    for r in registry.rows:
        if r.role == "classifier":
            assert 0 < r.metrics["cv_macro_f1"] <= 1 and set(r.params) == {"low", "high"}
    assert registry.entry("regressor", "demand", "linear").metrics["test_r2"] > 0.999


def test_every_window_is_a_fit_of_its_own(spark, split, tmp_path, monkeypatch):
    """no window waits for another; the scores are those of the windows fitted one by one."""
    counts, plain = [], ml.run_parallel
    monkeypatch.setattr(ml, "run_parallel", lambda tasks, n: counts.append(len(tasks)) or plain(tasks, n))
    # the price classes of the first windows are one class only
    rows = split.withColumn("price_12h", F.when(F.col("ts") < F.lit("2024-01-05"), 0.0).otherwise(F.col("price_12h") + 100))
    rows = rows.where("split = 'train' or ts > '2024-01-09 12:00:00'").coalesce(1)
    reg = rg.Registry(spark, rg.train_registry(rows, TARGETS, {}, CLASSIFIERS, ["a"], str(tmp_path / "r"), n_splits=3))
    bounds = {t: reg.bounds(t) for t, _, _ in TARGETS}
    at = ml.fold_positions(rg.with_classes(rows, TARGETS, bounds).where("split = 'train'"), ["series_id"], "ts").checkpoint()
    fitted = 0
    for target, _, feats in TARGETS:
        scores = []
        for i in range(3):
            past, after = (ml.fold_rows(at, i, role, 3) for role in ("train", "test"))
            if past.select(f"{target}_label").distinct().count() > 1:
                m = ml.fit_classifier(past, feats, f"{target}_label", "forest", **CLASSIFIERS["forest"][1])
                scores.append(ml.classification_summary(m.transform(after), f"{target}_label", "prediction").first()["macro_f1"])
        fitted += len(scores)
        assert reg.entry("classifier", target, "forest").metrics["cv_macro_f1"] == pytest.approx(np.mean(scores), abs=0.1)
    assert 3 < fitted < 6 and counts == [2 + 1 + fitted]


def test_recommendation_scores_requests_and_profiles_by_one_registry(spark, monkeypatch):
    """the stored models reach the driver once a query."""
    from voltsight.queries import registry as qr
    given = []

    class Stop(Exception):
        pass

    def profiles(spark, sf_dir, registry=None):
        given.append(registry)
        raise Stop
    reg = type("R", (), {"score": lambda self, df, *names: df})()
    names = ["request_id", "pred_demand", "pred_price", "demand_class_enc", "price_class_enc", "cluster", "hour_sin", "hour_cos",
             "month_sin", "month_cos", "renewable_pct", "is_weekend"]
    for name, value in (("trained", lambda *a: (None, reg)), ("chosen", lambda r: ({}, {})), ("profiles", profiles),
                        ("requests", lambda *a: spark.range(1).select(*[F.col("id").alias(n) for n in names]))):
        monkeypatch.setattr(qr, name, value)
    with pytest.raises(Stop):
        qr.q_recommend(spark, "")
    assert given == [reg]


def test_scores_equal_each_stored_model_and_keep_the_columns(spark, registry):
    rows = spark.createDataFrame([(1, 0.5, 1.0, None), (2, None, None, 2.0), (3, -1.0, 0.0, 0.0)],
                                 "id bigint, a double, b double, c double")
    names = {"demand": "linear", "price": "tree"}, {"demand": "forest", "price": "forest"}
    out = registry.score(rows, *names)
    assert out.columns[:4] == rows.columns
    assert [tuple(r)[:4] for r in out.orderBy("id").collect()] == [tuple(r) for r in rows.orderBy("id").collect()]
    filled = rows.fillna(0.0)
    for role, chosen, column in (("regressor", names[0], "pred_{}"), ("classifier", names[1], "{}_class_enc")):
        for target, name in chosen.items():
            plain = registry.model(registry.entry(role, target, name)).transform(filled).select("id", "prediction").collect()
            assert {r.id: r.prediction for r in plain} == {r.id: r[column.format(target)] for r in out.collect()}
    plain = registry.model(registry.entry("cluster", "", "kmeans")).transform(filled).select("id", "prediction").collect()
    assert {r.id: r.prediction for r in plain} == {r.id: r.cluster for r in out.collect()}


def test_scoring_moves_no_row(registry, split):
    out = registry.score(split, {"demand": "tree"}, {"price": "forest"})
    assert "Exchange" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.rdd.getNumPartitions() == split.rdd.getNumPartitions()


def test_classes_use_the_bounds_of_the_training_rows(registry, split):
    y = split.where("split = 'train'").toPandas()
    for target, label, _ in TARGETS:
        b = registry.bounds(target)
        np.testing.assert_allclose([b["low"], b["high"]], np.quantile(y[label], [0.33, 0.66]), rtol=1e-12)


def test_a_failed_training_leaves_no_registry(spark, split, tmp_path):
    with pytest.raises(ValueError):
        rg.train_registry(split, TARGETS, {"x": ("no such kind", {})}, {}, ["a"], str(tmp_path / "r"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        rg.Registry(spark, str(tmp_path / "r"))


def test_no_training_row_is_an_error(split, tmp_path):
    with pytest.raises(ValueError, match="no training rows"):
        rg.train_registry(split.limit(0), TARGETS, REGRESSORS, CLASSIFIERS, ["a"], str(tmp_path))


def test_unknown_model_is_an_error(registry, split):
    with pytest.raises(KeyError):
        registry.score(split, {"demand": "missing"}, {})


def _manifest(spark, rows):
    return spark.createDataFrame([("classifier", t, n, "", [], {}, m) for t, n, m in rows], rg._MANIFEST)


def test_best_classifier_by_cv_else_macro_f1(spark):
    best = rg.best_classifiers(_manifest(spark, [
        ("demand", "a", {"cv_macro_f1": 0.4, "macro_f1": 0.9}), ("demand", "b", {"cv_macro_f1": 0.5, "macro_f1": 0.1}),
        ("price", "a", {"macro_f1": 0.7}), ("price", "b", {"cv_macro_f1": 0.6, "macro_f1": 0.9})])).collect()
    assert {(r.target, r["name"], r.score) for r in best} == {("demand", "b", 0.5), ("price", "a", 0.7)}


def test_log_and_summary_by_task(spark, registry):
    log = {(r.task, r.model, r.target): r.metrics for r in rg.experiment_log(registry.manifest).collect()}
    assert len(log) == len(registry.rows) and ("classification_price", "forest", "price") in log and ("clustering", "kmeans", "") in log
    rows = {tuple(r) for r in rg.summary_rows(registry.manifest).collect()}
    assert {("best_model", "regression_demand", "linear"), ("best_model", "classification_price", "forest"),
            ("clustering", "chosen_k", "3")} <= rows and len(rows) == 5


def test_recommendation_equals_a_plain_search_over_the_scored_rows(registry, split):
    scored = registry.score(split.where("split = 'test'"), {"demand": "linear", "price": "tree"},
                            {"demand": "forest", "price": "forest"})
    prof = scored.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("profile_id"), "ts", "pred_demand", "pred_price",
                         "demand_class_enc", "price_class_enc", "cluster",
                         *[(F.col("a") + i).alias(c) for i, c in enumerate(rc.PROFILE_COLS[5:])])
    got = {r.profile_id: r for r in rc.recommend_by_index(prof, "profile_id", 5).collect()}
    p = prof.toPandas().sort_values("profile_id").reset_index(drop=True)
    v = p[list(rc.PROFILE_COLS)].to_numpy(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    sims = v @ v.T
    for i in range(len(p)):
        s = sims[i].copy()
        s[i] = -9
        top = np.lexsort((p.profile_id, -s))[:5]
        modes = [p[c].iloc[top].mode()[0] for c in ("demand_class_enc", "price_class_enc")]
        share = np.mean((p.demand_class_enc.iloc[top] == modes[0]) & (p.price_class_enc.iloc[top] == modes[1]))
        r = got[p.profile_id[i]]
        assert (r.voted_demand_class, r.voted_price_class) == tuple("Low Medium High".split()[int(m)] for m in modes)
        assert r.confidence == pytest.approx(round(share, 2))
        np.testing.assert_allclose(r.top_similarities, s[top], atol=6e-5)


# ------------------------------------------------------------------- M18
@pytest.mark.parametrize("n", [5, 6, 17, 40])
def test_folds_are_ranges_of_positions(spark, n):
    rows = spark.range(n).select(F.lit(1).alias("series_id"), (F.timestamp_seconds(F.col("id") * 3600)).alias("ts"), "id")
    at = ml.fold_positions(rows, ["series_id"], "ts")
    seg = {r.id: r.segment for r in at.withColumn("segment", ml.fold_segment()).collect()}
    size = n // 6
    for i in range(5):
        start = n - (5 - i) * size
        train = {r.id for r in ml.fold_rows(at, i, "train").collect()}
        test = {r.id for r in ml.fold_rows(at, i, "test").collect()}
        assert train == set(range(start)) and test == set(range(start, start + size))
        if size:
            assert train == {k for k, s in seg.items() if s <= i} and test == {k for k, s in seg.items() if s == i + 1}


def test_baselines_without_a_training_row(spark):
    """sf0.001 has one complete feature row, which is a test row: nothing to fit on."""
    assert {r.model for r in catalog.QUERIES["m18_cv_macro_f1"](spark, SF001).collect()} <= {"persistence"}
    assert catalog.QUERIES["m10_knn_scaled_features"](spark, SF001).count() == 0


def test_fold_table_copies_no_row(spark):
    plan = catalog.QUERIES["m18_cv_macro_f1"](spark, SF01)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("shift", [0.0, 1e8])
def test_fold_lines_add_up_from_segments(spark, shift):
    rng = np.random.default_rng(8)
    x = rng.normal(size=60)
    y = 2 * x + rng.normal(size=60)
    seg = np.repeat(range(6), 10)
    df = spark.createDataFrame(pd.DataFrame({"x": x + shift, "y": y + shift, "segment": seg}))
    lines = ml.fold_lines(df, "y", "x")
    for i, (slope, intercept) in enumerate(lines):
        want = np.polyfit(x[seg <= i], y[seg <= i], 1)
        np.testing.assert_allclose(slope, want[0], rtol=1e-6)
        np.testing.assert_allclose(slope * (x + shift) + intercept - shift, np.polyval(want, x), atol=1e-5)


def test_fold_lines_without_a_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (1.0, 3.0, 0), (2.0, 4.0, 1)], "x double, y double, segment int")
    assert ml.fold_lines(df, "y", "x", 2)[0] == (None, None)


# ------------------------------------------------------------------- M21, J5
def _silhouette(points, labels):
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    out = []
    for i, g in enumerate(labels):
        own = (labels == g).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i][labels == g].sum() / (own - 1)
        b = min(d[i][labels == h].mean() for h in set(labels) - {g})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


@pytest.mark.parametrize("block_rows,shift", [(4096, 0.0), (7, 0.0), (16, 1e5)])
def test_silhouette_equals_the_pairwise_definition(spark, block_rows, shift):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(size=(30, 3)), rng.normal(size=(20, 3)) + 3, [[9.0, 9, 9]], np.ones((6, 3))]) + shift
    lab = np.array([0] * 30 + [1] * 20 + [2] + [3] * 6)
    df = spark.createDataFrame([(i, [float(x) for x in p], int(g)) for i, (p, g) in enumerate(zip(pts, lab))],
                               "id bigint, v array<double>, g int").repartition(3)
    got = {r.id: r.silhouette for r in sim.silhouette_rows(df, "id", "v", "g", block_rows).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(pts))], _silhouette(pts, lab), atol=1e-9)


def test_silhouette_of_one_cluster_and_of_no_row(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, None, 0), (4, [2.0], None)], "id bigint, v array<double>, g int")
    assert [(r.id, r.silhouette) for r in sim.silhouette_rows(df, "id", "v", "g").orderBy("id").collect()] == [(1, None), (2, None)]
    assert sim.silhouette_rows(df.limit(0), "id", "v", "g").count() == 0


def test_unusable_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0, 0.0, 0.0]), (8, [0.9, 0.1, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    for metric in ("cosine", "euclidean"):
        got = {(r.id, r.neighbor_id) for r in sim.topk_similar(df, df, "id", "id", "v", "v", 5, metric, exclude_self=True).collect()}
        assert got == {(1, 2), (2, 1), (7, 8), (8, 7)}


def test_kde_copies_no_row(spark):
    from voltsight.operators.profile import kde_curve
    plan = kde_curve(spark.range(100).selectExpr("id * 1.0D AS x"), "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")          # only the one row of sums is spread out


