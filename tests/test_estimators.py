"""Planted-signal tests of the estimator operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltsight.operators import ml

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 3)) * [1.0, 2.0, 0.5] + [0.0, 5.0, -1.0]
    y = x @ [3.0, -2.0, 0.5] + 7 + rng.normal(scale=0.05, size=800)
    pdf = pd.DataFrame(x, columns=X).assign(y=y, cls=(np.digitize(x[:, 0], [-0.5, 0.5])).astype(float))
    return spark.createDataFrame(pdf).repartition(4), pdf


def test_pca_equals_the_eigen_decomposition(planted):
    df, pdf = planted
    model = ml.pca_fit(df, X, k=3, variance=None)
    values, vectors = np.linalg.eigh(np.cov(pdf[X].to_numpy().T))
    got = np.array(model["components"])
    for i, v in enumerate(vectors.T[::-1]):
        assert abs(abs(got[i] @ v) - 1) < 1e-8
    np.testing.assert_allclose(got @ got.T, np.eye(3), atol=1e-8)
    scores = ml.pca_transform(df, model).select("pc1", "pc2", "pc3").toPandas()
    np.testing.assert_allclose(scores.var(), values[::-1], rtol=1e-8)


def test_linear_models_find_the_planted_weights(planted):
    df, _ = planted
    fit = ml.fit_regressor(df, X, "y", "linear").stages[-1]
    np.testing.assert_allclose(list(fit.coefficients), [3.0, -2.0, 0.5], atol=0.05)
    bayes = ml.linear_predict(df, ml.bayesian_ridge(df, "y", X))
    assert bayes.select(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.06


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_tree_models_beat_the_mean(planted, kind):
    df, pdf = planted
    out = ml.fit_regressor(df, X, "y", kind).transform(df)
    assert out.select(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0] < 0.2 * pdf.y.var()


def test_forest_classifier_finds_the_planted_classes(planted):
    df, _ = planted
    out = ml.fit_classifier(df, X, "cls", "forest").transform(df)
    assert out.select(F.avg((F.col("prediction") == F.col("cls")).cast("double"))).first()[0] > 0.9


def test_kmeans_separates_planted_groups(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(np.concatenate([rng.normal(size=(100, 2)) + c for c in ([0, 0], [20, 0], [0, 20])]), columns=["p", "q"])
    df = spark.createDataFrame(pdf.assign(g=np.repeat([0, 1, 2], 100)))
    km = ml.kmeans_fit(df, ["p", "q"], 3, seeds=range(2))
    lab = ml.assign_nearest(df, [list(c) for c in km.clusterCenters()], ["p", "q"])
    assert lab.select("g", "cluster").distinct().count() == 3
    assert ml.silhouette(lab, ["p", "q"], "cluster") > 0.9
    plain = ml.assembler(["p", "q"]).transform(df)
    assert lab.select("cluster").exceptAll(km.transform(plain).select(F.col("prediction").alias("cluster"))).count() == 0


@pytest.mark.parametrize("k,shift", [(2, 0.0), (3, 0.0), (2, 1e6)])
def test_component_regressions_from_rotated_moments(spark, k, shift):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) * [3.0, 1.0, 0.2]
    y = x @ [1.0, -2.0, 4.0] + rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame(x + shift, columns=X).assign(y=y + shift)).repartition(3)
    fit = ml.component_regressions(df, "y", X, k=k)
    scores = (x - x.mean(0)) @ np.array(fit["pca"]["components"]).T
    want = np.linalg.lstsq(np.c_[scores, np.ones(len(x))], y, rcond=None)[0]
    got = ml.linear_predict(df, fit["linear"]).select("y", "prediction", *X).toPandas()
    mine = (got[X].to_numpy() - shift - x.mean(0)) @ np.array(fit["pca"]["components"]).T
    np.testing.assert_allclose(got.prediction - shift, np.c_[mine, np.ones(len(x))] @ want, atol=1e-5)
    assert abs(mine.T @ (got.y - got.prediction).to_numpy()).max() < 1e-3
    plain = ml.ridge_of(ml.centred_moments(ml.pca_transform(df, fit["pca"]), [f"pc{i + 1}" for i in range(k)] + ["y"]),
                        [f"pc{i + 1}" for i in range(k)])
    np.testing.assert_allclose(np.array(fit["pca"]["components"]) @ fit["bayesian"]["coef"], plain["coef"], rtol=1e-4, atol=1e-6)


def test_component_without_a_spread_has_no_slope(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.5)], "a double, b double, y double")
    fit = ml.component_regressions(df, "y", ["a", "b"], k=2)
    assert np.allclose(fit["linear"]["coef"], [2.25, 0.0])


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_one_series_is_split_in_many_tasks(spark, threshold):
    """the fits read what the split left; a join by series, or rows broadcast to
    the table of days, left a single series in one part."""
    t0 = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame({"series_id": [1] * 960 + [2] * 3 + [3], "ts": [t0 + pd.Timedelta(hours=h) for h in [*range(960), 0, 1, 2]] + [pd.NaT]})
    rows = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": threshold,
            "spark.sql.adaptive.autoBroadcastJoinThreshold": threshold}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        split = ml.chrono_split_label(rows, ["series_id"], "ts").withColumn("part", F.spark_partition_id()).toPandas()
        at = ml.fold_positions(rows, ["series_id"], "ts").withColumn("part", F.spark_partition_id()).toPandas()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "BroadcastHashJoin" not in ml.fold_positions(rows, ["series_id"], "ts")._jdf.queryExecution().executedPlan().toString()
    for found in (split, at):
        assert len(found) == 963 and found[found.series_id == 1].part.nunique() > 2
    assert split[split.split == "train"].groupby("series_id").size().to_dict() == {1: 768, 2: 2}
    assert at.groupby("series_id")._of.unique().map(list).to_dict() == {1: [960], 2: [3]}
    assert sorted(at[at.series_id == 1]["_at"]) == list(range(960))
