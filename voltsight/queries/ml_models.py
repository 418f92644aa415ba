"""Spark ML model queries.

Fits are ``pyspark.ml`` estimators (distributed tree/linear/MLP/KMeans
training) or one pass of centred moments plus a d x d driver solve.  Except
for the fold table (M18), results depend on estimator internals and have no
SQL oracle: the driver records a rows-only check for them.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import FEATURES_SQL, GRID_SQL, GRID1_SQL, register, ts_text
from ..functions import columns as col
from ..operators import ml
from ..operators.moments import centred_moments
from ..operators.profile import quantile_row
from ..plans import features as fe
from ..sources import tables as src

DEMAND_X = [f for f in fe.DEMAND_FEATURES if f not in ("month_sin", "month_cos")]
PRICE_X = [f for f in fe.PRICE_FEATURES if f not in ("month_sin", "month_cos")]
TARGETS = (("demand", "demand_12h", DEMAND_X), ("price", "price_12h", PRICE_X))


def _prepared(spark, sf_dir, n_series=1):
    """Feature table + split, materialised once with a reliable checkpoint:
    every fit iterates over it, so its lineage is cut here."""
    from ..session import cut_lineage
    f = fe.training_features(src.grid_hourly(spark, sf_dir, n_series=n_series))
    return cut_lineage(ml.chrono_split_label(f, ["series_id"], "ts", guard=True))


def _split(sp):
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


def _test_metrics(model, test, label, name):
    pred = model.transform(test)
    return ml.regression_metrics(pred, label, "prediction").withColumn("model", F.lit(name)).withColumn(
        "target", F.lit(label))


def _run_parallel(tasks):
    """Independent fits as concurrent jobs; each task returns a small list of metric rows."""
    return [r for rows in ml.run_parallel(tasks) for r in rows]


def _metric_rows(model, test, label, name, **extra):
    row = _test_metrics(model, test, label, name).first().asDict()
    row.update(extra)
    return [row]


def _rows_df(spark, rows):
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame(rows))


def _union(dfs):
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


_MOMENT_COLS = ["load", "price", "renewable", "fossil", "demand_lag_1h", "demand_lag_24h", "demand_avg_24h", "price_lag_24h"]
#: common offset of every column: the moments must not notice it
_OFFSET = 1e8


@register("m7_centred_moments", FEATURES_SQL + f", c AS (SELECT * FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _MOMENT_COLS)}) SELECT * FROM ("  + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CAST(count(*) AS BIGINT) AS n, round(avg({a}), 5) + 0.0 AS mean_a, round(corr({a}, {b}), 5) + 0.0 AS corr, "
    f"round(ln(greatest(abs(covar_pop({a}, {b})), 1e-3)), 3) + 0.0 AS log_covar FROM c"
    for i, a in enumerate(_MOMENT_COLS) for b in _MOMENT_COLS[i:]) + ")", digits=5)
def q_centred_moments(spark, sf_dir):
    """One pass of mergeable centred moments over the feature table,
    each column moved by 1e8 first; SQL has them without the offset."""
    f = fe.training_features(src.grid_hourly(spark, sf_dir))
    m = centred_moments(f.select(*[(F.col(c) + F.lit(_OFFSET)).alias(c) for c in _MOMENT_COLS]), _MOMENT_COLS)
    cov, rows = m.covariance(0), []
    for i, a in enumerate(_MOMENT_COLS):
        for j in range(i, len(_MOMENT_COLS)):
            rows.append((a, _MOMENT_COLS[j], m.n, round(m.mean[i] - _OFFSET, 5), round(cov[i, j] / math.sqrt(cov[i, i] * cov[j, j]), 5),
                         round(math.log(max(abs(cov[i, j]), 1e-3)), 3)))
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows],
                                 "a string, b string, n bigint, mean_a double, corr double, log_covar double")


@register("m7_pca")
def q_pca(spark, sf_dir):
    """M7: centred PCA keeping 95 % variance on robust-scaled training features."""
    sp = _prepared(spark, sf_dir)
    train, _ = _split(sp)
    sc = ml.robust_scaler(train, DEMAND_X)
    scaled = ml.scale(train, sc)
    model = ml.pca_fit(scaled, DEMAND_X, variance=0.95)
    rows = [(i + 1, float(r)) for i, r in enumerate(model["explained_ratio"])]
    return spark.createDataFrame(rows, "component int, explained_ratio double") \
                .withColumn("n_components", F.lit(model["k"])).withColumn("n_rows", F.lit(train.count()))


@register("m9_bayesian_ridge")
def q_bayesian_ridge(spark, sf_dir):
    """M9: Bayesian ridge of both targets (evidence maximisation on one Gram
    aggregation each); precisions and test-split metrics."""
    sp = _prepared(spark, sf_dir)
    train, test = _split(sp)

    def task(label, feats):
        m = ml.bayesian_ridge(train, label, feats)
        row = ml.regression_metrics(ml.linear_predict(test, m), label, "prediction").first().asDict()
        return [row | {"target": label, "alpha": m["alpha"], "lambda": m["lambda"]}]
    return _rows_df(spark, _run_parallel([lambda label=label, feats=feats: task(label, feats) for _, label, feats in TARGETS]))


@register("m8_m11_m12_regressors")
def q_regressors(spark, sf_dir):
    """Linear, decision tree (depth 10) and random forest
    (200 trees, depth 20) for both targets; test-split metrics.  The six
    fits run as concurrent jobs."""
    sp = _prepared(spark, sf_dir)
    train, test = _split(sp)
    tasks = []
    for label, feats in (("demand_12h", DEMAND_X), ("price_12h", PRICE_X)):
        for name, kind, kw in (("linear", "linear", {}), ("decision_tree", "tree", {"maxDepth": 10}),
                               ("random_forest", "forest", {"numTrees": 200, "maxDepth": 20})):
            tasks.append(lambda label=label, feats=feats, name=name, kind=kind, kw=kw: _metric_rows(
                ml.fit_regressor(train, feats, label, kind, **kw), test, label, name))
    return _rows_df(spark, _run_parallel(tasks))


def _boosted(spark, sf_dir, name, **kw):
    """Boosted trees of both targets, fitted concurrently: depth 6, 80 % of rows
    per round and of columns per split; test-split metrics."""
    train, test = _split(_prepared(spark, sf_dir))
    tasks = [lambda label=label, feats=feats: _metric_rows(
        ml.fit_regressor(train, feats, label, "gbt", maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", **kw),
        test, label, name) for _, label, feats in TARGETS]
    return _rows_df(spark, _run_parallel(tasks))


@register("m13_gbt_regressors")
def q_gbt(spark, sf_dir):
    """Boosted trees, 300 rounds, step 0.03, at least 3 rows a leaf."""
    return _boosted(spark, sf_dir, "gbt", maxIter=300, stepSize=0.03, minInstancesPerNode=3)


@register("m13_gbt_small_step")
def q_gbt_small_step(spark, sf_dir):
    """Boosted trees, 500 rounds, step 0.02."""
    return _boosted(spark, sf_dir, "gbt_small_step", maxIter=500, stepSize=0.02)


@register("m12_regularised_forest")
def q_regularised_forest(spark, sf_dir):
    """M12 regularised, both targets: depth 10, min 10 rows per leaf, 70 % of features per split."""
    sp = _prepared(spark, sf_dir)
    train, test = _split(sp)
    tasks = [lambda label=label, feats=feats: _metric_rows(
        ml.fit_regressor(train, feats, label, "forest", numTrees=200, maxDepth=10, minInstancesPerNode=10,
                         featureSubsetStrategy="0.7"), test, label, "random_forest_regularised")
        for _, label, feats in TARGETS]
    return _rows_df(spark, _run_parallel(tasks))


def _with_classes(df, train):
    """Three-way classes (T2: bounds of the training split) of both targets, as
    text and as the codes ``demand_label`` / ``price_label``."""
    th = quantile_row(train, {f"{name}_{n}": (label, p) for name, label, _ in TARGETS
                              for n, p in (("low", 0.33), ("high", 0.66))}).first().asDict()   # four numbers
    for name, label, _ in TARGETS:
        df = df.withColumn(f"{name}_class", col.three_class(label, F.lit(th[f"{name}_low"]), F.lit(th[f"{name}_high"])))
        df = df.withColumn(f"{name}_label", col.class_code(f"{name}_class").cast("double"))
    return df, th


@register("m14_m16_classifiers")
def q_classifiers(spark, sf_dir):
    """M14 random forest (300 trees, depth 18), M15 one-vs-rest boosted trees
    (300 rounds, depth 6, step 0.05), M16 multilayer perceptron 128/64/32 on the
    classes of both targets; accuracy and macro F1 on the test split."""
    sp = _prepared(spark, sf_dir)
    d, _ = _with_classes(sp, _split(sp)[0])
    train, test = _split(d)

    def task(target, feats, name, kind, kw):
        m = ml.fit_classifier(train, feats, f"{target}_label", kind, **kw)
        row = ml.classification_summary(m.transform(test), f"{target}_label", "prediction").first().asDict()
        return [row | {"model": name, "target": target}]
    specs = (("gbt_one_vs_rest", "gbt_ovr", {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05}),
             ("random_forest", "forest", {"numTrees": 300, "maxDepth": 18}), ("mlp", "mlp", {"maxIter": 200}))
    return _rows_df(spark, _run_parallel([lambda t=t, x=x, s=s: task(t, x, *s) for s in specs for t, _, x in TARGETS]))


@register("m18_time_series_folds", FEATURES_SQL.replace(GRID_SQL, GRID1_SQL) + f"""
, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS cnt FROM f),
fo AS (SELECT unnest(range(0, 5)) AS fold),
r AS (SELECT fold, ts, CASE WHEN idx < cnt - (5 - fold) * (cnt // 6) THEN 'train'
                            WHEN idx < cnt - (5 - fold) * (cnt // 6) + cnt // 6 THEN 'test' END AS role FROM n, fo)
SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS n_rows, {ts_text('min(ts)')} AS first_ts, {ts_text('max(ts)')} AS last_ts
FROM r WHERE role IS NOT NULL GROUP BY 1, 2
""")
def q_folds(spark, sf_dir):
    """Expanding-window CV fold table (5 splits), from the six segments that the
    folds are made of."""
    f = fe.training_features(src.grid_hourly(spark, sf_dir, n_series=1))
    parts = ml.fold_positions(f, ["series_id"], "ts").groupBy(ml.fold_segment().alias("segment")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))   # six rows
    past = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    both = parts.select("segment", F.struct("n_rows", "first_ts", "last_ts").alias("test"), F.struct(
        F.sum("n_rows").over(past).alias("n_rows"), F.min("first_ts").over(past).alias("first_ts"),
        F.max("last_ts").over(past).alias("last_ts")).alias("train")).where("segment > 0")
    return both.unpivot(["segment"], ["train", "test"], "role", "v").select(
        (F.col("segment") - 1).alias("fold"), "role", "v.*")


@register("m19_cv_regressors")
def q_cv_regressors(spark, sf_dir):
    """Mean MAE over 5 expanding folds for random forest and boosted trees."""
    from ..session import cut_lineage
    f = fe.training_features(src.grid_hourly(spark, sf_dir, n_series=1))
    folds = cut_lineage(ml.fold_positions(f, ["series_id"], "ts"))
    tasks = []
    for i in range(5):
        tr, te = (ml.fold_rows(folds, i, role) for role in ("train", "test"))
        # library defaults of the CV step: 100-tree forest, 100-round boosting (depth 6, step 0.3)
        for name, kind, kw in (("random_forest", "forest", {"numTrees": 100, "maxDepth": 30}),
                               ("gbt", "gbt", {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3})):
            tasks.append(lambda tr=tr, te=te, name=name, kind=kind, kw=kw, i=i: _metric_rows(
                ml.fit_regressor(tr, DEMAND_X, "demand_12h", kind, **kw), te, "demand_12h", name, fold=i))
    rows = _rows_df(spark, _run_parallel(tasks))
    return rows.groupBy("model").agg(F.avg("mae").alias("cv_mae"), F.count(F.lit(1)).alias("folds"))


@register("m20_binary_classifiers")
def q_binary_classifiers(spark, sf_dir):
    """Random forest and boosted trees on the median split label (P15), held-out accuracy."""
    from ..operators.profile import median_split
    sp = _prepared(spark, sf_dir)
    d = median_split(sp, "demand_12h", "y_bin").withColumn("label", F.col("y_bin").cast("double"))
    train, test = _split(d)

    def task(name, kind, kw):
        m = ml.fit_classifier(train, DEMAND_X, "label", kind, **kw)
        return [ml.classification_summary(m.transform(test), "label", "prediction").first().asDict() | {"model": name}]
    # library defaults: 100 trees of unlimited depth (30 is Spark's limit); 100 rounds, depth 6, step 0.3
    specs = (("gbt", "gbt", {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3}),
             ("random_forest", "forest", {"numTrees": 100, "maxDepth": 30}))
    return _rows_df(spark, _run_parallel([lambda s=s: task(*s) for s in specs]))


CLUSTER_X = ["hour_sin", "hour_cos", "demand_lag_1h", "demand_lag_12h", "price_lag_1h", "price_lag_12h", "renewable_pct"]


@register("m21_kmeans_sweep")
def q_kmeans_sweep(spark, sf_dir):
    """KMeans for k = 2..10 (best of 10 seeds) on robust-scaled features,
    squared-Euclidean silhouette over all rows."""
    sp = _prepared(spark, sf_dir)
    sc = ml.robust_scaler(sp, CLUSTER_X)
    from ..session import cut_lineage
    x = cut_lineage(ml.scale(sp, sc).select(*CLUSTER_X))

    def task(k):
        m = ml.kmeans_fit(x, CLUSTER_X, k, seeds=range(10))
        lab = m.transform(ml.assembler(CLUSTER_X).transform(x)).select(*CLUSTER_X, F.col("prediction").alias("cluster"))
        return [(k, ml.silhouette(lab, CLUSTER_X, "cluster"), float(m.summary.trainingCost))]
    rows = _run_parallel([lambda k=k: task(k) for k in range(2, 11)])
    out = spark.createDataFrame(rows, "k int, silhouette double, training_cost double")
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return out.withColumn("best_k", F.lit(best))


@register("m22_cluster_profiles")
def q_cluster_profiles(spark, sf_dir):
    """Standard scale -> PCA (<= 8) -> KMeans(4) -> cluster mean profiles (A1)."""
    sp = _prepared(spark, sf_dir)
    sc = ml.standard_scaler(sp, CLUSTER_X)
    x = ml.scale(sp, sc, suffix="_z")
    z = [c + "_z" for c in CLUSTER_X]
    p = ml.pca_fit(x, z, k=min(8, len(z)), variance=None)
    xp = ml.pca_transform(x, p)
    pcs = [f"pc{i + 1}" for i in range(p["k"])]
    km = ml.kmeans_fit(xp, pcs, 4, seeds=range(1))   # library default: a single k-means++ run
    lab = ml.assign_nearest(xp, [list(c) for c in km.clusterCenters()], pcs)
    return lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"),
                                      *[F.avg(c).alias(c) for c in ("demand_12h", "price_12h", "renewable_pct")])


@register("m23_pca_map")
def q_pca_map(spark, sf_dir):
    """Scaler, PCA and KMeans fitted on all rows; the 2-D map shows a seeded
    sample of at most 3,000 of them (P14)."""
    from ..operators.profile import deterministic_sample
    sp = _prepared(spark, sf_dir)
    s = sp.dropna(subset=CLUSTER_X)
    sc = ml.standard_scaler(s, CLUSTER_X)
    x = ml.scale(s, sc, suffix="_z")
    z = [c + "_z" for c in CLUSTER_X]
    p = ml.pca_fit(x, z, k=2, variance=None)
    xp = ml.pca_transform(x, p)
    km = ml.kmeans_fit(xp, ["pc1", "pc2"], 3, seeds=range(3))
    labelled = ml.assign_nearest(xp, [list(c) for c in km.clusterCenters()], ["pc1", "pc2"])
    return deterministic_sample(labelled, 3000, ["ts"], seed=42).select("ts", "pc1", "pc2", "cluster")


@register("m25_m26_batch_scoring")
def q_batch_scoring(spark, sf_dir):
    """M25 + M26: linear regressors and forest classifiers (300 trees, depth 18)
    of both targets, fitted on the training split, score every request row
    (features from M3) in one batch; the class thresholds are echoed."""
    from ..plans.requests import request_features
    from ..session import cut_lineage
    sp = _prepared(spark, sf_dir)
    d, th = _with_classes(sp, _split(sp)[0])
    train, _ = _split(d)
    feats = ["hour_sin", "hour_cos", "is_weekend", "day_of_week", "demand_lag_1h", "demand_lag_24h",
             "price_lag_1h", "price_lag_24h", "renewable", "fossil", "nuclear", "renewable_pct",
             "demand_avg_24h", "price_avg_24h"]
    models = ml.run_parallel(
        [lambda y=y: ml.fit_regressor(train, feats, y, "linear") for _, y, _ in TARGETS]
        + [lambda t=t: ml.fit_classifier(train, feats, f"{t}_label", "forest") for t, _, _ in TARGETS])
    req = request_features(src.requests_from_events(spark, sf_dir, n_series=1),
                           cut_lineage(src.grid_hourly(spark, sf_dir, n_series=1)))
    scored = req.fillna(0.0, feats)                                  # P17: a null input is 0.0
    for model, out in zip(models, ("y_demand", "y_price", "c_demand", "c_price")):
        scored = model.transform(scored).withColumnRenamed("prediction", out).drop(
            "features", "scaled", "rawPrediction", "probability")
    return scored.select("request_id", F.bround("y_demand", 1).alias("predicted_demand_12h"),
                         F.bround("y_price", 2).alias("predicted_price_12h"),
                         col.class_label(F.col("c_demand").cast("int")).alias("demand_class"),
                         col.class_label(F.col("c_price").cast("int")).alias("price_class"),
                         *[F.lit(v).alias(f"{k}_threshold") for k, v in th.items()])


@register("m31_train_test_check")
def q_train_test_check(spark, sf_dir):
    """Random forest (100 trees, Spark's greatest depth 30) of both targets
    on the 80/20 split; R2, MAE, RMSE and pass if R2 > 0."""
    sp = _prepared(spark, sf_dir)
    train, test = _split(sp)
    tasks = [lambda label=label, feats=feats: _metric_rows(
        ml.fit_regressor(train, feats, label, "forest", numTrees=100, maxDepth=30), test, label, "random_forest")
        for _, label, feats in TARGETS]
    return _rows_df(spark, _run_parallel(tasks)).withColumn("passed", F.col("r2") > 0)
