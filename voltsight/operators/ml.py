"""Scaling, splitting, metrics and model fitting.

Everything is a DataFrame aggregation or a ``pyspark.ml`` estimator; the
only driver-side work is solving small d x d systems from aggregated
moments (Gram matrices), whose size depends on the feature count, never on
the row count.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as win
from .moments import centred_moments
from .profile import quantile_row, scalars


# ----------------------------------------------------------------- P13 / M18
def chrono_split_label(df: DataFrame, keys, ts: str, frac: float = 0.8, guard: bool = True,
                       out: str = "split") -> DataFrame:
    """First ``floor(frac * n)`` rows of each series are 'train'.

    With ``guard`` both sides keep at least one row when ``n >= 2``.
    """
    # the length comes with the day table: a join by series would bring a series into one task
    d = win.layout(df, list(keys), ts, length="_n").finish(keep_idx=True)
    cut = F.floor(F.col("_n") * frac)
    if guard:
        cut = F.when(F.col("_n") >= 2, F.least(F.greatest(cut, F.lit(1)), F.col("_n") - 1)).otherwise(cut)
    return d.withColumn(out, F.when(F.col(win.IDX) < cut, "train").otherwise("test")).drop("_n", win.IDX)


def fold_positions(df: DataFrame, keys, ts: str) -> DataFrame:
    """Rows with their position ``_at`` in the series and its length ``_of``;
    every fold of an expanding-window split is a range of positions."""
    return win.layout(df, list(keys), ts, length="_of").finish(keep_idx=True).withColumnRenamed(win.IDX, "_at")


def fold_rows(positions: DataFrame, fold: int, role: str, n_splits: int = 5) -> DataFrame:
    """The ``train`` or ``test`` rows of one fold (scikit-learn's
    ``TimeSeriesSplit``): with ``size = n // (n_splits + 1)``, fold ``i`` tests
    ``size`` rows from ``n - (n_splits - i) * size`` on and trains on all before them.
    A filter over the one table of positions; no row is copied."""
    size = F.floor(F.col("_of") / (n_splits + 1))
    start = F.col("_of") - (n_splits - fold) * size
    within = F.col("_at") < start if role == "train" else (F.col("_at") >= start) & (F.col("_at") < start + size)
    return positions.where(within).drop("_at", "_of")


def fold_segment(n_splits: int = 5):
    """Column 0 for rows that no fold tests, else 1 + the fold that tests the
    row: fold ``i`` trains on the segments up to ``i`` and tests segment ``i + 1``, so
    statistics of all folds add up from one pass over the segments."""
    size = F.floor(F.col("_of") / (n_splits + 1))
    past = F.col("_at") - (F.col("_of") - n_splits * size)
    return F.when(past < 0, 0).when(size > 0, F.floor(past / size) + 1).otherwise(0).cast("int")


def fold_lines(segments: DataFrame, y: str, x: str, n_splits: int = 5) -> list:
    """M8 + M18: ``(slope, intercept)`` of the least-squares line of every fold's
    training rows.  ``segments`` has a column ``segment``; each segment gives its
    centred moments once, which are merged from fold to fold (six small rows)."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    parts = {r.segment: r for r in segments.where(ok).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"),
        F.covar_pop(x, y).alias("cxy")).collect()}
    lines, n, mx, my, sxx, sxy = [], 0, 0.0, 0.0, 0.0, 0.0
    for i in range(n_splits):
        p = parts.get(i)
        if p is not None:
            dx, dy, both = p.mx - mx, p.my - my, n + p.n
            sxx += p.vx * p.n + dx * dx * n * p.n / both
            sxy += p.cxy * p.n + dx * dy * n * p.n / both
            mx, my, n = mx + dx * p.n / both, my + dy * p.n / both, both
        lines.append((sxy / sxx, my - sxy / sxx * mx) if sxx > 0 else (None, None))
    return lines


# ----------------------------------------------------------------- M5 / M6
def robust_scaler(train: DataFrame, cols) -> dict:
    """M5 fit: exact median and IQR per column; zero IQR scales by 1."""
    probs = (.25, .5, .75)
    row = quantile_row(train, {f"{c}__{p}": (c, p) for c in cols for p in probs})
    return {"kind": "robust", "cols": list(cols),
            "stats": row.select(*[F.array(*[F.col(f"`{c}__{p}`") for p in probs]).alias(c) for c in cols])}


def standard_scaler(train: DataFrame, cols) -> dict:
    """M6 fit: mean and population std; zero std scales by 1."""
    aggs = []
    for c in cols:
        aggs.append(F.array(F.avg(c), F.stddev_pop(c)).alias(c))
    return {"kind": "standard", "cols": list(cols), "stats": train.agg(*aggs)}


def fitted_stats(scaler: dict) -> dict:
    """Materialise a scaler's per-column statistics (d small vectors), as a
    fitted scaler model holds them; computed once, reused by every apply."""
    if "values" not in scaler:
        row = scaler["stats"].first()
        vals = {}
        for c in scaler["cols"]:
            s = row[c]
            if scaler["kind"] == "robust":
                center, spread = s[1], None if s[1] is None else s[2] - s[0]
            else:
                center, spread = s[0], s[1]
            vals[c] = (None if center is None else float(center), 1.0 if (spread is None or spread == 0) else float(spread))
        scaler["values"] = vals
    return scaler["values"]


def scale(df: DataFrame, scaler: dict, suffix: str = "") -> DataFrame:
    """Apply a fitted scaler: ``(x - center) / spread`` with literal statistics; null
    for a column that had no value to fit on."""
    vals = fitted_stats(scaler)
    return df.withColumns({c + suffix: (F.col(c) - F.lit(vals[c][0]).cast("double")) / F.lit(vals[c][1]) for c in scaler["cols"]})


# ----------------------------------------------------------------- A15-A17
def regression_metrics(df: DataFrame, y: str, p: str, keys=()) -> DataFrame:
    """R2, MAE, RMSE, MAPE (%), NMAE = MAE/mean(y), NRMSE = RMSE/mean(y).

    One aggregation: SSres, |err|, y moments.  MAPE divides by
    ``max(|y|, eps)`` as scikit-learn does.
    """
    err = F.col(y) - F.col(p)
    eps = float(np.finfo(np.float64).eps)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(err * err).alias("_ssr"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(err) / F.greatest(F.abs(F.col(y)), F.lit(eps))) * 100.0).alias("mape"),
        F.avg(y).alias("_ybar"))
    r2 = F.when(F.col("_sst") == 0, F.lit(None).cast("double")).otherwise(1 - F.col("_ssr") / F.col("_sst"))
    return agg.select(*keys, "n", r2.alias("r2"), "mae", "rmse", "mape",
                      F.try_divide(F.col("mae"), F.col("_ybar")).alias("nmae"),
                      F.try_divide(F.col("rmse"), F.col("_ybar")).alias("nrmse"))


def classification_report(df: DataFrame, label: str, pred: str, keys=()) -> DataFrame:
    """Per-class precision / recall / F1 / support (0 on zero division)."""
    keys = list(keys)
    cm = df.groupBy(*keys, label, pred).agg(F.count(F.lit(1)).alias("_c"))
    tp = cm.where(F.col(label) == F.col(pred)).groupBy(*keys, F.col(label).alias("cls")).agg(F.sum("_c").alias("tp"))
    sup = cm.groupBy(*keys, F.col(label).alias("cls")).agg(F.sum("_c").alias("support"))
    prd = cm.groupBy(*keys, F.col(pred).alias("cls")).agg(F.sum("_c").alias("predicted"))
    r = sup.join(prd, on=keys + ["cls"], how="full").join(tp, on=keys + ["cls"], how="left").fillna(
        0, subset=["tp", "support", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    r = r.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return r.withColumn("f1", f1).select(*keys, "cls", "precision", "recall", "f1", F.col("support").cast("bigint"))


def classification_summary(df: DataFrame, label: str, pred: str, keys=()) -> DataFrame:
    """Accuracy, macro F1, weighted F1."""
    keys = list(keys)
    rep = classification_report(df, label, pred, keys)
    acc = df.groupBy(*keys).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))
    f = rep.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return acc.join(f, on=keys, how="inner") if keys else acc.withColumns(
        {"macro_f1": scalars(f)["macro_f1"], "weighted_f1": scalars(f)["weighted_f1"]})


def generalisation(metrics_by_split: DataFrame, keys, penalty: float = 0.5) -> DataFrame:
    """Pivot train/test R2 -> gap and ``test_r2 - penalty * gap``."""
    keys = list(keys)
    p = metrics_by_split.groupBy(*keys).pivot("split", ["train", "test"]).agg(
        F.first("r2").alias("r2"), F.first("nmae").alias("nmae"))
    p = p.select(*keys, F.col("train_r2"), F.col("test_r2"), F.col("train_nmae"), F.col("test_nmae"))
    gap = F.col("train_r2") - F.col("test_r2")
    return p.withColumn("gap_r2", gap).withColumn("gen_score", F.col("test_r2") - penalty * gap)


def minmax_normalise(df: DataFrame, col: str, out: str, invert: bool = False) -> DataFrame:
    """0-1 min-max over a small metrics table; constant -> 0."""
    w = Window.partitionBy()
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    v = F.when(hi == lo, F.lit(0.0)).otherwise((F.col(col) - lo) / (hi - lo))
    return df.withColumn(out, (1 - v) if invert else v)


# ----------------------------------------------------------------- M8 / M9
def fit_linear_1d(train: DataFrame, y: str, x: str, keys=()) -> DataFrame:
    """M8 (single feature): closed-form OLS by ``regr_slope/regr_intercept``."""
    return train.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def bayesian_ridge(df: DataFrame, y: str, features, n_iter: int = 300, tol: float = 1e-3) -> dict:
    """M9: Bayesian ridge by evidence maximisation (MacKay updates).

    Centred moments from one distributed aggregation; the d x d
    fixed-point iteration runs on the driver.  Priors as scikit-learn's
    defaults (all 1e-6).
    """
    return ridge_of(centred_moments(df, [*features, y]), features, n_iter, tol)


def ridge_of(m, features, n_iter: int = 300, tol: float = 1e-3) -> dict:
    """Bayesian ridge from the moments of ``[*features, target]``."""
    n, mx, my = m.n, m.mean[:-1], m.mean[-1]
    C, c, syy = m.comoment[:-1, :-1], m.comoment[:-1, -1], m.comoment[-1, -1]
    a1 = a2 = l1 = l2 = 1e-6
    alpha, lam = 1.0 / max(syy / n, 1e-12), 1.0
    evals, evecs = np.linalg.eigh(C)
    coef = np.zeros(len(features))
    for _ in range(n_iter):
        A = C * alpha + np.eye(len(features)) * lam
        new = np.linalg.solve(A, alpha * c)
        rss = syy - 2 * new @ c + new @ C @ new
        gamma = np.sum(alpha * evals / (lam + alpha * evals))
        lam = (gamma + 2 * l1) / (new @ new + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (max(rss, 0.0) + 2 * a2)
        if np.sum(np.abs(new - coef)) < tol:
            coef = new
            break
        coef = new
    return {"coef": coef.tolist(), "intercept": float(my - mx @ coef), "alpha": float(alpha), "lambda": float(lam),
            "features": list(features)}


def linear_predict(df: DataFrame, model: dict, out: str = "prediction") -> DataFrame:
    expr = F.lit(model["intercept"])
    for f, w in zip(model["features"], model["coef"]):
        expr = expr + F.col(f) * F.lit(float(w))
    return df.withColumn(out, expr)


# ----------------------------------------------------------------- Spark ML
def assembler(features, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip")


def regressor(kind: str, label: str, **kw):
    """Spark ML regressors (linear, tree, forest, boosted trees)."""
    from pyspark.ml import regression as R
    common = dict(featuresCol="features", labelCol=label, predictionCol="prediction")
    if kind == "linear":
        return R.LinearRegression(solver="normal", regParam=0.0, **common)
    if kind == "tree":
        return R.DecisionTreeRegressor(maxDepth=kw.get("maxDepth", 10), seed=42, **common)
    if kind == "forest":
        return R.RandomForestRegressor(numTrees=kw.get("numTrees", 200), maxDepth=kw.get("maxDepth", 20),
                                       minInstancesPerNode=kw.get("minInstancesPerNode", 1),
                                       featureSubsetStrategy=kw.get("featureSubsetStrategy", "auto"),
                                       seed=42, **common)
    if kind == "gbt":
        return R.GBTRegressor(maxIter=kw.get("maxIter", 300), maxDepth=kw.get("maxDepth", 6),
                              stepSize=kw.get("stepSize", 0.03), subsamplingRate=kw.get("subsamplingRate", 1.0),
                              featureSubsetStrategy=kw.get("featureSubsetStrategy", "all"),
                              minInstancesPerNode=kw.get("minInstancesPerNode", 1), seed=42, **common)
    raise ValueError(kind)


def fit_regressor(train: DataFrame, features, label: str, kind: str, **kw):
    return Pipeline(stages=[assembler(features), regressor(kind, label, **kw)]).fit(train)


def classifier(kind: str, label: str, n_features: int | None = None, **kw):
    """Spark ML classifiers (label = 0/1/2 class code)."""
    from pyspark.ml import classification as Cl
    common = dict(featuresCol="scaled", labelCol=label, predictionCol="prediction")
    if kind == "forest":
        return Cl.RandomForestClassifier(numTrees=kw.get("numTrees", 300), maxDepth=kw.get("maxDepth", 18),
                                        seed=42, **common)
    if kind == "gbt_ovr":
        base = Cl.GBTClassifier(maxIter=kw.get("maxIter", 300), maxDepth=kw.get("maxDepth", 6),
                                stepSize=kw.get("stepSize", 0.05), seed=42)
        return Cl.OneVsRest(classifier=base, parallelism=kw.get("n_classes", 3), **common)
    if kind == "gbt":
        return Cl.GBTClassifier(maxIter=kw.get("maxIter", 100), maxDepth=kw.get("maxDepth", 6),
                                stepSize=kw.get("stepSize", 0.3), seed=42, **common)
    if kind == "mlp":
        layers = [n_features, 128, 64, 32, kw.get("n_classes", 3)]
        return Cl.MultilayerPerceptronClassifier(layers=layers, maxIter=kw.get("maxIter", 200), seed=42, **common)
    raise ValueError(kind)


def fit_classifier(train: DataFrame, features, label: str, kind: str, **kw):
    """Pipeline: assemble -> standard scale (population-free Spark scaler) -> classifier."""
    from pyspark.ml.feature import StandardScaler
    stages = [assembler(features), StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
              classifier(kind, label, n_features=len(features), **kw)]
    return Pipeline(stages=stages).fit(train)


def fit_clusters(df: DataFrame, features, k: int, seed: int = 42):
    """Pipeline assemble -> robust scale (median, IQR) -> KMeans; ``prediction``
    is the number of the nearest centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import RobustScaler
    return Pipeline(stages=[assembler(features),
                            RobustScaler(inputCol="features", outputCol="scaled", withCentering=True, withScaling=True),
                            KMeans(k=k, seed=seed, maxIter=100, featuresCol="scaled", predictionCol="prediction")]).fit(df)


def run_parallel(tasks, parallelism: int = 8) -> list:
    """Run independent fits as concurrent Spark jobs (as ``CrossValidator``'s
    ``parallelism`` does); the results in the order of the tasks."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(lambda t: t(), tasks))


def pca_fit(df: DataFrame, features, k: int | None = None, variance: float | None = 0.95) -> dict:
    """M7: centred PCA from the covariance matrix of one pass of centred moments.

    Keeps the smallest k whose cumulative explained ratio exceeds
    ``variance`` (or a fixed k); component signs are fixed so the largest
    absolute loading is positive.
    """
    return pca_of(centred_moments(df, features), features, k, variance)


def pca_of(m, features, k: int | None = None, variance: float | None = 0.95) -> dict:
    """PCA from the moments of ``features``."""
    mean, cov = m.mean, m.covariance()
    evals, evecs = np.linalg.eigh(cov)
    order = np.argsort(evals)[::-1]
    evals, evecs = evals[order], evecs[:, order]
    ratio = evals / evals.sum() if evals.sum() > 0 else np.zeros_like(evals)
    if k is None:
        k = int(np.searchsorted(np.cumsum(ratio), variance, side="right") + 1)
        k = min(k, len(features))
    comps = evecs[:, :k].T
    for i in range(k):
        if comps[i][np.argmax(np.abs(comps[i]))] < 0:
            comps[i] = -comps[i]
    return {"mean": mean.tolist(), "components": comps.tolist(), "explained_ratio": ratio[:k].tolist(),
            "features": list(features), "k": k}


def component_regressions(df: DataFrame, y: str, features, k: int | None = None, variance: float | None = 0.95) -> dict:
    """M8 + M9 on PCA scores: ``pca``, and ``linear`` and ``bayesian`` models of ``y`` on
    its scores, written in terms of ``features`` for ``linear_predict``.

    One pass of moments over features and target gives all three: the moments of the
    scores are the rotated ones, so no score is computed to fit them."""
    m, d = centred_moments(df, [*features, y]), len(features)
    p = pca_of(type(m)(m.n, m.mean[:d], m.block(range(d))), features, k, variance)
    comps = np.array(p["components"])
    w = np.zeros((p["k"] + 1, d + 1))
    w[:-1, :-1], w[-1, -1] = comps, 1.0
    r = m.projected(w)
    spread = np.diag(r.comoment)[:-1]
    slopes = np.divide(r.comoment[:-1, -1], spread, out=np.zeros_like(spread), where=spread > 1e-12 * max(spread.max(), 1e-300))
    bayes = ridge_of(r, [f"pc{i + 1}" for i in range(p["k"])])

    def on_features(coef, intercept):
        return {"coef": (comps.T @ coef).tolist(), "intercept": float(intercept), "features": list(features)}
    return {"pca": p, "linear": on_features(slopes, r.mean[-1] - r.mean[:-1] @ slopes),
            "bayesian": on_features(np.array(bayes["coef"]), bayes["intercept"]) | {"alpha": bayes["alpha"], "lambda": bayes["lambda"]}}


def pca_transform(df: DataFrame, model: dict, prefix: str = "pc") -> DataFrame:
    cols = {}
    for i, comp in enumerate(model["components"]):
        e = F.lit(0.0)
        for f, m, w in zip(model["features"], model["mean"], comp):
            e = e + (F.col(f) - F.lit(m)) * F.lit(float(w))
        cols[f"{prefix}{i + 1}"] = e
    return df.withColumns(cols)


def kmeans_fit(df: DataFrame, features, k: int, seeds=range(10), max_iter: int = 100):
    """Best-of-``seeds`` KMeans by training cost (n_init analogue)."""
    from pyspark.ml.clustering import KMeans
    data = assembler(features).transform(df).select("features")
    best = None
    for s in seeds:
        m = KMeans(k=k, seed=int(s), maxIter=max_iter, featuresCol="features").fit(data)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m)
    return best[1]


def assign_nearest(df: DataFrame, centres, features, out: str = "cluster") -> DataFrame:
    """Arg-min squared Euclidean distance to the k centres of a model.

    ``centres`` is the model's k x d list (as ``KMeansModel.clusterCenters``):
    it is part of the fitted model, so it enters the plan as literals - no
    join and no per-row Python.  Ties go to the lower cluster index.
    """
    if not len(centres):
        raise ValueError("no centre to assign to")
    x = F.array(*[F.col(f).cast("double") for f in features])
    dists = []
    for ci, c in enumerate(centres):
        steps = F.zip_with(x, F.lit([float(v) for v in c]), lambda p, q: (p - q) * (p - q))
        dists.append(F.struct(F.aggregate(steps, F.lit(0.0), lambda t, v: t + v).alias("d"), F.lit(ci).alias("cluster")))
    return df.withColumn(out, F.array_min(F.array(*dists))["cluster"])


def silhouette(df: DataFrame, features, label: str) -> float:
    """Squared-Euclidean silhouette over all rows (linear in the rows:
    Spark evaluates it from per-cluster sums)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol="features", predictionCol=label, distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(assembler(features).transform(df)))


def ks_drift(rows: DataFrame, cols, split: str = "split") -> DataFrame:
    """``column_name, ks`` - the two-sample Kolmogorov-Smirnov statistic
    of every column, ``train`` against ``test`` rows.

    The columns go through one unpivoted pass: counts per (column, value) and
    side (partial aggregation), running CDFs over the distinct values, greatest
    gap.  Nulls are ignored; a column without values on one side has a null.
    """
    values = rows.select(split, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [split], list(cols), "column_name", "v").where("v IS NOT NULL")
    cnt = values.groupBy("column_name", "v").agg(F.count_if(F.col(split) == "train").alias("c0"),
                                                 F.count_if(F.col(split) == "test").alias("c1"))
    # one row per column
    tot = F.broadcast(cnt.groupBy("column_name").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1")))
    cum = win.running_sums(cnt, ["column_name"], "v", ["c0", "c1"]).join(tot, "column_name")
    gap = F.try_divide("cum_c0", "n0") - F.try_divide("cum_c1", "n1")
    return cum.groupBy("column_name").agg(F.max(F.abs(gap)).alias("ks"))


def drift_verdict(rows: DataFrame, cols, below: float, split: str = "split") -> DataFrame:
    """``column_name, ks, passed`` (the statistic is less than ``below``)."""
    return ks_drift(rows, cols, split).withColumn("passed", F.col("ks") < F.lit(below))
