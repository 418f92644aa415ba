"""Queries over trained and stored models (M24-M30, A17, A18, M18 by macro F1).

The registry is trained once per session and data folder and lies under the shared
checkpoint folder.  Estimator predictions have no SQL form: tests recompute the rest
of each chain plainly from the stored models' predictions.  The expanding-window
macro F1 of the closed-form class baselines has its SQL.
"""

import os

from pyspark.sql import functions as F

from ..catalog import R, register
from ..functions import columns as col
from ..operators import ml
from ..operators.profile import scalars
from ..plans import features as fe
from ..plans import recommend as rc
from ..plans import registry as rg
from ..plans.requests import request_features
from ..session import cut_lineage
from ..sources import artifacts as art
from ..sources import tables as src
from ..streaming.jobs import run_dir
from .models import SPLIT_SQL

#: model inputs that request rows have too
INPUTS = ["hour_sin", "hour_cos", "is_weekend", "day_of_week", "demand_lag_1h", "demand_lag_24h", "price_lag_1h",
          "price_lag_24h", "renewable", "fossil", "nuclear", "renewable_pct", "demand_avg_24h", "price_avg_24h"]
CLUSTER_INPUTS = ["hour_sin", "hour_cos", "renewable_pct", "demand_lag_1h", "price_lag_1h"]
TARGETS = (("demand", "demand_12h", INPUTS), ("price", "price_12h", INPUTS))
REGRESSORS = {"linear": ("linear", {}), "decision_tree": ("tree", {"maxDepth": 10}),
              "random_forest": ("forest", {"numTrees": 200, "maxDepth": 20})}
CLASSIFIERS = {"random_forest": ("forest", {"numTrees": 300, "maxDepth": 18}), "mlp": ("mlp", {"maxIter": 200})}
_TRAINED: dict = {}


def _split_features(spark, sf_dir):
    f = fe.training_features(src.grid_hourly(spark, sf_dir, n_series=1))
    return cut_lineage(ml.chrono_split_label(f, ["series_id"], "ts", guard=False))


def trained(spark, sf_dir, regressors=None, classifiers=None):
    """``(split feature rows, registry)``; trained at the first call of a session."""
    key = (spark.sparkContext.applicationId, sf_dir, str(regressors), str(classifiers))
    if key not in _TRAINED:
        split = _split_features(spark, sf_dir)
        path = rg.train_registry(split, TARGETS, regressors or REGRESSORS, classifiers or CLASSIFIERS, CLUSTER_INPUTS,
                                 os.path.join(run_dir(spark, "registry"), "models"), parallelism=8)
        _TRAINED[key] = split, path
    split, path = _TRAINED[key]
    return split, rg.Registry(spark, path)


def chosen(registry):
    """The best stored regressor and classifier of each target."""
    return tuple({r.target: r["name"] for r in best(registry.manifest).collect()}
                 for best in (rg.best_regressors, rg.best_classifiers))


def profiles(spark, sf_dir, registry=None):
    """Stored profiles of the test split: trained predictions and cluster, the
    classes of what was observed, calendar and mix."""
    split, own = trained(spark, sf_dir)
    registry = registry or own
    scored = registry.score(split.where(F.col("split") == "test"), *chosen(registry))
    bounds = {t: registry.bounds(t) for t, _, _ in TARGETS}
    seen = rg.with_classes(scored, TARGETS, bounds)
    return seen.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("profile_id"), "ts", "pred_demand", "pred_price",
                       F.col("demand_label").cast("int").alias("demand_class_enc"),
                       F.col("price_label").cast("int").alias("price_class_enc"), "cluster",
                       "hour_sin", "hour_cos", "month_sin", "month_cos", "renewable_pct", "is_weekend")


def requests(spark, sf_dir):
    return request_features(src.requests_from_events(spark, sf_dir, n_series=1),
                            cut_lineage(src.grid_hourly(spark, sf_dir, n_series=1)))


@register("m25_predictions_of_all_models")
def q_predict_all(spark, sf_dir):
    """Every stored regressor of both targets over every request, in one pass."""
    _, reg = trained(spark, sf_dir)
    names = [f"{t}_{n}" for t, _, _ in TARGETS for n in reg.names("regressor", t)]
    return reg.predict_all(requests(spark, sf_dir)).select("request_id", *names)


@register("m29_profiles_trained")
def q_profiles(spark, sf_dir):
    """M29 + M24: the profile table from stored models, KMeans cluster included."""
    return profiles(spark, sf_dir)


@register("m28_recommend_by_index_trained")
def q_by_index(spark, sf_dir):
    """Neighbours of every stored profile among the others, vote and advice."""
    return rc.recommend_by_index(cut_lineage(profiles(spark, sf_dir)), "profile_id", 5)


@register("m27_recommend_trained")
def q_recommend(spark, sf_dir):
    """Request -> features -> best stored regressors, classifiers and KMeans ->
    profile vector -> exact cosine top 5 of the stored profiles -> vote -> advice."""
    _, reg = trained(spark, sf_dir)
    q = cut_lineage(reg.score(requests(spark, sf_dir), *chosen(reg)).select(
        "request_id", "pred_demand", "pred_price", "demand_class_enc", "price_class_enc", "cluster",
        "hour_sin", "hour_cos", "month_sin", "month_cos", "renewable_pct", "is_weekend"))
    r = rc.recommend_from_queries(q, cut_lineage(profiles(spark, sf_dir, reg)), "request_id", "profile_id", 5)
    return r.join(q.select("request_id", F.bround("pred_demand", 1).alias("predicted_demand_12h"),
                           F.bround("pred_price", 2).alias("predicted_price_12h"), "cluster"), "request_id")


@register("m30_trained_comparison")
def q_comparison(spark, sf_dir):
    """M30 + A17: all stored regressors by test R2 and NMAE of both targets, ranked."""
    return rg.comparison(trained(spark, sf_dir)[1].manifest)


@register("a18_best_trained_models")
def q_best(spark, sf_dir):
    """Best stored regressor by generalisation score, best classifier by
    cross-validated macro F1 (else test macro F1), per target."""
    m = trained(spark, sf_dir)[1].manifest
    return rg.best_regressors(m).withColumn("role", F.lit("regressor")).unionByName(
        rg.best_classifiers(m).withColumn("role", F.lit("classifier")))


@register("s12_log_by_task")
def q_log_by_task(spark, sf_dir):
    """Run log by task of all stored models, written as JSON, read back and
    flattened to one row per model and metric, with the best-model summary rows."""
    _, reg = trained(spark, sf_dir)
    path = art.write_json(rg.experiment_log(reg.manifest), os.path.join(run_dir(spark, "task-log"), "log"))
    log = spark.read.schema("task string, model string, target string, metrics map<string,double>").json(path)
    best = art.write_csv(rg.summary_rows(reg.manifest), os.path.join(run_dir(spark, "task-log"), "summary"))
    summary = art.read_csv(spark, best, "section string, task string, model string")
    rows = log.select(F.lit("trained_model").alias("section"), "task", "model", "target", F.explode("metrics").alias("metric", "value"))
    return rows.unionByName(summary, allowMissingColumns=True)


@register("a21_inventory_of_stored_models")
def q_inventory(spark, sf_dir):
    """Counted from the stored artifacts: models per role, distinct input
    features, stored profiles, clusters."""
    _, reg = trained(spark, sf_dir)
    m = reg.manifest
    feats = m.select(F.explode("features").alias("f")).agg(F.count_distinct("f").alias("n_features"))
    n = m.agg(F.count_if(F.col("role") == "regressor").alias("n_regressors"), F.count_if(F.col("role") == "classifier").alias("n_classifiers"),
              F.max(F.when(F.col("role") == "cluster", F.col("params")["k"])).cast("int").alias("n_clusters"))
    stored = profiles(spark, sf_dir, reg).agg(F.count(F.lit(1)).alias("n_profiles"))
    return n.select("*", scalars(feats)["n_features"].alias("n_features"), scalars(stored)["n_profiles"].alias("n_profiles"))


# -------------------------------------------------- M18: macro F1 over expanding windows
_BASE = {"demand": ("demand_12h", "demand_lag_24h"), "price": ("price_12h", "price_lag_24h")}


def _cv_sql(target):
    y, x = _BASE[target]
    label, low, high = f"{target}_v", f"{target[0]}33", f"{target[0]}66"

    def cls(v):
        return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= {low} THEN 0 WHEN {v} <= {high} THEN 1 ELSE 2 END"
    return f"""
{label} AS (SELECT fold, regr_slope({y}, {x}) AS s, regr_intercept({y}, {x}) AS i FROM fr WHERE role = 'train' GROUP BY 1),
{target}_c AS (SELECT 'persistence' AS model, '{target}' AS target, fold, {cls(y)} AS label, {cls(x)} AS pred FROM fr, th WHERE role = 'test'
   UNION ALL SELECT 'linear_1d', '{target}', fr.fold, {cls(y)}, {cls(f'({x} * s + i)')} FROM fr JOIN {label} USING (fold), th WHERE role = 'test'
   UNION ALL SELECT 'persistence', '{target}', 5, {cls(y)}, {cls(x)} FROM sp, th WHERE split = 'test'
   UNION ALL SELECT 'linear_1d', '{target}', 5, {cls(y)}, {cls(f'({x} * s + i)')} FROM sp,
       (SELECT regr_slope({y}, {x}) AS s, regr_intercept({y}, {x}) AS i FROM sp WHERE split = 'train'), th WHERE split = 'test')"""


CV_SQL = SPLIT_SQL + """
, th AS (SELECT quantile_cont(demand_12h, 0.33) AS d33, quantile_cont(demand_12h, 0.66) AS d66,
                quantile_cont(price_12h, 0.33) AS p33, quantile_cont(price_12h, 0.66) AS p66 FROM sp WHERE split = 'train'),
tn AS (SELECT * EXCLUDE (cnt), count(*) OVER () AS c FROM sp WHERE split = 'train'),
fr AS (SELECT * FROM (SELECT *, CASE WHEN idx < c - (5 - fold) * (c // 6) THEN 'train'
         WHEN idx < c - (5 - fold) * (c // 6) + c // 6 THEN 'test' END AS role
       FROM tn, (SELECT unnest(range(0, 5)) AS fold)) WHERE role IS NOT NULL),
""" + ",".join(_cv_sql(t) for t in _BASE) + """,
al AS (SELECT * FROM (SELECT * FROM demand_c UNION ALL SELECT * FROM price_c) WHERE label IS NOT NULL AND pred IS NOT NULL),
seen AS (SELECT DISTINCT model, target, fold, cls FROM (SELECT model, target, fold, label AS cls FROM al UNION ALL SELECT model, target, fold, pred FROM al)),
cm AS (SELECT seen.model, seen.target, seen.fold, cls, count_if(label = cls AND pred = cls) AS tp, count_if(label = cls) AS s, count_if(pred = cls) AS p
       FROM seen JOIN al ON al.model = seen.model AND al.target = seen.target AND al.fold = seen.fold GROUP BY 1, 2, 3, 4),
f1 AS (SELECT model, target, fold, avg(2.0 * tp / (s + p)) AS f1 FROM cm GROUP BY 1, 2, 3),
cv AS (SELECT model, target, avg(f1) FILTER (WHERE fold < 5) AS cv_macro_f1, count_if(fold < 5) AS folds,
              max(f1) FILTER (WHERE fold = 5) AS test_macro_f1 FROM f1 GROUP BY 1, 2)
"""


def _cv_baselines(spark, sf_dir):
    split = _split_features(spark, sf_dir)
    bounds = rg.class_bounds(split.where(F.col("split") == "train"), TARGETS)
    train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
    seg = cut_lineage(ml.fold_positions(train, ["series_id"], "ts").withColumn("segment", ml.fold_segment()))
    parts = []
    for target, (y, x) in _BASE.items():
        cut = [F.lit(bounds[target][n]).cast("double") for n in rg.CLASS_BOUNDS]
        lines = ml.fold_lines(seg, y, x)
        whole = train.agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i")).first()
        folds = seg.where("segment > 0").withColumn("fold", F.col("segment") - 1)
        line = F.coalesce(*[F.when(F.col("fold") == i, F.col(x) * F.lit(s).cast("double") + F.lit(b).cast("double")) for i, (s, b) in enumerate(lines)])
        for rows, fitted in ((folds, line), (test.withColumn("fold", F.lit(5)), F.col(x) * F.lit(whole.s).cast("double") + F.lit(whole.i).cast("double"))):
            for name, value in (("persistence", F.col(x)), ("linear_1d", fitted)):
                parts.append(rows.select(F.lit(name).alias("model"), F.lit(target).alias("target"), "fold",
                                         col.class_code(col.three_class(y, *cut)).alias("label"), value.alias("_v")).where(
                    "_v IS NOT NULL").select(
                    "model", "target", "fold", "label", col.class_code(col.three_class("_v", *cut)).alias("pred")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    f1 = ml.classification_summary(rows.dropna(subset=["label", "pred"]), "label", "pred", ["model", "target", "fold"])
    held = F.col("fold") == 5
    return f1.groupBy("model", "target").agg(F.avg(F.when(~held, F.col("macro_f1"))).alias("cv_macro_f1"),
                                             F.count_if(~held).alias("folds"),
                                             F.max(F.when(held, F.col("macro_f1"))).alias("test_macro_f1"))


@register("m18_cv_macro_f1", CV_SQL + f"""
SELECT model, target, {R('cv_macro_f1')} AS cv_macro_f1, CAST(folds AS BIGINT) AS folds, {R('test_macro_f1')} AS test_macro_f1 FROM cv
""")
def q_cv_macro_f1(spark, sf_dir):
    """M18 + M17: mean macro F1 over five expanding windows of the training split of
    the class baselines (regression or persistence, then class bounds), and on the
    test split; the fold lines come from one pass over six segments."""
    return _cv_baselines(spark, sf_dir)


@register("a18_best_by_cv", CV_SQL + f"""
SELECT target, arg_max(model, struct_pack(s := coalesce(cv_macro_f1, test_macro_f1), m := model)) AS best_model,
       {R('max(coalesce(cv_macro_f1, test_macro_f1))')} AS score FROM cv GROUP BY 1
""")
def q_best_by_cv(spark, sf_dir):
    """Best class model per target by CV score, else by macro F1."""
    score = F.coalesce("cv_macro_f1", "test_macro_f1")
    return _cv_baselines(spark, sf_dir).groupBy("target").agg(
        F.max_by("model", F.struct(score, "model")).alias("best_model"), F.max(score).alias("score"))
