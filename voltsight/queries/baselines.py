"""Baseline regressors in raw and PCA form (M8-M11) and kNN on scaled features."""

from pyspark.sql import functions as F

from ..catalog import R, register
from ..operators import ml
from ..operators import similarity as sim
from ..operators.pivots import PivotIndex
from ..session import cut_lineage
from .ml_models import TARGETS, _run_parallel, _rows_df
from .models import SPLIT_SQL, _prepared

_K_UNIFORM, _K_WEIGHTED = 5, 20


def _vectors(rows, feats):
    """``id`` (the hour), ``split``, ``v`` (the features) and the targets."""
    return rows.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("id"), "ts", "split", "demand_12h", "price_12h",
                       F.array(*[F.col(f).cast("double") for f in feats]).alias("v"))


def _neighbours(rows, label):
    """Predictions of the test rows from the k nearest training rows, both forms."""
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    index = PivotIndex(train, "id", "v")
    out = test
    for name, k, weighted in (("k5", _K_UNIFORM, False), ("k20_weighted", _K_WEIGHTED, True)):
        p = sim.knn_regress(test, train, "id", "id", "v", label, k, weighted, index=index)
        out = out.join(p.withColumnRenamed("prediction", name), "id")
    return out


def _knn_sql():
    parts, ctes = [], []
    for target, label, feats in TARGETS:
        st = ", ".join(f"quantile_cont({f}, 0.5) AS {f}_m, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) AS {f}_s" for f in feats)
        v = ", ".join(f"({f} - {f}_m) / CASE WHEN {f}_s = 0 THEN 1 ELSE {f}_s END" for f in feats)
        ctes.append(f"""
{target}_st AS (SELECT {st} FROM sp WHERE split = 'train'),
{target}_z AS (SELECT ts, split, {label} AS y, CAST([{v}] AS DOUBLE[]) AS v FROM sp, {target}_st),
{target}_r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY d, nts) AS rank FROM
   (SELECT q.ts, t.ts AS nts, t.y, list_distance(q.v, t.v) AS d FROM {target}_z q JOIN {target}_z t ON q.split = 'test' AND t.split = 'train'))""")
        parts.append(f"""SELECT '{target}' AS target, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  {R(f'avg(y) FILTER (WHERE rank <= {_K_UNIFORM})', 4)} AS k5,
  {R(f'''CASE WHEN max(CAST(d = 0 AS INTEGER)) FILTER (WHERE rank <= {_K_WEIGHTED}) = 1 THEN avg(y) FILTER (WHERE d = 0 AND rank <= {_K_WEIGHTED})
     ELSE sum(y / d) FILTER (WHERE d > 0 AND rank <= {_K_WEIGHTED}) / sum(1.0 / d) FILTER (WHERE d > 0 AND rank <= {_K_WEIGHTED}) END''', 4)} AS k20_weighted
FROM {target}_r GROUP BY ts""")
    return SPLIT_SQL + "," + ",".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


@register("m10_knn_scaled_features", _knn_sql(), digits=4)
def q_knn_scaled(spark, sf_dir):
    """M10 + M5: both targets of every test row from its nearest training rows in the
    robust-scaled feature table: mean of 5, inverse-distance weighted mean of 20."""
    sp, out = _prepared(spark, sf_dir), None
    for target, label, feats in TARGETS:
        scaled = ml.scale(sp, ml.robust_scaler(sp.where(F.col("split") == "train"), feats), suffix="_z")
        rows = cut_lineage(_vectors(scaled, [f + "_z" for f in feats]))
        one = _neighbours(rows, label).select(F.lit(target).alias("target"), "ts", "k5", "k20_weighted")
        out = one if out is None else out.unionByName(one)
    return out


@register("m8_m11_baselines")
def q_baselines(spark, sf_dir):
    """Linear, Bayesian ridge, decision tree (depth 10) and kNN (k = 5) of both
    targets on the features as they are and on the PCA scores (95 % of the variance of
    the robust-scaled features); test-split metrics, 16 rows."""
    sp = _prepared(spark, sf_dir)

    def task(label, feats):
        train = sp.where(F.col("split") == "train")
        z = [f + "_z" for f in feats]
        scaled = ml.scale(sp, ml.robust_scaler(train, feats), suffix="_z")
        fit = ml.component_regressions(scaled.where(F.col("split") == "train"), label, z)
        pcs = [f"pc{i + 1}" for i in range(fit["pca"]["k"])]
        rows = cut_lineage(ml.pca_transform(scaled, fit["pca"]))
        learn, held = (rows.where(F.col("split") == s) for s in ("train", "test"))
        scored = [("linear", "raw", ml.fit_regressor(learn, feats, label, "linear").transform(held)),
                  ("linear", "pca", ml.linear_predict(held, fit["linear"])),
                  ("bayesian_ridge", "raw", ml.linear_predict(held, ml.bayesian_ridge(learn, label, feats))),
                  ("bayesian_ridge", "pca", ml.linear_predict(held, fit["bayesian"]))]
        for form, cols in (("raw", feats), ("pca", pcs)):
            scored.append(("decision_tree", form, ml.fit_regressor(learn, cols, label, "tree", maxDepth=10).transform(held)))
            v = cut_lineage(_vectors(rows, cols))
            near = sim.knn_regress(v.where("split = 'test'"), v.where("split = 'train'"), "id", "id", "v", label, 5,
                                   index=PivotIndex(v.where("split = 'train'"), "id", "v"))
            scored.append(("knn", form, v.join(near, "id")))
        return [ml.regression_metrics(d, label, "prediction").first().asDict() | {"model": m, "form": form, "target": label,
                                                                                 "n_components": len(pcs)} for m, form, d in scored]
    return _rows_df(spark, _run_parallel([lambda label=label, feats=feats: task(label, feats) for _, label, feats in TARGETS]))
