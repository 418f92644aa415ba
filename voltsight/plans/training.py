"""End-to-end training job (M35): features -> CV regressors -> classifiers ->
clustering -> rules -> metadata.  Models, scaler, components, centres, feature
lists and cluster profiles are saved under ``out_dir``.  Returns the metadata
table (one row per metric)."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import ml
from ..operators import profile as pr
from ..operators import rules as ru
from ..session import cut_lineage
from ..sources import artifacts as art
from ..sources import tables as src
from . import features as fe


def run_training_job(spark: SparkSession, sf_dir: str, out_dir: str):
    grid = src.grid_hourly(spark, sf_dir, n_series=1)
    f = cut_lineage(fe.training_features(grid).where(pr.finite("demand_12h")))       # S1, P8
    x = pr.auto_feature_matrix(f)                                                      # P7
    feats = [c for c in x.columns if c not in ("series_id",)]
    data = cut_lineage(f.select("ts", "series_id", "demand_12h", *[F.col(c) for c in feats if c in f.columns]))
    folds = cut_lineage(ml.fold_positions(data, ["series_id"], "ts"))                  # M18
    # library defaults: 100 trees of unlimited depth (30 is Spark's limit); 100 rounds, depth 6, step 0.3
    kinds = {"rf": ("forest", {"numTrees": 100, "maxDepth": 30}), "gbt": ("gbt", {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3})}

    def cv(name, i):                                                                    # M19
        tr, te = (ml.fold_rows(folds, i, role) for role in ("train", "test"))
        kind, kw = kinds[name]
        m = ml.fit_regressor(tr, feats, "demand_12h", kind, **kw)
        if i == 4:                                           # the fold with the longest history
            art.save_model(m, os.path.join(out_dir, f"regressor_{name}"))               # S8
        return name, ml.regression_metrics(m.transform(te), "demand_12h", "prediction").first()["mae"]

    maes = ml.run_parallel([lambda n=n, i=i: cv(n, i) for i in reversed(range(5)) for n in kinds])
    scored = {n: [v for k, v in maes if k == n and v is not None] for n in kinds}      # a fold may hold no complete row
    rows = [(f"cv_mae_{n}", sum(v) / len(v) if v else None) for n, v in scored.items()]
    split = ml.chrono_split_label(data, ["series_id"], "ts")
    lab = cut_lineage(pr.median_split(split, "demand_12h", "label").withColumn("label", F.col("label").cast("double")))
    train = lab.where(F.col("split") == "train")
    test = lab.where(F.col("split") == "test")

    def classify(name):                                                                 # M20
        kind, kw = kinds[name]
        m = ml.fit_classifier(train, feats, "label", kind, **kw)
        art.save_model(m, os.path.join(out_dir, f"classifier_{name}"))
        return f"accuracy_{name}", ml.classification_summary(m.transform(test), "label", "prediction").first()["accuracy"]

    rows += ml.run_parallel([lambda n=n: classify(n) for n in kinds])
    sc = ml.standard_scaler(data, feats)                                                # M22
    z = ml.scale(data, sc, suffix="_z")
    zc = [c + "_z" for c in feats]
    p = ml.pca_fit(z, zc, k=min(8, len(zc)), variance=None)
    zp = ml.pca_transform(z, p)
    pcs = [f"pc{i + 1}" for i in range(p["k"])]
    km = ml.kmeans_fit(zp, pcs, 4, seeds=range(1))
    rows.append(("kmeans_cost", float(km.summary.trainingCost)))
    art.save_model(km, os.path.join(out_dir, "kmeans"))
    profiles = ml.assign_nearest(zp, [list(c) for c in km.clusterCenters()], pcs).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in feats])
    art.write_csv(profiles, os.path.join(out_dir, "cluster_profiles"))                  # S6
    rules = ru.association_rules(ru.frequent_itemsets(ru.transactions(grid)))          # R1-R3
    rows.append(("n_rules", float(rules.count())))
    kept = {"scaler": ml.fitted_stats(sc), "pca": p, "demand_features": feats, "price_features": feats,
            "reg_demand_features": feats, "reg_price_features": feats}
    art.write_json(spark.createDataFrame([(k, json.dumps(v)) for k, v in kept.items()], "artifact string, content string"),
                   os.path.join(out_dir, "parameters"))
    meta = spark.createDataFrame(rows, "artifact string, value double")
    art.write_json(meta, os.path.join(out_dir, "metadata"))                             # S7
    return meta
