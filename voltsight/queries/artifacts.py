"""Artifact round trips (S6-S9, S11, S12), inventory counts (A21) and the
end-to-end training job (M35)."""

import os

from pyspark.sql import functions as F

from ..catalog import R, register
from ..sources import artifacts as art
from ..streaming.jobs import run_dir
from . import models as mq
from . import rules as rq
from .recommend import PROFILE_SQL, profiles


@register("s6_rules_csv_roundtrip", rq.TX_SQL + f"SELECT {rq._RULE_COLS} FROM rules")
def q_rules_csv(spark, sf_dir):
    """Rules written as CSV (sorted item text) and read back with a schema."""
    from ..operators import rules as ru
    r = ru.association_rules(ru.frequent_itemsets(rq._tx(spark, sf_dir)))
    path = art.write_csv(r, os.path.join(run_dir(spark, "rules-csv"), "rules"))
    schema = ("antecedents string, consequents string, antecedent_support double, consequent_support double, "
              "support double, confidence double, lift double, leverage double, conviction double, zhangs_metric double")
    return art.read_csv(spark, path, schema)


@register("s7_metrics_json_roundtrip", mq.PRED_SQL + f"""
SELECT model, target, split, n, {R('r2')} AS r2, {R('mae')} AS mae, {R('rmse')} AS rmse, {R('mape')} AS mape,
       {R('nmae')} AS nmae, {R('nrmse')} AS nrmse FROM met
""")
def q_metrics_json(spark, sf_dir):
    """Metric table written as JSON lines and read back."""
    path = art.write_json(mq._metrics(spark, sf_dir), os.path.join(run_dir(spark, "metrics-json"), "metrics"))
    return spark.read.schema("model string, target string, split string, n bigint, r2 double, mae double, "
                             "rmse double, mape double, nmae double, nrmse double").json(path)


@register("s8_s9_model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """S8 + S9: fitted pipeline and threshold table persisted, loaded back, used to score."""
    from ..operators import ml
    from ..operators.profile import quantile_row
    from .ml_models import DEMAND_X, _prepared, _split
    sp = _prepared(spark, sf_dir)
    train, test = _split(sp)
    base = run_dir(spark, "models")
    m = ml.fit_regressor(train, DEMAND_X, "demand_12h", "linear")
    art.save_model(m, os.path.join(base, "reg_demand"))
    th = quantile_row(train, {"d33": ("demand_12h", 0.33), "d66": ("demand_12h", 0.66)})
    art.save_table(th, os.path.join(base, "thresholds"))
    loaded = art.load_model(os.path.join(base, "reg_demand"))
    missing = art.load_model(os.path.join(base, "not_there"), required=False, default=None)
    t = art.load_table(spark, os.path.join(base, "thresholds")).first()
    pred = loaded.transform(test).select("ts", "prediction")
    return pred.withColumn("d33", F.lit(t["d33"])).withColumn("optional_loaded", F.lit(missing is not None))


@register("s11_metrics_map", mq.CMP_SQL + f"""
SELECT model, metric, {R('coalesce(value, 0.0)')} AS value FROM cmp2
UNPIVOT INCLUDE NULLS (value FOR metric IN (demand_r2, demand_nmae, price_r2, price_nmae, avg_r2))
""")
def q_metrics_map(spark, sf_dir):
    """Comparison table read into a per-model metric map (default 0), shown exploded."""
    c = mq._comparison(spark, sf_dir)
    m = art.metrics_map(c, "model", ["demand_r2", "demand_nmae", "price_r2", "price_nmae", "avg_r2"])
    return m.select("model", F.explode("metrics").alias("metric", "value"))


@register("s12_experiment_log", mq.PRED_SQL + f"""
SELECT 'run-1' AS run_id, model, target, split, metric, {R('value')} AS value
FROM met UNPIVOT INCLUDE NULLS (value FOR metric IN (r2, nmae))
""")
def q_experiment_log(spark, sf_dir):
    """Nested experiment log (JSON) flattened to one row per model and metric."""
    log = art.nest_experiment_log(mq._metrics(spark, sf_dir), "run-1")
    path = art.write_json(log, os.path.join(run_dir(spark, "log"), "experiment_log"))
    return art.flatten_experiment_log(spark.read.schema(art.LOG_SCHEMA).json(path))


@register("a21_inventory", PROFILE_SQL + """
SELECT CAST(16 AS BIGINT) AS n_features, count(*) AS n_profiles, count(DISTINCT cluster) AS n_clusters FROM pv
""")
def q_inventory(spark, sf_dir):
    """Service inventory (feature count, stored profiles, clusters)."""
    from ..plans.features import DEMAND_FEATURES
    p, _ = profiles(spark, sf_dir)
    return p.agg(F.lit(len(DEMAND_FEATURES)).cast("bigint").alias("n_features"),
                 F.count(F.lit(1)).alias("n_profiles"), F.count_distinct("cluster").alias("n_clusters"))


@register("m35_training_job")
def q_training_job(spark, sf_dir):
    """End-to-end training job returning its metadata table."""
    from ..plans.training import run_training_job
    return run_training_job(spark, sf_dir, run_dir(spark, "training"))
