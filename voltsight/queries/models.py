"""Model evaluation queries (M5, M6, M8 1-d, M17, M30, A15-A19, M32, M33).

The evaluated models are the ones SQL can also express - a persistence
forecast (value 24 h before the target hour) and a closed-form one-feature
least-squares fit on the training split - so the oracle covers the whole
chain: split -> fit -> predict -> metrics -> pivot -> rank.
"""

from pyspark.sql import functions as F

from .. import config as C
from ..catalog import FEATURE_COLS_DOUBLE, FEATURE_COLS_INT, FEATURES_SQL, GRID_SQL, GRID1_SQL, R, register
from ..functions import columns as col
from ..operators import ml
from ..operators.profile import quantile_row, scalars
from ..plans import features as fe
from ..sources import tables as src

SCALE_COLS = ("demand_lag_1h", "price_lag_1h", "renewable_pct", "hour_sin")

SPLIT_SQL = FEATURES_SQL.replace(GRID_SQL, GRID1_SQL) + """
, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS cnt FROM f),
sp AS (SELECT *, CASE WHEN idx < floor(0.8 * cnt) THEN 'train' ELSE 'test' END AS split FROM n)
"""

PRED_SQL = SPLIT_SQL + """
, fit AS (SELECT regr_slope(demand_12h, demand_lag_12h) AS bd, regr_intercept(demand_12h, demand_lag_12h) AS ad,
                 regr_slope(price_12h, price_lag_12h) AS bp, regr_intercept(price_12h, price_lag_12h) AS ap
          FROM sp WHERE split = 'train'),
pr AS (
  SELECT 'persistence' AS model, 'demand' AS target, split, demand_12h AS y, demand_lag_12h AS p FROM sp
  UNION ALL SELECT 'persistence', 'price', split, price_12h, price_lag_12h FROM sp
  UNION ALL SELECT 'linear_1d', 'demand', split, demand_12h, demand_lag_12h * bd + ad FROM sp, fit
  UNION ALL SELECT 'linear_1d', 'price', split, price_12h, price_lag_12h * bp + ap FROM sp, fit),
met AS (
  SELECT model, target, split, count(*) AS n,
    CASE WHEN var_pop(y) * count(*) = 0 THEN NULL ELSE 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2,
    avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
    avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) * 100.0 AS mape,
    avg(abs(y - p)) / avg(y) AS nmae, sqrt(avg((y - p) * (y - p))) / avg(y) AS nrmse
  FROM pr GROUP BY 1, 2, 3)
"""


def _prepared(spark, sf_dir):
    """Feature table + chronological split, materialised once (reliable
    checkpoint): fits, scalers and metrics all read it."""
    from ..session import cut_lineage
    f = fe.training_features(src.grid_hourly(spark, sf_dir, n_series=1))
    return cut_lineage(ml.chrono_split_label(f, ["series_id"], "ts", guard=False))


def _fit(train, y, x):
    r = ml.fit_linear_1d(train, y, x).first()       # a fitted model: two numbers
    return {"slope": F.lit(r["slope"]), "intercept": F.lit(r["intercept"])}


def _predictions(spark, sf_dir):
    sp = _prepared(spark, sf_dir)
    train = sp.where(F.col("split") == "train")
    fd = _fit(train, "demand_12h", "demand_lag_12h")
    fp = _fit(train, "price_12h", "price_lag_12h")
    parts = [
        sp.select(F.lit("persistence").alias("model"), F.lit("demand").alias("target"), "split",
                  F.col("demand_12h").alias("y"), F.col("demand_lag_12h").alias("p")),
        sp.select(F.lit("persistence"), F.lit("price"), "split", F.col("price_12h"), F.col("price_lag_12h")),
        sp.select(F.lit("linear_1d"), F.lit("demand"), "split", F.col("demand_12h"),
                  F.col("demand_lag_12h") * fd["slope"] + fd["intercept"]),
        sp.select(F.lit("linear_1d"), F.lit("price"), "split", F.col("price_12h"),
                  F.col("price_lag_12h") * fp["slope"] + fp["intercept"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _metrics(spark, sf_dir):
    return ml.regression_metrics(_predictions(spark, sf_dir), "y", "p", ["model", "target", "split"])


def _scale_sql(kind):
    if kind == "robust":
        stats = ", ".join(f"quantile_cont({c}, 0.5) AS c_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}"
                          for c in SCALE_COLS)
    else:
        stats = ", ".join(f"avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}" for c in SCALE_COLS)
    cols = ", ".join(f"{R(f'({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END')} AS {c}" for c in SCALE_COLS)
    return SPLIT_SQL + f", st AS (SELECT {stats} FROM sp WHERE split = 'train') SELECT {cols} FROM sp, st"


@register("m5_robust_scale", _scale_sql("robust"))
def q_robust_scale(spark, sf_dir):
    """M5: robust scaling (median / IQR) fitted on the training split, applied to all rows."""
    sp = _prepared(spark, sf_dir)
    sc = ml.robust_scaler(sp.where(F.col("split") == "train"), SCALE_COLS)
    return ml.scale(sp, sc).select(*SCALE_COLS)


@register("m6_standard_scale", _scale_sql("standard"))
def q_standard_scale(spark, sf_dir):
    """M6: standard scaling (population std) fitted on the training split."""
    sp = _prepared(spark, sf_dir)
    sc = ml.standard_scaler(sp.where(F.col("split") == "train"), SCALE_COLS)
    return ml.scale(sp, sc).select(*SCALE_COLS)


@register("m8_linear_1d_fit", SPLIT_SQL + f"""
SELECT {R('regr_slope(demand_12h, demand_lag_12h)')} AS slope, {R('regr_intercept(demand_12h, demand_lag_12h)')} AS intercept
FROM sp WHERE split = 'train'
""")
def q_linear_fit(spark, sf_dir):
    """M8 (one feature): closed-form least squares on the training split."""
    sp = _prepared(spark, sf_dir)
    return ml.fit_linear_1d(sp.where(F.col("split") == "train"), "demand_12h", "demand_lag_12h")


@register("a15_regression_metrics", PRED_SQL + f"""
SELECT model, target, split, n, {R('r2')} AS r2, {R('mae')} AS mae, {R('rmse')} AS rmse, {R('mape')} AS mape,
       {R('nmae')} AS nmae, {R('nrmse')} AS nrmse FROM met
""")
def q_regression_metrics(spark, sf_dir):
    """R2, MAE, RMSE, MAPE, NMAE, NRMSE per model, target and split."""
    return _metrics(spark, sf_dir)


GEN_SQL = PRED_SQL + """
, gen AS (SELECT model, target,
    max(r2) FILTER (WHERE split = 'train') AS train_r2, max(r2) FILTER (WHERE split = 'test') AS test_r2,
    max(nmae) FILTER (WHERE split = 'train') AS train_nmae, max(nmae) FILTER (WHERE split = 'test') AS test_nmae
  FROM met GROUP BY 1, 2)
"""


@register("a17_generalisation", GEN_SQL + f"""
SELECT model, target, {R('train_r2')} AS train_r2, {R('test_r2')} AS test_r2, {R('train_nmae')} AS train_nmae,
       {R('test_nmae')} AS test_nmae, {R('train_r2 - test_r2')} AS gap_r2,
       {R('test_r2 - 0.5 * (train_r2 - test_r2)')} AS gen_score FROM gen
""")
def q_generalisation(spark, sf_dir):
    """train/test gap and generalisation score."""
    return ml.generalisation(_metrics(spark, sf_dir), ["model", "target"])


@register("a18_best_model", GEN_SQL + """
SELECT target, arg_max(model, struct_pack(s := test_r2 - 0.5 * (train_r2 - test_r2), m := model)) AS best_model FROM gen GROUP BY 1
""")
def q_best_model(spark, sf_dir):
    """Arg-max of the generalisation score per target (name breaks ties)."""
    g = ml.generalisation(_metrics(spark, sf_dir), ["model", "target"])
    return g.groupBy("target").agg(F.max_by("model", F.struct("gen_score", "model")).alias("best_model"))


CMP_SQL = PRED_SQL + """
, cmp AS (SELECT model,
    max(r2) FILTER (WHERE target = 'demand') AS demand_r2, max(nmae) FILTER (WHERE target = 'demand') AS demand_nmae,
    max(r2) FILTER (WHERE target = 'price') AS price_r2, max(nmae) FILTER (WHERE target = 'price') AS price_nmae
  FROM met WHERE split = 'test' GROUP BY 1),
cmp2 AS (SELECT *, (demand_r2 + price_r2) / 2 AS avg_r2 FROM cmp)
"""


def _comparison(spark, sf_dir):
    m = _metrics(spark, sf_dir).where(F.col("split") == "test")
    p = m.groupBy("model").pivot("target", ["demand", "price"]).agg(F.first("r2").alias("r2"), F.first("nmae").alias("nmae"))
    return p.withColumn("avg_r2", (F.col("demand_r2") + F.col("price_r2")) / 2)


@register("m30_model_comparison", CMP_SQL + f"""
SELECT model, {R('demand_r2')} AS demand_r2, {R('demand_nmae')} AS demand_nmae, {R('price_r2')} AS price_r2,
       {R('price_nmae')} AS price_nmae, {R('avg_r2')} AS avg_r2,
       row_number() OVER (ORDER BY avg_r2 DESC, model) AS rank,
       row_number() OVER (ORDER BY avg_r2 DESC, model) = 1 AS recommended
FROM cmp2
""")
def q_model_comparison(spark, sf_dir):
    """M30 + L1 + W10: comparison table over models with rank and recommended model."""
    from ..operators.windows import rank_sorted
    c = rank_sorted(_comparison(spark, sf_dir), "avg_r2", "model", "rank")
    return c.withColumn("recommended", F.col("rank") == 1)


@register("a19_normalised_metrics", CMP_SQL + f"""
SELECT model,
  {R('CASE WHEN max(avg_r2) OVER () = min(avg_r2) OVER () THEN 0.0 ELSE (avg_r2 - min(avg_r2) OVER ()) / (max(avg_r2) OVER () - min(avg_r2) OVER ()) END')} AS avg_r2_norm,
  {R('1 - CASE WHEN max(demand_nmae) OVER () = min(demand_nmae) OVER () THEN 0.0 ELSE (demand_nmae - min(demand_nmae) OVER ()) / (max(demand_nmae) OVER () - min(demand_nmae) OVER ()) END')} AS demand_nmae_norm
FROM cmp2
""")
def q_normalised_metrics(spark, sf_dir):
    """Min-max normalised metrics over the (small) comparison table; errors inverted."""
    c = ml.minmax_normalise(_comparison(spark, sf_dir), "avg_r2", "avg_r2_norm")
    c = ml.minmax_normalise(c, "demand_nmae", "demand_nmae_norm", invert=True)
    return c.select("model", "avg_r2_norm", "demand_nmae_norm")


CLS_SQL = PRED_SQL + """
, th AS (SELECT quantile_cont(y, 0.33) AS t1, quantile_cont(y, 0.66) AS t2 FROM pr
         WHERE model = 'persistence' AND target = 'demand' AND split = 'train'),
cl AS (SELECT CASE WHEN y <= t1 THEN 'Low' WHEN y <= t2 THEN 'Medium' ELSE 'High' END AS label,
              CASE WHEN p <= t1 THEN 'Low' WHEN p <= t2 THEN 'Medium' ELSE 'High' END AS pred
       FROM pr, th WHERE model = 'persistence' AND target = 'demand' AND split = 'test'),
cls AS (SELECT unnest(['Low', 'Medium', 'High']) AS cls),
cm AS (SELECT cls, count_if(label = cls AND pred = cls) AS tp, count_if(label = cls) AS support,
              count_if(pred = cls) AS predicted FROM cls, cl GROUP BY cls),
rep AS (SELECT cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM cm WHERE support > 0 OR predicted > 0),
rep2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM rep)
"""


def _classes(spark, sf_dir):
    pr = _predictions(spark, sf_dir).where((F.col("model") == "persistence") & (F.col("target") == "demand"))
    th = scalars(quantile_row(pr.where(F.col("split") == "train"), {"t1": ("y", 0.33), "t2": ("y", 0.66)}))
    test = pr.where(F.col("split") == "test")
    return test.select(col.three_class("y", th["t1"], th["t2"]).alias("label"),
                       col.three_class("p", th["t1"], th["t2"]).alias("pred"))


@register("a16_classification_report", CLS_SQL + f"""
SELECT cls, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1, CAST(support AS BIGINT) AS support FROM rep2
""")
def q_classification_report(spark, sf_dir):
    """A16 + M17: per-class report of the regression->class baseline on the test split."""
    return ml.classification_report(_classes(spark, sf_dir), "label", "pred")


@register("m17_class_baseline_summary", CLS_SQL + f"""
SELECT {R('(SELECT avg(CAST(label = pred AS DOUBLE)) FROM cl)')} AS accuracy, {R('avg(f1)')} AS macro_f1,
       {R('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM rep2
""")
def q_class_summary(spark, sf_dir):
    """M17 + A16: accuracy, macro and weighted F1 of the baseline classes."""
    return ml.classification_summary(_classes(spark, sf_dir), "label", "pred")


DRIFT_FEATURES = tuple(c for c in FEATURE_COLS_DOUBLE + FEATURE_COLS_INT if c not in fe.TARGETS)


def _ks_sql(cols, below):
    values = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v, split FROM sp WHERE {c} IS NOT NULL" for c in cols)
    return SPLIT_SQL + f"""
, v AS ({values}),
c AS (SELECT column_name, v, count_if(split = 'train') AS c0, count_if(split = 'test') AS c1 FROM v GROUP BY 1, 2),
cdf AS (SELECT column_name, sum(c0) OVER w / sum(c0) OVER (PARTITION BY column_name)
                            - sum(c1) OVER w / sum(c1) OVER (PARTITION BY column_name) AS gap
        FROM c WINDOW w AS (PARTITION BY column_name ORDER BY v))
SELECT column_name, {R('max(abs(gap))')} AS ks, max(abs(gap)) < {below} AS passed FROM cdf GROUP BY 1
"""


@register("m32_feature_drift", _ks_sql(DRIFT_FEATURES, C.FEATURE_DRIFT_BELOW))
def q_feature_drift(spark, sf_dir):
    """Two-sample KS drift score and verdict of every feature, train vs test split."""
    return ml.drift_verdict(_prepared(spark, sf_dir), DRIFT_FEATURES, C.FEATURE_DRIFT_BELOW)


@register("m33_label_drift", _ks_sql(fe.TARGETS, C.LABEL_DRIFT_BELOW))
def q_label_drift(spark, sf_dir):
    """KS drift score and verdict of both targets, train vs test split."""
    return ml.drift_verdict(_prepared(spark, sf_dir), fe.TARGETS, C.LABEL_DRIFT_BELOW)
