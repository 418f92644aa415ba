"""Regularised boosting with leaf penalties and best-first growth."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..catalog import R, register
from ..operators import boosting, ml
from .ml_models import TARGETS, _rows_df, _run_parallel
from .models import SPLIT_SQL, _prepared

# The settings of the regularised boosted regressors.
DEPTHWISE = boosting.Settings(rounds=300, step=0.03, max_depth=4, rows=0.7, columns=0.7, min_child_hessian=5)
LEAFWISE = boosting.Settings(rounds=500, step=0.02, max_depth=0, max_leaves=31, rows=0.7, columns=0.7, min_child_rows=20)
REGULARISED = {
    ("depthwise", "demand"): replace(DEPTHWISE, alpha=0.1, lam=2.0),
    ("depthwise", "price"): replace(DEPTHWISE, alpha=0.5, lam=3.0),
    ("leafwise", "demand"): replace(LEAFWISE, alpha=0.1, lam=1.0),
    ("leafwise", "price"): replace(LEAFWISE, alpha=0.3, lam=2.0),
}
#: the registered row takes a tenth of the rounds and ten times the step
ROW_SHARE = 10


def _first_split_sql():
    ctes, parts = [], []
    for target, label, feats in TARGETS:
        for form in ("depthwise", "leafwise"):
            s, t = REGULARISED[form, target], f"{form}_{target}"

            def score(g, h):
                return f"(pow(greatest(abs({g}) - {s.alpha}, 0), 2) / ({h} + {s.lam}))"

            def weight(g, h):
                return f"(-sign({g}) * greatest(abs({g}) - {s.alpha}, 0) / ({h} + {s.lam}) * {s.step})"

            long = " UNION ALL ".join(f"SELECT {j} AS f, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, g FROM {t}_g" for j, f in enumerate(feats))
            ctes.append(f"""
{t}_g AS (SELECT *, avg({label}) OVER () - {label} AS g FROM sp WHERE split = 'train' AND {label} IS NOT NULL),
{t}_a AS (SELECT sum(g) AS ga, CAST(count(*) AS DOUBLE) AS na FROM {t}_g),
{t}_v AS (SELECT f, feature, v, sum(g) AS g, count(*) AS c FROM ({long}) WHERE v IS NOT NULL GROUP BY ALL),
{t}_c AS (SELECT *, sum(g) OVER w AS cg, sum(c) OVER w AS cc, sum(g) OVER (PARTITION BY f) AS tg, sum(c) OVER (PARTITION BY f) AS tc
          FROM {t}_v WINDOW w AS (PARTITION BY f ORDER BY v)),
{t}_s AS (SELECT f, feature, v, missing_left, ga, na, cg + CASE WHEN missing_left THEN ga - tg ELSE 0 END AS lg,
                 CAST(cc + CASE WHEN missing_left THEN na - tc ELSE 0 END AS DOUBLE) AS ln
          FROM {t}_c, {t}_a, (VALUES (TRUE), (FALSE)) AS side(missing_left)
          WHERE cc < tc AND floor(cc * {s.bins} / tc) > floor((cc - c) * {s.bins} / tc)),
{t}_b AS (SELECT *, ({score('lg', 'ln')} + {score('ga - lg', 'na - ln')} - {score('ga', 'na')}) / 2 AS gain FROM {t}_s
          WHERE least(ln, na - ln) >= {max(s.min_child_rows, s.min_child_hessian, 1)}
          QUALIFY row_number() OVER (ORDER BY gain DESC, f, v, missing_left DESC) = 1)""")
            parts.append(f"""SELECT '{form}' AS form, '{target}' AS target, feature, {R('v', 4)} AS threshold, {R('gain', 3)} AS gain,
  {R(weight('lg', 'ln'), 6)} AS left_value, {R(weight('ga - lg', 'na - ln'), 6)} AS right_value FROM {t}_b WHERE gain > 0""")
    return SPLIT_SQL + "," + ",".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


@register("m13_first_split", _first_split_sql())
def q_first_split(spark, sf_dir):
    """First split of the first tree of each regularised model over all training
    rows and columns, with its gain and both leaf values."""
    train = _prepared(spark, sf_dir).where(F.col("split") == "train")

    def task(form, target, label, feats):
        s = replace(REGULARISED[form, target], rounds=1, max_depth=1, rows=1.0, columns=1.0)
        t = boosting.fit(train, feats, label, s).table(spark)
        root = t.where("feature IS NOT NULL").select("feature", "threshold", "gain", "left", "right")
        for side in ("left", "right"):
            leaf = t.select(F.col("node").alias(side), F.col("value").alias(f"{side}_value"))
            root = root.join(leaf, side)
        return root.select(F.lit(form).alias("form"), F.lit(target).alias("target"), "feature", F.round("threshold", 4).alias("threshold"),
                           F.round("gain", 3).alias("gain"), "left_value", "right_value")
    found = _run_parallel([lambda a=(form, *target): [task(*a)] for target in TARGETS for form in ("depthwise", "leafwise")])
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


@register("m13_regularised_boosting")
def q_regularised(spark, sf_dir):
    """M13 regularised, both targets, depth-wise and leaf-wise: train and test metrics.
    L1/L2 leaf penalties, least child sizes, 70 % of rows and columns per tree; a tenth
    of the rounds of ``REGULARISED`` at ten times the step (30 of 0.3, 50 of 0.2)."""
    sp = _prepared(spark, sf_dir)
    learn = sp.where(F.col("split") == "train")

    def task(form, target, label, feats):
        full = REGULARISED[form, target]
        model = boosting.fit(learn, feats, label, replace(full, rounds=full.rounds // ROW_SHARE, step=full.step * ROW_SHARE))
        extra = {"form": form, "target": target, "trees": len(model.trees), "leaves": sum(f < 0 for t in model.trees for f in t.feature)}
        scored = boosting.predict(sp, model)
        return [ml.regression_metrics(scored.where(F.col("split") == split), label, "prediction").first().asDict() | extra | {"split": split}
                for split in ("train", "test")]
    return _rows_df(spark, _run_parallel([lambda a=(form, *target): task(*a) for target in TARGETS for form in ("depthwise", "leafwise")]))
