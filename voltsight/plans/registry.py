"""Registry of trained models (S8, S9, M24-M30 over fitted estimators).

A registry is a folder: fitted pipelines under ``models/<role>/<target>/<name>`` and
one manifest table, written last, with one row per model: role, target, name, folder,
features and parameters (class bounds, the expanding-window score, the test metrics).
Without its manifest a registry doesn't exist, so a failed training run leaves nothing
that scoring could read.

``Registry.score`` applies the chosen models to any number of rows in one pass: every
model is a column expression over the same scan, no row is shuffled.  A null input is
0.0 (P17).  Classes are codes 0, 1, 2; clusters are numbers of the stored centres.
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as col
from ..operators import ml
from ..operators.profile import quantile_row
from ..session import cut_lineage
from ..sources import artifacts as art

_MANIFEST = ("role string, target string, name string, folder string, features array<string>, "
             "params map<string,double>, metrics map<string,double>")
CLASS_BOUNDS = {"low": 0.33, "high": 0.66}
N_CLUSTERS = 3


def with_classes(df: DataFrame, targets, bounds: dict) -> DataFrame:
    """``<target>_label``: the three-way class code of each target's label."""
    for target, label, _ in targets:
        low, high = (bounds[target][n] for n in CLASS_BOUNDS)
        df = df.withColumn(f"{target}_label", col.class_code(col.three_class(label, F.lit(low), F.lit(high))).cast("double"))
    return df


def class_bounds(train: DataFrame, targets) -> dict:
    """Exact 33 % and 66 % quantiles of each target over the training rows (null
    without any)."""
    row = quantile_row(train, {f"{t}_{n}": (label, p) for t, label, _ in targets for n, p in CLASS_BOUNDS.items()}).first()
    return {t: {n: row[f"{t}_{n}"] for n in CLASS_BOUNDS} for t, _, _ in targets}


def _finite(row, names) -> dict:
    return {n: float(row[n]) for n in names if row[n] is not None}


def train_registry(split: DataFrame, targets, regressors: dict, classifiers: dict, cluster_features, out_dir: str,
                   n_splits: int = 5, n_clusters: int = N_CLUSTERS, parallelism: int = 4) -> str:
    """Fit and store every regressor and classifier of every target and the cluster
    model; returns ``out_dir``.

    ``split``: feature rows with ``split`` (``train``/``test``), ``ts`` and
    ``series_id``.  ``targets``: (name, label column, features).  ``regressors`` and
    ``classifiers``: name -> (kind, parameters) of ``operators.ml``.  Classifiers get the
    mean macro F1 over ``n_splits`` expanding windows of the training rows as
    ``cv_macro_f1`` (absent, if no window could be fitted).  Without a training row, or
    without a value of a target, there is nothing to train: ``ValueError``.
    """
    spark = split.sparkSession
    bounds = class_bounds(split.where(F.col("split") == "train"), targets)
    if any(v is None for b in bounds.values() for v in b.values()):
        raise ValueError("no training rows")
    rows = cut_lineage(with_classes(split, targets, bounds))
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    windows = cut_lineage(ml.fold_positions(train, ["series_id"], "ts"))

    def stored(model, role, target, name):
        folder = os.path.join("models", role, target, name)
        art.save_model(model, os.path.join(out_dir, folder))
        return folder

    def regressor(target, label, feats, name):
        kind, kw = regressors[name]
        m = ml.fit_regressor(train.fillna(0.0, feats), feats, label, kind, **kw)
        metrics = {}
        scored = m.transform(rows.fillna(0.0, feats))
        for r in ml.regression_metrics(scored, label, "prediction", ["split"]).collect():       # two rows
            metrics |= {f"{r.split}_{k}": v for k, v in _finite(r, ("r2", "mae", "rmse", "mape", "nmae", "nrmse")).items()}
        return ("regressor", target, name, stored(m, "regressor", target, name), list(feats), {}, metrics)

    def macro_f1(scored, target):
        return ml.classification_summary(scored, f"{target}_label", "prediction").first()

    def first_segments(target):
        """First segment of the folds that holds each class: fold ``i`` trains on segments up to ``i``."""
        y = f"{target}_label"
        return [r.s for r in windows.where(F.col(y).isNotNull()).groupBy(y).agg(F.min(ml.fold_segment(n_splits)).alias("s")).collect()]

    def fold(target, feats, name, i):
        kind, kw = classifiers[name]
        past, next_ = (ml.fold_rows(windows, i, role, n_splits).fillna(0.0, feats) for role in ("train", "test"))
        return macro_f1(ml.fit_classifier(past, feats, f"{target}_label", kind, **kw).transform(next_), target)["macro_f1"]

    def classifier(target, _, feats, name):
        kind, kw = classifiers[name]
        m = ml.fit_classifier(train.fillna(0.0, feats), feats, f"{target}_label", kind, **kw)
        metrics = _finite(macro_f1(m.transform(test.fillna(0.0, feats)), target), ("accuracy", "macro_f1", "weighted_f1"))
        return ("classifier", target, name, stored(m, "classifier", target, name), list(feats), bounds[target], metrics)

    def cluster():
        m = ml.fit_clusters(train.fillna(0.0, cluster_features), cluster_features, n_clusters)
        return ("cluster", "", "kmeans", stored(m, "cluster", "all", "kmeans"), list(cluster_features),
                {"k": float(n_clusters)}, {"cost": float(m.stages[-1].summary.trainingCost)})

    tasks = [lambda t=t, n=n: regressor(*t, n) for t in targets for n in regressors]
    tasks += [lambda t=t, n=n: classifier(*t, n) for t in targets for n in classifiers] + [cluster]
    # every window is a fit of its own; with one class only there is nothing to learn in it
    seen = {t: first_segments(t) for t, _, _ in targets} if classifiers else {}
    folds = [(t, f, n, i) for i in reversed(range(n_splits)) for t, _, f in targets for n in classifiers
             if sum(s <= i for s in seen[t]) > 1]
    done = ml.run_parallel(tasks + [lambda x=x: fold(*x) for x in folds], parallelism)
    manifest, scores = done[:len(tasks)], {}
    for (target, _, name, _), score in reversed(list(zip(folds, done[len(tasks):]))):
        if score is not None:
            scores.setdefault((target, name), []).append(score)
    for role, target, name, *_, metrics in manifest:
        if role == "classifier" and (target, name) in scores:
            metrics["cv_macro_f1"] = sum(scores[target, name]) / len(scores[target, name])
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(os.path.join(out_dir, "manifest"))
    return out_dir


def best_classifiers(manifest: DataFrame) -> DataFrame:
    """Per target the classifier with the greatest cross-validated macro F1, or
    test macro F1 where it has none; the name that comes last breaks ties."""
    score = F.coalesce(F.col("metrics")["cv_macro_f1"], F.col("metrics")["macro_f1"])
    return manifest.where(F.col("role") == "classifier").groupBy("target").agg(
        F.max_by(F.struct("name", score.alias("score")), F.struct(score, "name")).alias("b")).select(
        "target", F.col("b.name").alias("name"), F.col("b.score").alias("score"))


def best_regressors(manifest: DataFrame, penalty: float = 0.5) -> DataFrame:
    """A17 + A18: per target the regressor with the greatest generalisation score
    (test R2 less ``penalty`` times the gap of train and test R2)."""
    r2 = F.col("metrics")["test_r2"]
    score = r2 - F.lit(penalty) * (F.col("metrics")["train_r2"] - r2)
    return manifest.where(F.col("role") == "regressor").groupBy("target").agg(
        F.max_by(F.struct("name", score.alias("score")), F.struct(score, "name")).alias("b")).select(
        "target", F.col("b.name").alias("name"), F.col("b.score").alias("score"))


def comparison(manifest: DataFrame, targets=("demand", "price")) -> DataFrame:
    """One row per stored regressor: R2 and NMAE of each target on the test
    split, mean R2, rank and the recommended one."""
    from ..operators.windows import rank_sorted
    m = manifest.where(F.col("role") == "regressor").select(
        F.col("name").alias("model"), "target", F.col("metrics")["test_r2"].alias("r2"), F.col("metrics")["test_nmae"].alias("nmae"))
    p = m.groupBy("model").pivot("target", list(targets)).agg(F.first("r2").alias("r2"), F.first("nmae").alias("nmae"))
    mean = sum((F.col(f"{t}_r2") for t in targets[1:]), F.col(f"{targets[0]}_r2")) / len(targets)
    return rank_sorted(p.withColumn("avg_r2", mean), "avg_r2", "model", "rank").withColumn("recommended", F.col("rank") == 1)


def experiment_log(manifest: DataFrame) -> DataFrame:
    """Run log by task: one row per stored model with its task (``regression``,
    ``classification_<target>``, ``clustering``), target and metrics."""
    task = F.when(F.col("role") == "classifier", F.concat(F.lit("classification_"), "target")).when(
        F.col("role") == "regressor", "regression").otherwise("clustering")
    return manifest.select(task.alias("task"), F.col("name").alias("model"), "target", F.col("metrics").alias("metrics"),
                           F.col("params").alias("params"))


def summary_rows(manifest: DataFrame) -> DataFrame:
    """``section, task, model`` - the best model of every task and target, and
    the number of clusters."""
    best = best_regressors(manifest).select(F.lit("best_model").alias("section"), F.concat(F.lit("regression_"), "target").alias("task"),
                                            F.col("name").alias("model"))
    best = best.unionByName(best_classifiers(manifest).select(F.lit("best_model").alias("section"), F.concat(
        F.lit("classification_"), "target").alias("task"), F.col("name").alias("model")))
    return best.unionByName(manifest.where(F.col("role") == "cluster").select(
        F.lit("clustering").alias("section"), F.lit("chosen_k").alias("task"),
        F.col("params")["k"].cast("int").cast("string").alias("model")))


class Registry:
    """The models of a registry folder, read once (one small row per model)."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.manifest = spark.read.schema(_MANIFEST).parquet(os.path.join(path, "manifest"))
        self.rows = self.manifest.collect()
        self._loaded: dict = {}

    def entry(self, role: str, target: str, name: str):
        for r in self.rows:
            if (r.role, r.target, r.name) == (role, target, name):
                return r
        raise KeyError(f"no {role} {name!r} of {target!r} in {self.path}")

    def names(self, role: str, target: str) -> list:
        return sorted(r.name for r in self.rows if (r.role, r.target) == (role, target))

    def model(self, entry) -> PipelineModel:
        if entry.folder not in self._loaded:
            self._loaded[entry.folder] = art.load_model(os.path.join(self.path, entry.folder))
        return self._loaded[entry.folder]

    def bounds(self, target: str) -> dict:
        """The class bounds stored with the target's classifiers."""
        return dict(next(r.params for r in self.rows if r.role == "classifier" and r.target == target))

    def apply(self, df: DataFrame, entry, out: str) -> DataFrame:
        """``df`` with the model's prediction as ``out``; a null input counts as 0.0.
        Columns of ``df`` keep their values, also where an input was null."""
        own = [f"_in_{f}" for f in entry.features]
        filled = df.withColumns({o: F.col(f) for o, f in zip(own, entry.features)}).fillna(0.0, entry.features)
        kept = [c for c in df.columns if c not in entry.features]
        scored = self.model(entry).transform(filled.withColumns(
            {f: F.col(f).cast("double") for f in entry.features}))
        back = [F.col(o).alias(f) for o, f in zip(own, entry.features)]
        return scored.select(*kept, *back, F.col("prediction").alias(out)).select(*df.columns, out)

    def score(self, df: DataFrame, regressor: dict, classifier: dict) -> DataFrame:
        """M25 + M26 + M24: ``pred_<target>``, ``<target>_class_enc`` of the models named
        per target, and ``cluster``."""
        for target, name in regressor.items():
            df = self.apply(df, self.entry("regressor", target, name), f"pred_{target}")
        for target, name in classifier.items():
            df = self.apply(df, self.entry("classifier", target, name), f"{target}_class_enc")
            df = df.withColumn(f"{target}_class_enc", F.col(f"{target}_class_enc").cast("int"))
        return self.apply(df, self.entry("cluster", "", "kmeans"), "cluster")

    def predict_all(self, df: DataFrame, targets=("demand", "price")) -> DataFrame:
        """Every stored regressor of every target as a column ``<target>_<name>``."""
        for target in targets:
            for name in self.names("regressor", target):
                df = self.apply(df, self.entry("regressor", target, name), f"{target}_{name}")
        return df
