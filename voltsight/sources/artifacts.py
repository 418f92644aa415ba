"""Artifact sinks and sources.

Tables go to CSV/JSON/Parquet with ``DataFrame.write``; models with
``pyspark.ml`` persistence.  All paths are under a caller-supplied folder
(on a cluster: shared storage).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header; array columns as sorted ', '-joined text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.array_sort(c), ", ")
        cols.append(c.alias(f.name))
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> str:
    """JSON lines (run metadata, metric tables, reports)."""
    df.write.mode("overwrite").json(path)
    return path


def save_model(model, path: str) -> str:
    """Persist a fitted ``PipelineModel`` (overwrite)."""
    model.write().overwrite().save(path)
    return path


def _absent(error: Exception) -> bool:
    """True if the path does not exist; any other error is not an absence."""
    return any(x in str(error) for x in ("PATH_NOT_FOUND", "Path does not exist", "Input path does not exist",
                                         "FileNotFoundException"))


def load_model(path: str, required: bool = True, default=None):
    """Load a ``PipelineModel``; optional artifacts fall back to a default."""
    from pyspark.ml import PipelineModel
    try:
        return PipelineModel.load(path)
    except Exception as e:
        if required or not _absent(e):
            raise
        return default


def save_table(df: DataFrame, path: str) -> str:
    """Thresholds, feature lists, profiles as Parquet tables."""
    df.write.mode("overwrite").parquet(path)
    return path


def load_table(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame | None:
    """Required (default None -> raise) or optional table."""
    if default is None:
        return spark.read.parquet(path)
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if not _absent(e):
            raise
        return default


def metrics_map(df: DataFrame, key: str, metrics) -> DataFrame:
    """Per-model metric map; missing values default to 0."""
    kv = []
    for m in metrics:
        kv += [F.lit(m), F.coalesce(F.col(m).cast("double"), F.lit(0.0))]
    return df.select(key, F.create_map(*kv).alias("metrics"))


LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("models", T.ArrayType(T.StructType([
        T.StructField("model", T.StringType()), T.StructField("target", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))]))),
])


def nest_experiment_log(metrics: DataFrame, run_id: str) -> DataFrame:
    """Build the nested run log (one row per run) from a metric table."""
    m = metrics.select(F.struct("model", "target", "split",
                                F.create_map(F.lit("r2"), F.col("r2"), F.lit("nmae"), F.col("nmae")).alias("metrics")).alias("m"))
    return m.agg(F.collect_list("m").alias("models")).select(F.lit(run_id).alias("run_id"), "models")


def flatten_experiment_log(log: DataFrame) -> DataFrame:
    """Nested run log -> one row per trained model and metric."""
    e = log.select("run_id", F.explode("models").alias("m"))
    return e.select("run_id", "m.model", "m.target", "m.split",
                    F.explode("m.metrics").alias("metric", "value"))


def artifact_path(base: str, *parts: str) -> str:
    return os.path.join(base, *parts)
