"""Request scoring with its own state and a stored model (K3).

Every micro-batch of events brings readings and scoring requests.  The hourly
history the requests look back on is the job's state: a table of partial hourly
sums per series, written once an epoch.  It holds the hours a later request can
still reach - ``LOOKBACK_HOURS`` before the newest hour - and the one row before
them that an as-of lookup falls back on, so its size follows the series, not the
length of the stream.  An epoch reads the state of the epoch before it, adds its own
partial sums (a late reading adds to its hour while that hour is kept), scores
its requests by the batch feature step and the stored models, and writes the new
state and the scores into folders of its own: replayed, it writes the same again.

Hot series: readings are summed map-side per hour before they meet the state, and
the requests of a series and hour share one lookup (``request_features``).

Requests are scored with what has arrived; they equal the batch result when all
readings of an hour arrive before, or with, the requests of the next hour.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.requests import request_features
from ..sources import tables as src

LOOKBACK_HOURS = 169
_STATE = "series_id bigint, ts timestamp_ntz, load_sum double, price_sum double, price_n bigint"
_MODELS = "target string, intercept double, weights map<string,double>"


def save_linear_models(spark: SparkSession, models: dict, path: str) -> str:
    """Store linear models as a table: ``{target: (intercept, {feature: weight})}``."""
    rows = [(t, float(b), {f: float(w) for f, w in weights.items()}) for t, (b, weights) in models.items()]
    spark.createDataFrame(rows, _MODELS).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_linear_models(spark: SparkSession, path: str) -> dict:
    """The stored models (one row per target); a missing table is an error."""
    return {r.target: (r.intercept, dict(r.weights)) for r in spark.read.schema(_MODELS).parquet(path).collect()}


def score(features: DataFrame, models: dict) -> DataFrame:
    """``features`` with one column ``predicted_<target>`` per model; a null input gives null."""
    def predicted(intercept, weights):
        out = F.lit(intercept)
        for feature, w in sorted(weights.items()):
            out = out + F.col(feature) * F.lit(w)
        return out
    return features.withColumns({f"predicted_{t}": predicted(*m) for t, m in models.items()})


def partial_hours(events: DataFrame, n_series: int) -> DataFrame:
    """Partial hourly sums of a batch of events, shaped as the state."""
    price = F.when(F.col("event_type") == "purchase", F.col("value"))
    return events.groupBy((F.col("user_id") % F.lit(n_series)).cast("bigint").alias("series_id"),
                          F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.sum("value").alias("load_sum"), F.sum(price).alias("price_sum"), F.count(price).alias("price_n"))


def kept_hours(state: DataFrame) -> DataFrame:
    """What later requests can reach: the newest ``LOOKBACK_HOURS`` and, of each
    series, the last row before them."""
    newest = state.agg(F.max("ts")).first()[0]
    if newest is None:
        return state
    reach = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {LOOKBACK_HOURS} HOURS")
    older = state.where(F.col("ts") < reach)
    last = older.groupBy("series_id").agg(F.max_by(F.struct(*older.columns[1:]), "ts").alias("m")).select("series_id", "m.*")
    return state.where(F.col("ts") >= reach).unionByName(last)


def merged_hours(state: DataFrame, partial: DataFrame) -> DataFrame:
    return state.unionByName(partial).groupBy("series_id", "ts").agg(
        F.sum("load_sum").alias("load_sum"), F.sum("price_sum").alias("price_sum"), F.sum("price_n").alias("price_n"))


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the job's own, wherever the shared storage is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run_request_scoring(spark: SparkSession, stream: DataFrame, out_dir: str, models_path: str, n_series: int = 8) -> str:
    """Score all events that have arrived since the last run with this ``out_dir``
    (offsets, state and scores live there); returns the folder of scores."""
    models = load_linear_models(spark, models_path)
    state_dir, scored = os.path.join(out_dir, "state"), os.path.join(out_dir, "scored")

    def at(epoch: int) -> str:
        return os.path.join(state_dir, f"epoch={epoch}")

    def batch(df: DataFrame, epoch: int) -> None:
        own = df.sparkSession
        if epoch:
            before = kept_hours(own.read.schema(_STATE).parquet(at(epoch - 1)))
        else:
            before = own.createDataFrame([], _STATE)
        merged_hours(before, partial_hours(df, n_series)).write.mode("overwrite").parquet(at(epoch))
        hours = own.read.schema(_STATE).parquet(at(epoch))
        history = hours.select("series_id", "ts", F.col("load_sum").alias("load"), (F.col("price_sum") / F.col("price_n")).alias("price"))
        feats = request_features(src.requests_of(df, n_series), history)
        score(feats, models).write.mode("overwrite").parquet(os.path.join(scored, f"epoch={epoch}"))
        if epoch >= 2:              # a replay needs the state of the epoch before only
            _remove(own, at(epoch - 2))

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(out_dir, "_ckpt"))
               .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return scored
