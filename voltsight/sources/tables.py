"""Scans of the provided tables and the derived hourly grid table.

All reads go through ``spark.read.parquet``/``csv`` with explicit column
selection so Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

GRID_MEASURES = ("load", "price", "solar", "wind", "gas", "coal", "nuclear")

# event_type -> generation measure of the derived grid table (FIXTURES.md §5)
_EVENT_MEASURE = {"view": "solar", "click": "wind", "error": "gas", "purchase": "coal", "signup": "nuclear"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def replicate_events(events: DataFrame, copies: int, n_series: int = 8) -> DataFrame:
    """``copies`` disjoint copies of the events with distinct series ids
    (copy c maps user u to u + c * n_series), for scale-out measurements."""
    c = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    return events.withColumn("_c", c).withColumn(
        "user_id", (F.col("user_id") % F.lit(n_series)) + F.col("_c") * F.lit(n_series)).drop("_c")


def grid_hourly(spark: SparkSession, sf_dir: str, n_series: int = 8) -> DataFrame:
    """Hourly grid table derived from ``events``.

    Grain ``(series_id, ts)``; ``series_id = user_id % n_series`` (``n_series=1``
    gives the single-series form).  One hash aggregation with partial
    (map-side) combine: the shuffle carries at most one row per
    (task, series, hour), so it shrinks the data before the exchange.
    """
    return grid_from_events(read_table(spark, sf_dir, "events"), n_series)


def grid_from_events(events: DataFrame, n_series: int = 8) -> DataFrame:
    """The hourly grid aggregation over any events DataFrame."""
    ev = events.select("ts", "user_id", "event_type", "value")
    # user_id % n for every n (also 1): a column, not a constant, so joins on
    # series_id stay equi-joins after constant folding
    sid = F.col("user_id") % F.lit(n_series)
    ev = ev.select(sid.cast("bigint").alias("series_id"),
                   F.date_trunc("hour", F.col("ts")).alias("ts"), "event_type", "value")
    aggs = [F.sum("value").alias("load"),
            F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("price")]
    for et, name in _EVENT_MEASURE.items():
        aggs.append(F.sum(F.when(F.col("event_type") == et, F.col("value"))).alias(name))
    out = ev.groupBy("series_id", "ts").agg(*aggs)
    return out.select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), *GRID_MEASURES)


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order series (series_id = order priority): count and revenue."""
    o = read_table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority", "o_totalprice")
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"),
                      F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts"))
             .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("revenue")))


# ------------------------------------------------------------------ S1 / S2
def energy_schema(columns) -> T.StructType:
    """Explicit schema for a raw hourly energy CSV: ``time`` string, rest double."""
    return T.StructType([T.StructField(c, T.StringType() if c == "time" else T.DoubleType(), True)
                         for c in columns])


def read_energy_csv(spark: SparkSession, path: str, columns=None, coerce: bool = False) -> DataFrame:
    """S1 + S2: header CSV scan, ``time`` parsed to a UTC wall-clock timestamp.

    ``coerce=True`` maps unparsable timestamps to null (``try_to_timestamp``);
    otherwise a bad timestamp fails the job, as a strict parse does.
    """
    reader = spark.read.option("header", True)
    if columns is not None:
        reader = reader.schema(energy_schema(columns))
    df = reader.csv(path)
    parse = F.try_to_timestamp(F.col("time")) if coerce else F.to_timestamp(F.col("time"))
    # With the session in UTC, an offset-bearing text lands on its UTC instant.
    return df.withColumn("ts", parse.cast("timestamp_ntz"))


def validate_required(df: DataFrame, required=C.REQUIRED_COLUMNS) -> dict:
    """Report missing required columns; the caller keeps old data if any."""
    missing = [c for c in required if c not in df.columns]
    return {"ok": not missing, "missing": missing}


def requests_from_events(spark: SparkSession, sf_dir: str, n_series: int = 8) -> DataFrame:
    """Scoring requests derived from ``events``: one request per event.

    ``view``/``click`` requests sit on the hour (exact history matches), the
    others keep their sub-second time (as-of fallback); the event value is
    the entered generation of the source its type plays, others default 0.
    """
    return requests_of(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), n_series)


def requests_of(ev: DataFrame, n_series: int = 8) -> DataFrame:
    """``requests_from_events`` for any table (or micro-batch) of events."""
    on_hour = F.col("event_type").isin("view", "click")
    cols = {name: F.when(F.col("event_type") == et, F.col("value")).otherwise(F.lit(0.0))
            for et, name in _EVENT_MEASURE.items()}
    return ev.select(F.col("event_id").alias("request_id"),
                     (F.col("user_id") % F.lit(n_series)).cast("bigint").alias("series_id"),
                     F.when(on_hour, F.date_trunc("hour", "ts")).otherwise(F.col("ts")).cast("timestamp_ntz").alias("ts"),
                     *[c.alias(n) for n, c in cols.items()], F.lit(0.0).alias("hydro"))
