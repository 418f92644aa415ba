"""Streaming queries (K1-K3): each runs its stream to completion
(``availableNow``) and returns the sink as a DataFrame, so the oracle
checks streaming output against the batch SQL."""

from pyspark.sql import functions as F

from ..catalog import FEATURES_SQL, GRID_SQL, R, register, ts_text
from ..operators import ml
from ..plans import features as fe
from ..session import cut_lineage
from ..sources import tables as src
from ..streaming import jobs, scoring

_M3_COLS = ("request_id", "series_id", "hour", "day_of_week", "month", "is_weekend", "hour_sin", "hour_cos",
            "month_sin", "month_cos", "renewable", "fossil", "nuclear", "total_gen", "renewable_pct",
            "demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "price_lag_1h", "price_lag_24h",
            "demand_avg_24h", "price_avg_24h")


@register("k1_stream_ingest", """
SELECT event_type, count(*) AS n_rows, round(sum(value), 6) AS value_sum FROM events
WHERE event_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY 1
""")
def q_stream_ingest(spark, sf_dir):
    """K1: validated streaming ingest into the history table (summary per event type)."""
    out = jobs.run_dir(spark, "ingest")
    path = jobs.ingest_validated(spark, jobs.event_stream(spark, sf_dir), ["event_id", "ts", "value"], out)
    h = spark.read.parquet(path)
    return h.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("value_sum"))


@register("k2_stream_hourly", f"""
WITH g AS ({GRID_SQL})
SELECT series_id, {ts_text('ts')} AS ts, {R('load')} AS load, {R('price')} AS price,
       {R('solar')} AS solar, {R('wind')} AS wind, {R('gas')} AS gas, {R('coal')} AS coal,
       {R('nuclear')} AS nuclear FROM g
""")
def q_stream_hourly(spark, sf_dir):
    """K2: hourly tumbling windows with a 2 h watermark over the event stream."""
    out = jobs.run_dir(spark, "hourly")
    return jobs.latest_windows(spark, jobs.run_hourly_series(spark, sf_dir, out))


SCORED_FROM = {"demand_12h": "demand_lag_24h", "price_12h": "price_lag_24h"}
ARRIVALS = 3


def _k3_sql():
    """M3 over all requests, and the least-squares lines of the feature table."""
    from .lookup import q_request_features  # noqa: F401 - same SQL as the batch query
    from ..catalog import ORACLE
    fits = ", ".join(f"regr_slope({y}, {x}) AS w_{y}, regr_intercept({y}, {x}) AS b_{y}" for y, x in SCORED_FROM.items())
    lines = ", ".join(f"{R(f'b_{y} + w_{y} * {x}', 4)} AS predicted_{y}" for y, x in SCORED_FROM.items())
    return ORACLE["m3_request_features"].replace("\nFROM r JOIN lags", f",\n  {lines}\nFROM r JOIN lags") + (
        f" CROSS JOIN ({FEATURES_SQL} SELECT {fits} FROM f) fit")


def _arrivals(spark, sf_dir, folder):
    """``events`` as files that arrive in time order, each with whole hours."""
    events = src.read_table(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / ARRIVALS
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    for i in range(ARRIVALS):
        low, high = (F.date_trunc("hour", F.lit(first + step * k)).cast("timestamp_ntz") for k in (i, i + 1))
        own = events.where(hour >= low) if i == ARRIVALS - 1 else events.where((hour >= low) & (hour < high))
        own.write.parquet(f"{folder}/arrival={i}")
        yield i


@register("k3_stream_scoring", _k3_sql(), digits=9)
def q_stream_scoring(spark, sf_dir):
    """K3: requests scored as they arrive, with the job's own state and stored
    models; the job is stopped and resumed after each arrival."""
    out = jobs.run_dir(spark, "scoring")
    train = cut_lineage(fe.training_features(src.grid_hourly(spark, sf_dir)).select(*SCORED_FROM, *SCORED_FROM.values()))
    fits = {y: ml.fit_linear_1d(train, y, x).first() for y, x in SCORED_FROM.items()}
    models = scoring.save_linear_models(
        spark, {y: (fits[y]["intercept"], {x: fits[y]["slope"]}) for y, x in SCORED_FROM.items()}, f"{out}/models")
    for _ in _arrivals(spark, sf_dir, f"{out}/in"):
        stream = spark.readStream.schema(jobs.EVENT_SCHEMA).parquet(f"{out}/in/*")
        path = scoring.run_request_scoring(spark, stream, f"{out}/job", models)
    d = spark.read.parquet(path)
    return d.select(*_M3_COLS, *[F.round(f"predicted_{y}", 4).alias(f"predicted_{y}") for y in SCORED_FROM])
