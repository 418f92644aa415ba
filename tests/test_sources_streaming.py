"""Sources (S4/S5) and streaming semantics (K2 watermark, K1 quarantine)."""

import os
import tempfile
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltsight.sources import tables as src
from voltsight.streaming import jobs


def test_validate_and_refresh(spark):
    from voltsight.sources import snapshots
    path = os.path.join(tempfile.mkdtemp(prefix="vs-refresh-"), "history")
    good = spark.createDataFrame([("2020-01-01 00:00:00+00:00", 1.0, 2.0)], "time string, `total load actual` double, `price actual` double")
    bad = good.drop("price actual")
    assert src.validate_required(bad) == {"ok": False, "missing": ["price actual"]}
    assert snapshots.refresh(bad, path) == {"replaced": False, "missing": ["price actual"], "version": None, "n_rows": None}
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, path)
    assert snapshots.refresh(good, path)["version"] == 1
    assert snapshots.refresh(bad, path) == {"replaced": False, "missing": ["price actual"], "version": 1, "n_rows": 1}
    assert snapshots.current(spark, path).count() == 1          # old data kept


def test_refresh_survives_failure_and_keeps_begun_readers(spark):
    from voltsight.sources import snapshots
    path = os.path.join(tempfile.mkdtemp(prefix="vs-refresh-"), "h")
    first = spark.range(100).withColumn("v", F.col("id") * 2)
    snapshots.refresh(first, path, ["id", "v"])
    reader = snapshots.current(spark, path)
    broken = first.withColumn("v", F.when(F.col("id") == 77, F.raise_error(F.lit("broken reading")).cast("bigint")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken reading"):
        snapshots.refresh(broken, path, ["id", "v"])
    assert snapshots.current(spark, path).count() == 100 and len(os.listdir(f"{path}/data")) == 1
    # a version derived from the current one; a reader that has begun keeps its rows
    status = snapshots.refresh(reader.where("id < 10"), path, ["id", "v"])
    assert status == {"replaced": True, "missing": [], "version": 2, "n_rows": 10}
    assert reader.count() == 100 and snapshots.current(spark, path).count() == 10
    snapshots.refresh(first, path, ["id", "v"])
    assert len(os.listdir(f"{path}/data")) == 2 and snapshots.current(spark, path).count() == 100
    with pytest.raises(RuntimeError):
        snapshots._publish(spark, path, {"version": 3, "folder": "other", "n_rows": 0, "columns": []})


def _events(rows):
    return pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype(
        {"event_id": "int64", "user_id": "int64", "value": "float64"})


def test_watermark_drops_late_rows(spark):
    d = tempfile.mkdtemp(prefix="vs-stream-")
    t = pd.Timestamp
    f1 = _events([(1, t("2024-01-01 10:05"), 0, "view", 1.0, ""), (2, t("2024-01-01 12:10"), 0, "view", 2.0, "")])
    f2 = _events([(3, t("2024-01-01 07:30"), 0, "view", 100.0, ""), (4, t("2024-01-01 12:20"), 0, "view", 5.0, "")])
    f1b = _events([(9, t("2024-01-01 12:15"), 0, "view", 0.0, "")])
    for i, f in enumerate((f1, f1b, f2)):
        spark.createDataFrame(f).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1) \
             .write.mode("overwrite").parquet(os.path.join(d, f"part{i}"))
        # flatten into the folder the stream reads, one file per trigger, in order
        src_file = [p for p in os.listdir(os.path.join(d, f"part{i}")) if p.endswith(".parquet")][0]
        os.link(os.path.join(d, f"part{i}", src_file), os.path.join(d, f"events_{i}.parquet"))
        time.sleep(1.1)
    out = jobs.run_dir(spark, "wm-test")
    res = jobs.latest_windows(spark, jobs.run_hourly_series(spark, d, out, n_series=1)).toPandas()
    hours = {r.ts.hour: r.load for r in res.itertuples()}
    # on-time rows of the second micro-batch update the 12:00 window
    assert hours[12] == 7.0 and hours[10] == 1.0
    # the 07:30 row is older than the watermark before the previous batch ended (12:10 - 2 h): dropped
    assert 7 not in hours


def test_ingest_quarantines_incomplete_rows(spark):
    d = tempfile.mkdtemp(prefix="vs-ingest-")
    t = pd.Timestamp
    f = _events([(1, t("2024-01-01 10:05"), 0, "view", 1.0, ""), (2, t("2024-01-01 11:00"), 0, "view", None, "")])
    spark.createDataFrame(f).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(
        os.path.join(d, "p"))
    src_file = [p for p in os.listdir(os.path.join(d, "p")) if p.endswith(".parquet")][0]
    os.link(os.path.join(d, "p", src_file), os.path.join(d, "events_0.parquet"))
    out = jobs.run_dir(spark, "ingest-test")
    hist = jobs.ingest_validated(spark, jobs.event_stream(spark, d), ["event_id", "ts", "value"], out)
    assert spark.read.parquet(hist).count() == 1
    assert spark.read.parquet(os.path.join(out, "quarantine")).count() == 1


def _arrive(spark, folder, i, rows):
    spark.createDataFrame(_events(rows)).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(
        os.path.join(folder, f"arrival={i}"))


def test_scoring_state_equals_batch_and_survives_replay(spark):
    """Three arrivals with gaps beyond the state's reach; the last epoch is replayed."""
    from voltsight.plans.requests import request_features
    from voltsight.streaming import scoring
    d = tempfile.mkdtemp(prefix="vs-score-")
    kinds = ["view", "click", "purchase", "error", "signup"]
    starts = [pd.Timestamp("2024-01-01"), pd.Timestamp("2024-01-04 05:00"), pd.Timestamp("2024-02-20 03:00")]
    parts, n = [], 0
    for start in starts:
        rows = []
        for h in range(0, 60, 1 + len(parts)):
            for m in (7, 41):
                n += 1
                rows.append((n, start + pd.Timedelta(hours=h, minutes=m), n % 5, kinds[(n * 7) % 5], float(n % 13) + 0.25, ""))
        parts.append(rows)
    models = scoring.save_linear_models(spark, {"y": (1.5, {"demand_lag_24h": 2.0, "demand_avg_24h": -0.5})}, f"{d}/models")
    for i, rows in enumerate(parts):
        _arrive(spark, f"{d}/in", i, rows)
        stream = spark.readStream.schema(jobs.EVENT_SCHEMA).parquet(f"{d}/in/*")
        path = scoring.run_request_scoring(spark, stream, f"{d}/job", models, n_series=2)
    got = {r.request_id: r.asDict() for r in spark.read.parquet(path).drop("epoch").collect()}
    events = spark.createDataFrame(_events(sum(parts, []))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    hist = scoring.partial_hours(events, 2).select("series_id", "ts", F.col("load_sum").alias("load"),
                                                   (F.col("price_sum") / F.col("price_n")).alias("price"))
    want = {r.request_id: r.asDict() for r in request_features(src.requests_of(events, 2), hist).collect()}
    assert len(got) == len(want) == n
    for k, w in want.items():
        assert got[k].pop("predicted_y") == 1.5 + 2.0 * w["demand_lag_24h"] - 0.5 * w["demand_avg_24h"]
        assert got[k] == w
    # bounded state: the reach of the newest hour and one older row per series
    kept = scoring.kept_hours(spark.read.parquet(f"{d}/job/state/epoch=2"))
    assert kept.count() < spark.read.parquet(f"{d}/job/state/epoch=2").count()
    assert not os.path.exists(f"{d}/job/state/epoch=0")
    # the last epoch's commit is lost: it runs again and changes nothing
    os.remove(f"{d}/job/_ckpt/commits/2")
    if os.path.exists(f"{d}/job/_ckpt/commits/.2.crc"):
        os.remove(f"{d}/job/_ckpt/commits/.2.crc")
    before = sorted(map(str, spark.read.parquet(path).collect()))
    scoring.run_request_scoring(spark, spark.readStream.schema(jobs.EVENT_SCHEMA).parquet(f"{d}/in/*"), f"{d}/job", models, n_series=2)
    assert sorted(map(str, spark.read.parquet(path).collect())) == before
