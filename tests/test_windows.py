"""Halo-block layout == plain per-series window == pandas (SURVEY §5 (2), (5))."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from voltsight.operators import windows as win
from voltsight.plans.features import training_features
from voltsight.sources import tables as src


def _pdf(df, keys=("series_id", "ts")):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


@pytest.fixture(scope="module")
def daily(spark):
    # ~2,500 rows per series with injected nulls (every 7th day's revenue)
    d = src.orders_daily(spark, SF01)
    return d.withColumn("revenue", F.when(F.dayofmonth("ts") % 7 == 0, None).otherwise(F.col("revenue")))


@pytest.mark.parametrize("block", [64, 500])
def test_lag_lead_rolling_blocks_equal_series(daily, block):
    def plain():
        w = Window.partitionBy("series_id").orderBy("ts")
        return win.Layout(daily.withColumn(win.IDX, (F.row_number().over(w) - 1).cast("bigint")), ["series_id"], ["series_id"], False)

    def run(lay):
        w = lay.window()
        return _pdf(lay.finish(lay.df.withColumns({
            "lag7": win.lag_rows("revenue", 7, w), "lead12": win.lead_rows("revenue", 12, w),
            "prev24": win.rolling_mean("revenue", 24, w),
            "full24": win.rolling_mean("revenue", 24, w, include_current=True, full=True)}), keep_idx=True))
    a, b = run(win.layout(daily, ["series_id"], "ts", back=24, fwd=12, block_size=block)), run(plain())
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12)


def test_position_matches_row_number(daily):
    a = _pdf(win.with_position(daily, ["series_id"], "ts"))
    a["expect"] = a.groupby("series_id").cumcount()
    assert (a[win.IDX] == a["expect"]).all()


def test_pandas_parity_windows(daily):
    lay = win.layout(daily, ["series_id"], "ts", back=win.EWM_HALO, fwd=0, block_size=500)
    d = win.ewm_mean(lay, lay.df, "revenue", "ewm")
    d = win.interpolate_linear(lay, d, "revenue", "interp")
    w = lay.window()
    d = d.withColumns({"lag168": win.lag_rows("revenue", 168, w), "avg24": win.rolling_mean("revenue", 24, w),
                       "inc24": win.rolling_mean("revenue", 24, w, include_current=True)})
    got = _pdf(lay.finish(d))
    for sid, part in got.groupby("series_id"):
        s = part["revenue"].astype(float)
        np.testing.assert_allclose(part["ewm"], s.ewm(span=24).mean(), rtol=1e-9)
        np.testing.assert_allclose(part["interp"], s.interpolate(), rtol=1e-12)
        np.testing.assert_allclose(part["lag168"], s.shift(168), rtol=1e-12)
        np.testing.assert_allclose(part["avg24"], s.rolling(24, min_periods=1).mean().shift(1), rtol=1e-9)
        np.testing.assert_allclose(part["inc24"], s.rolling(24, min_periods=1).mean(), rtol=1e-9)


def test_ewm_long_null_run_is_carried(spark):
    # 2,000 rows, values only at the start and the end: the gap is longer than the halo
    vals = [float(i % 13) if (i < 50 or i > 1500) else None for i in range(2000)]
    pdf = pd.DataFrame({"series_id": 0, "ts": pd.date_range("2020-01-01", periods=2000, freq="h"), "x": vals})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    lay = win.layout(df, ["series_id"], "ts", back=win.EWM_HALO, block_size=500)
    got = _pdf(lay.finish(win.ewm_mean(lay, lay.df, "x", "ewm")))
    np.testing.assert_allclose(got["ewm"], pdf["x"].ewm(span=24).mean(), rtol=1e-9)
    lay2 = win.layout(df, ["series_id"], "ts", block_size=64)
    got2 = _pdf(lay2.finish(win.interpolate_linear(lay2, lay2.df, "x", "i")))
    np.testing.assert_allclose(got2["i"], pdf["x"].interpolate(), rtol=1e-12)


def test_feature_table_does_not_depend_on_the_block_size(spark):
    g = src.grid_hourly(spark, SF01, n_series=1)
    a = _pdf(training_features(g, block_size=200))
    b = _pdf(training_features(g, block_size=5000))
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12)
    assert len(a) > 300


def test_position_with_quantile_buckets(spark):
    from voltsight.operators import windows as w2
    ev = src.read_table(spark, SF01, "events").select("ts", "event_id", (F.col("user_id") % 2).alias("series_id"))
    old = w2.ROWS_PER_BUCKET
    w2.ROWS_PER_BUCKET = 700          # force ~15 equal-count buckets on 10k rows
    try:
        got = _pdf(win.with_position(ev, ["series_id"], "ts", tiebreak=["event_id"], bucket_unit="quantile"),
                   ("series_id", "ts", "event_id"))
    finally:
        w2.ROWS_PER_BUCKET = old
    got["expect"] = got.groupby("series_id").cumcount()
    assert (got[win.IDX] == got["expect"]).all()
    assert got.groupby(["series_id"]).size().min() > 1000


def test_average_rank_with_hot_value_and_nulls(spark):
    rng = np.random.default_rng(11)
    x = np.where(rng.random(4000) < 0.6, 7.0, rng.integers(0, 3000, 4000) / 2)
    pdf = pd.DataFrame({"id": range(4000), "g": rng.integers(0, 2, 4000), "x": x})
    pdf.loc[rng.random(4000) < 0.2, "x"] = np.nan
    pdf.loc[:3, "x"] = [0.0, -0.0, -0.0, 0.5]
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(6)
    for keys in ([], ["g"]):
        out = win.average_rank(df, "x", "r", keys=keys)
        assert out.columns == ["id", "g", "x", "r"]
        got = out.toPandas().set_index("id")["r"].sort_index()
        want = (pdf.groupby("g")["x"] if keys else pdf["x"]).rank(method="average")
        pd.testing.assert_series_equal(got, want, check_names=False)
    assert win.average_rank(df.limit(0), "x", "r").count() == 0
    # the rows of the hot value and the nulls, 70 % of all, are spread over the tasks
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = win.average_rank(df, "x", "r").groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) > 1 and parts.max() < 0.4 * len(pdf)
