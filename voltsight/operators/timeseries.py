"""Time-series analysis operators: resampling (A13), classical decomposition
(D1/D2) and the chart long form (D6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as win


def resample_mean(df: DataFrame, keys, ts: str, cols, unit: str = "day", step: str = "1 day") -> DataFrame:
    """``resample(unit).mean()``; empty periods appear as null rows.

    The per-period means are one partial/final aggregation.  The spine of
    all periods between each series' first and last period is generated
    from the (small) per-series min/max table with ``sequence`` + explode,
    then left-joined on (series, period) - both sides hash-partitioned on
    the same keys.
    """
    keys = list(keys)
    p = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    agg = df.groupBy(*keys, p.alias(ts)).agg(*[F.avg(c).alias(c) for c in cols])
    bounds = agg.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    spine = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias(ts))
    return spine.join(agg, on=keys + [ts], how="left")


def hourly_filled(df: DataFrame, x: str, keys=("series_id",), ts: str = "ts", block_size=None) -> DataFrame:
    """``keys, ts, x`` at every hour between a series' first and last row;
    missing hours and null values are interpolated linearly (W7)."""
    keys = list(keys)
    lay = win.layout(resample_mean(df, keys, ts, [x], "hour", "1 hour"), keys, ts, block_size=block_size)
    return lay.finish(win.interpolate_linear(lay, lay.df, x, "_filled")).select(*keys, ts, F.col("_filled").alias(x))


def _detrended(df: DataFrame, x: str, keys, ts: str, period: int, block_size) -> DataFrame:
    keys, h = list(keys), period // 2
    lay = win.layout(df, keys, ts, back=h, fwd=h, block_size=block_size)
    d = lay.finish(lay.df.withColumn("trend", win.centred_ma(x, period, lay.window())), keep_idx=True)
    return (d.withColumn("phase", (F.col(win.IDX) % period).cast("int"))
             .withColumn("_det_a", F.col(x) - F.col("trend"))
             .withColumn("_det_m", F.try_divide(F.col(x), F.col("trend"))))


def _phase_table(detrended: DataFrame, keys) -> DataFrame:
    """``keys, phase, seasonal_add, seasonal_mul``: one row per phase."""
    ph = detrended.groupBy(*keys, "phase").agg(F.avg("_det_a").alias("_pa"), F.avg("_det_m").alias("_pm"))
    wall = Window.partitionBy(*keys)
    return (ph.withColumn("seasonal_add", F.col("_pa") - F.avg("_pa").over(wall))
              .withColumn("seasonal_mul", F.try_divide(F.col("_pm"), F.avg("_pm").over(wall)))
              .drop("_pa", "_pm"))


def decompose(df: DataFrame, x: str, keys=("series_id",), ts: str = "ts", period: int = 24,
              block_size=None) -> DataFrame:
    """Classical additive and multiplicative decomposition of a series
    without gaps (``hourly_filled``).

    trend = centred 2x``period`` moving average (W8); phase = position mod
    ``period``; the seasonal figure is the per-phase mean of the detrended
    values, centred to mean 0 (additive) or normalised to mean 1
    (multiplicative); residual = what is left.  Phase means are a grouped
    aggregation of (series, phase) joined back - no per-series collect.
    """
    keys = list(keys)
    d = _detrended(df, x, keys, ts, period, block_size)
    ph = _phase_table(d, keys)
    d = d.join(ph, on=keys + ["phase"], how="left")
    return (d.withColumn("resid_add", F.col(x) - F.col("trend") - F.col("seasonal_add"))
             .withColumn("resid_mul", F.try_divide(F.try_divide(F.col(x), F.col("seasonal_mul")), F.col("trend")))
             .drop("_det_a", "_det_m", win.IDX))


def seasonal_profile(df: DataFrame, x: str, keys=("series_id",), ts: str = "ts", period: int = 24) -> DataFrame:
    """The ``period``-row seasonal figure per series."""
    return _phase_table(_detrended(df, x, keys, ts, period, None), keys)


def week_slice(df: DataFrame, keys=("series_id",), ts: str = "ts", hours: int = 168) -> DataFrame:
    """The first ``hours`` hours of every series of a decomposition."""
    first = df.groupBy(*keys).agg(F.min(ts).alias("_first"))
    return df.join(first, list(keys)).where(
        F.col(ts) < F.col("_first") + F.make_dt_interval(hours=F.lit(hours))).drop("_first")


def long_form(df: DataFrame, keys, ts: str, measures) -> DataFrame:
    """Actual vs forecast (or any measures) as (keys, ts, measure, value)."""
    return df.unpivot(list(keys) + [ts], list(measures), "measure", "value")
