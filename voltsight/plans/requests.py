"""Request feature extraction (M3): calendar, entered generation groups,
as-of lags and the 24 h interval mean against the hourly history, computed
once per request as a DataFrame (no per-request Python)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as col
from ..operators import lookup as lk

REQUEST_GROUPS = C.GroupSpec("request", renewable=("solar", "wind", "hydro"), fossil=("gas", "coal"),
                             nuclear=("nuclear",))

LAG_LOOKUPS = {
    "demand_lag_1h": ("load", 1, C.DEFAULT_DEMAND),
    "demand_lag_24h": ("load", 24, C.DEFAULT_DEMAND),
    "demand_lag_168h": ("load", 168, C.DEFAULT_DEMAND),
    "price_lag_1h": ("price", 1, C.DEFAULT_PRICE),
    "price_lag_24h": ("price", 24, C.DEFAULT_PRICE),
}


def slot_lags(history: DataFrame, keys, ts: str, lookups: dict):
    """J1 for ``by_slot``; slots are few per series-day, so they need no salts."""
    return lambda slots, id_col: lk.asof_values(slots, history, keys, ts, "ts", lookups, id_col, salts=1)


def slot_means(history: DataFrame, keys, ts: str, values=("load", "price")):
    """J2 for ``by_slot``: the 24 h mean of ``values``."""
    return lambda slots, id_col: lk.interval_mean(slots, history, keys, ts, "ts", list(values), id_col)


def request_features(requests: DataFrame, history: DataFrame, keys=("series_id",), ts: str = "ts",
                     lookups: dict | None = None) -> DataFrame:
    """M3: features of each request row, for a history with rows on whole hours.

    Lags: value at ``ts - k h``, else the last history row before it, else
    the default.  Rolling: mean of history in ``[ts-24h, ts-1h]``; when that
    range holds no row, the 1 h lag.
    """
    keys = list(keys)
    lookups = lookups or LAG_LOOKUPS
    r = col.with_generation_groups(requests, REQUEST_GROUPS)
    r = (r.withColumn("hour", F.hour(ts)).withColumn("day_of_week", col.day_of_week(ts))
          .withColumn("month", F.month(ts)).withColumn("is_weekend", col.is_weekend(ts))
          .withColumn("hour_sin", col.cyclic(F.hour(ts), 24, "sin")).withColumn("hour_cos", col.cyclic(F.hour(ts), 24, "cos"))
          .withColumn("month_sin", col.cyclic(F.month(ts), 12, "sin")).withColumn("month_cos", col.cyclic(F.month(ts), 12, "cos")))
    out = lk.by_slot(r, keys, ts, slot_lags(history, keys, ts, lookups), slot_means(history, keys, ts))
    has = F.coalesce(F.col("n_hist"), F.lit(0)) > 0
    return (out.withColumn("demand_avg_24h", F.when(has, F.col("avg_load")).otherwise(F.col("demand_lag_1h")))
               .withColumn("price_avg_24h", F.when(has, F.col("avg_price")).otherwise(F.col("price_lag_1h")))
               .drop("n_hist", "avg_load", "avg_price"))
