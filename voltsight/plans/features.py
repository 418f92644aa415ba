"""Feature-table plans (M1, M2, M4) composed from column and window operators.

The order of steps follows the training script: group sums, calendar
encodings, positional lags and a leak-free rolling mean, drop of incomplete
rows, then the 12-step lead targets computed on the *remaining* rows (a
second positional pass), then a final drop of incomplete rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as col
from ..operators import windows as win

RAW_MEASURES = ("solar", "wind", "gas", "coal")

DEMAND_FEATURES = ("day_of_week", "month_sin", "month_cos", "is_weekend", "hour_sin", "hour_cos",
                   "demand_lag_1h", "demand_lag_24h", "price_lag_1h", "price_lag_24h",
                   "renewable", "fossil", "nuclear", "renewable_pct", "demand_avg_24h", "price_avg_24h")
PRICE_FEATURES = ("day_of_week", "month_sin", "month_cos", "is_weekend", "hour_sin", "hour_cos",
                  "price_lag_1h", "price_lag_12h", "demand_lag_1h", "demand_lag_12h",
                  "renewable", "fossil", "nuclear", "renewable_pct", "price_avg_24h", "demand_avg_24h")
TARGETS = ("demand_12h", "price_12h")


def ordered_union(*lists) -> list:
    """Ordered de-duplicated union of feature lists."""
    seen, out = set(), []
    for lst in lists:
        for f in lst:
            if f not in seen:
                seen.add(f)
                out.append(f)
    return out


def existing(df: DataFrame, features) -> list:
    """Keep only features present in the schema (order kept)."""
    present = set(df.columns)
    return [f for f in features if f in present]


def add_lags(df: DataFrame, spec: C.FeatureSpec, keys=("series_id",), order="ts",
             block_size=None) -> DataFrame:
    """W1 + W3: positional lags and the leak-free trailing mean."""
    back = max([*spec.demand_lags, *spec.price_lags, spec.rolling])
    lay = win.layout(df, keys, order, back=back, block_size=block_size)
    w = lay.window()
    cols = {}
    for k in spec.demand_lags:
        cols[f"demand_lag_{k}h"] = win.lag_rows(spec.demand_col, k, w)
    for k in spec.price_lags:
        cols[f"price_lag_{k}h"] = win.lag_rows(spec.price_col, k, w)
    if spec.rolling:
        cols[f"demand_avg_{spec.rolling}h"] = win.rolling_mean(spec.demand_col, spec.rolling, w)
        cols[f"price_avg_{spec.rolling}h"] = win.rolling_mean(spec.price_col, spec.rolling, w)
    return lay.finish(lay.df.withColumns(cols))


def add_targets(df: DataFrame, spec: C.FeatureSpec, keys=("series_id",), order="ts",
                block_size=None) -> DataFrame:
    """``horizon``-step lead targets."""
    lay = win.layout(df, keys, order, fwd=spec.horizon, block_size=block_size)
    w = lay.window()
    return lay.finish(lay.df.withColumns({
        "demand_12h": win.lead_rows(spec.demand_col, spec.horizon, w),
        "price_12h": win.lead_rows(spec.price_col, spec.horizon, w)}))


def training_features(df: DataFrame, spec: C.FeatureSpec | None = None, keys=("series_id",),
                      order: str = "ts", block_size=None) -> DataFrame:
    """M1: the training feature table (one row per kept hour and series)."""
    spec = spec or C.FeatureSpec()
    d = col.with_generation_groups(df, spec.groups)
    d = d.drop(*[c for c in RAW_MEASURES if c in d.columns])
    d = col.with_calendar(d, order, spec.month_offset)
    d = add_lags(d, spec, keys, order, block_size)
    d = d.dropna(subset=list(spec.required))
    d = add_targets(d, spec, keys, order, block_size)
    required = ordered_union(existing(d, DEMAND_FEATURES), existing(d, PRICE_FEATURES), TARGETS)
    return d.dropna(subset=required)


def flow_features(df: DataFrame, keys=("series_id",), order="ts", block_size=None) -> DataFrame:
    """M2: minimal flow features (renewable, fossil, hour, dow, hour cyclic,
    lag 1, 12-step targets), rows with any null dropped."""
    spec = C.FeatureSpec(groups=C.GroupSpec("flow", renewable=("solar", "wind"), fossil=("gas", "coal"),
                                            with_pct=False),
                         demand_lags=(1,), price_lags=(1,), rolling=0)
    d = col.with_generation_groups(df, spec.groups)
    d = (d.withColumn("hour", F.hour(order)).withColumn("day_of_week", col.day_of_week(order))
          .withColumn("hour_sin", col.cyclic(F.hour(order), 24, "sin"))
          .withColumn("hour_cos", col.cyclic(F.hour(order), 24, "cos")))
    lay = win.layout(d, keys, order, back=1, fwd=spec.horizon, block_size=block_size)
    w = lay.window()
    d = lay.finish(lay.df.withColumns({
        "demand_lag_1h": win.lag_rows("load", 1, w), "price_lag_1h": win.lag_rows("price", 1, w),
        "demand_12h": win.lead_rows("load", spec.horizon, w), "price_12h": win.lead_rows("price", spec.horizon, w)}))
    return d.dropna()


def degenerate_columns(df: DataFrame, exclude=()) -> DataFrame:
    """P4 report: one row per column with ``all_zero`` / ``constant`` flags.

    pandas rules (trap T12): a column with any null is never all-zero, and
    ``nunique() == 1`` ignores nulls.  One aggregation pass for all columns.
    """
    num = [f.name for f in df.schema.fields
           if f.name not in exclude and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    aggs = []
    for c in num:
        aggs += [F.count_if(F.col(c) == 0).alias(f"z__{c}"), F.coalesce(F.min(c) == F.max(c), F.lit(False)).alias(f"d__{c}")]
    row = df.agg(F.count(F.lit(1)).alias("n__"), *aggs)
    stack = ", ".join(f"'{c}', `z__{c}`, `d__{c}`" for c in num)
    return row.selectExpr(f"stack({len(num)}, {stack}) as (column_name, n_zero, single)", "n__") \
              .select("column_name",
                      (F.col("n_zero") == F.col("n__")).alias("all_zero"),
                      F.col("single").alias("constant"))


def drop_degenerate(df: DataFrame, exclude=()) -> DataFrame:
    """Drop all-zero and constant columns (decided by one small agg)."""
    rep = degenerate_columns(df, exclude).where("all_zero or constant").collect()
    return df.drop(*[r["column_name"] for r in rep])


def request_features_from_values(df: DataFrame, defaults: dict) -> DataFrame:
    """M4: feature vector from entered values with per-feature defaults."""
    present = set(df.columns)
    return df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(float(v))).alias(f) if f in present
                       else F.lit(float(v)).alias(f) for f, v in defaults.items()])
