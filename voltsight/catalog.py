"""Registered queries: one Spark plan per operator plus its DuckDB oracle.

Every query reads the provided tables (or data Spark derives from them), so
its work grows with them.  Outputs are canonicalised the same way on both
sides before the hash compare: doubles rounded, timestamps as text, integers
as BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def canon(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            # round half away from zero on the binary value (x * 10^d), the
            # same arithmetic as the SQL side's round(x, d)
            scale = F.lit(float(10 ** digits))
            c = F.round(c.cast("double") * scale, 0) / scale + F.lit(0.0)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None, digits: int = DIGITS):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return canon(fn(spark, sf_dir), digits)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


# --------------------------------------------------------------------------
# Shared SQL building blocks (DuckDB dialect)
# --------------------------------------------------------------------------
GRID_SQL = """
SELECT CAST(user_id % 8 AS BIGINT) AS series_id, date_trunc('hour', ts) AS ts,
       sum(value) AS load,
       avg(value) FILTER (WHERE event_type = 'purchase') AS price,
       sum(value) FILTER (WHERE event_type = 'view') AS solar,
       sum(value) FILTER (WHERE event_type = 'click') AS wind,
       sum(value) FILTER (WHERE event_type = 'error') AS gas,
       sum(value) FILTER (WHERE event_type = 'purchase') AS coal,
       sum(value) FILTER (WHERE event_type = 'signup') AS nuclear
FROM events GROUP BY 1, 2
"""

GRID1_SQL = GRID_SQL.replace("CAST(user_id % 8 AS BIGINT)", "CAST(user_id % 1 AS BIGINT)")


def R(expr: str, d: int = DIGITS) -> str:
    # "+ 0.0" turns a rounded negative zero into +0.0 (Spark's round never yields -0.0)
    return f"(round({expr}, {d}) + 0.0)"


# Hourly base with groups and calendar columns (before positional work).
BASE_SQL = f"""
WITH g AS ({GRID_SQL}),
b0 AS (
  SELECT series_id, ts, load, price,
         coalesce(solar, 0) + coalesce(wind, 0) AS renewable,
         coalesce(gas, 0) + coalesce(coal, 0) AS fossil,
         coalesce(nuclear, 0) AS nuclear
  FROM g),
b AS (
  SELECT *, renewable + fossil + nuclear AS total_gen,
         CASE WHEN renewable + fossil + nuclear > 0
              THEN renewable / (renewable + fossil + nuclear) * 100 ELSE 0 END AS renewable_pct,
         CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
         CAST(month(ts) AS BIGINT) AS month, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend,
         sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
         sin(2 * pi() * month(ts) / 12) AS month_sin, cos(2 * pi() * month(ts) / 12) AS month_cos
  FROM b0)
"""

FEATURES_SQL = BASE_SQL + """,
l AS (
  SELECT *,
    lag(load, 1) OVER w AS demand_lag_1h, lag(load, 12) OVER w AS demand_lag_12h,
    lag(load, 24) OVER w AS demand_lag_24h, lag(load, 168) OVER w AS demand_lag_168h,
    lag(price, 1) OVER w AS price_lag_1h, lag(price, 12) OVER w AS price_lag_12h,
    lag(price, 24) OVER w AS price_lag_24h,
    avg(load) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS demand_avg_24h,
    avg(price) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS price_avg_24h
  FROM b WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
k AS (SELECT * FROM l WHERE demand_lag_168h IS NOT NULL AND price_lag_24h IS NOT NULL
                        AND price_lag_12h IS NOT NULL AND demand_lag_12h IS NOT NULL),
t AS (SELECT *, lead(load, 12) OVER w AS demand_12h, lead(price, 12) OVER w AS price_12h
      FROM k WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
f AS (SELECT * FROM t WHERE demand_lag_1h IS NOT NULL AND demand_lag_24h IS NOT NULL
        AND price_lag_1h IS NOT NULL AND price_lag_24h IS NOT NULL AND demand_avg_24h IS NOT NULL
        AND price_avg_24h IS NOT NULL AND price_lag_12h IS NOT NULL AND demand_lag_12h IS NOT NULL
        AND demand_12h IS NOT NULL AND price_12h IS NOT NULL
        AND month_sin IS NOT NULL AND month_cos IS NOT NULL)
"""

FEATURE_COLS_DOUBLE = ("load", "price", "renewable", "fossil", "nuclear", "total_gen", "renewable_pct",
                       "hour_sin", "hour_cos", "month_sin", "month_cos",
                       "demand_lag_1h", "demand_lag_12h", "demand_lag_24h", "demand_lag_168h",
                       "price_lag_1h", "price_lag_12h", "price_lag_24h", "demand_avg_24h", "price_avg_24h",
                       "demand_12h", "price_12h")
FEATURE_COLS_INT = ("hour", "day_of_week", "month", "is_weekend")


def _select_features_sql(src_alias: str = "f") -> str:
    cols = ["series_id", f"{ts_text('ts')} AS ts"] + [f"{R(c)} AS {c}" for c in FEATURE_COLS_DOUBLE] + list(FEATURE_COLS_INT)
    return f"SELECT {', '.join(cols)} FROM {src_alias}"


