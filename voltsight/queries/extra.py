"""Smaller projections and scalar-function queries."""

import uuid

from pyspark.sql import functions as F

from ..catalog import GRID_SQL, R, register, ts_text
from ..functions import columns as col
from ..plans import features as fe
from ..session import ensure_checkpoint_dir
from ..sources import snapshots
from ..sources import tables as src


M2_SQL = f"""
WITH g AS ({GRID_SQL}),
b AS (SELECT *, coalesce(solar, 0) + coalesce(wind, 0) AS renewable, coalesce(gas, 0) + coalesce(coal, 0) AS fossil,
             CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
             sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos FROM g),
l AS (SELECT *, lag(load, 1) OVER w AS demand_lag_1h, lag(price, 1) OVER w AS price_lag_1h,
             lead(load, 12) OVER w AS demand_12h, lead(price, 12) OVER w AS price_12h
      FROM b WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, {ts_text('ts')} AS ts, {R('load')} AS load, {R('price')} AS price, {R('solar')} AS solar,
  {R('wind')} AS wind, {R('gas')} AS gas, {R('coal')} AS coal, {R('nuclear')} AS nuclear,
  {R('renewable')} AS renewable, {R('fossil')} AS fossil, hour, day_of_week, {R('hour_sin')} AS hour_sin,
  {R('hour_cos')} AS hour_cos, {R('demand_lag_1h')} AS demand_lag_1h, {R('price_lag_1h')} AS price_lag_1h,
  {R('demand_12h')} AS demand_12h, {R('price_12h')} AS price_12h
FROM l WHERE load IS NOT NULL AND price IS NOT NULL AND solar IS NOT NULL AND wind IS NOT NULL AND gas IS NOT NULL
  AND coal IS NOT NULL AND nuclear IS NOT NULL AND demand_lag_1h IS NOT NULL AND price_lag_1h IS NOT NULL
  AND demand_12h IS NOT NULL AND price_12h IS NOT NULL
"""


@register("m2_flow_features", M2_SQL)
def q_flow_features(spark, sf_dir):
    """M2: minimal flow features, rows with any null dropped."""
    return fe.flow_features(src.grid_hourly(spark, sf_dir))


@register("m2_flow_features_single", M2_SQL.replace(GRID_SQL, GRID_SQL.replace("CAST(user_id % 8 AS BIGINT)", "CAST(user_id % 1 AS BIGINT)")))
def q_flow_features_single(spark, sf_dir):
    """M2 on the single-series grid table."""
    return fe.flow_features(src.grid_hourly(spark, sf_dir, n_series=1))


@register("p3_drop_columns", f"""
WITH g AS ({GRID_SQL})
SELECT series_id, {ts_text('ts')} AS ts, {R('load')} AS load, {R('price')} AS price FROM g
""")
def q_drop_columns(spark, sf_dir):
    """Drop a column list, ignoring names that do not exist."""
    g = src.grid_hourly(spark, sf_dir)
    return g.drop("solar", "wind", "gas", "coal", "nuclear", "generation marine", "forecast wind offshore eday ahead")


@register("f11_f13_text_functions", """
SELECT o_orderkey, replace(replace(lower(o_orderpriority), ' ', '_'), '/', '_') AS priority_slug,
       round_even(o_totalprice, 0) AS total_rounded,
       strftime(o_orderdate, '%Y-%m-%d %H:%M') AS order_time,
       format('{:,.2f}', o_totalprice) AS total_text
FROM orders
""")
def q_text_functions(spark, sf_dir):
    """F11 slugify, F12 half-even rounding, F13 datetime text over the orders table."""
    o = src.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    return o.select("o_orderkey", col.slugify("o_orderpriority").alias("priority_slug"),
                    col.py_round("o_totalprice", 0).alias("total_rounded"),
                    col.fmt_datetime("o_orderdate").alias("order_time"),
                    col.fmt_number("o_totalprice", 2).alias("total_text"))


# ---- S1 + S2 + P1 (full variant) over a raw energy-format CSV -------------------
RAW_NAMES = {"load": "total load actual", "price": "price actual", "solar": "generation solar",
             "wind": "generation wind onshore", "gas": "generation fossil gas",
             "coal": "generation fossil hard coal", "nuclear": "generation nuclear"}


@register("s1_s2_raw_csv_scan", f"""
WITH g AS ({GRID_SQL.replace("CAST(user_id % 8 AS BIGINT)", "CAST(user_id % 1 AS BIGINT)")})
SELECT {ts_text('ts')} AS ts, {R('load')} AS load,
       {R('coalesce(solar, 0) + coalesce(wind, 0)')} AS renewable, {R('coalesce(gas, 0) + coalesce(coal, 0)')} AS fossil,
       {R('coalesce(nuclear, 0)')} AS nuclear
FROM g
""")
def q_raw_csv_scan(spark, sf_dir):
    """S1 + S2 + P1: the hourly table written as a raw energy CSV (long column
    names, '+00:00' offsets), scanned back with an explicit schema, parsed to
    UTC and summed with the 'full' column-group variant (absent members = 0)."""
    import os
    from .. import config as C
    from ..functions.columns import with_generation_groups
    from ..sources.tables import read_energy_csv
    from ..streaming.jobs import run_dir
    g = src.grid_hourly(spark, sf_dir, n_series=1)
    raw = g.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+00:00'").alias("time"),
                   *[F.col(k).alias(v) for k, v in RAW_NAMES.items()])
    path = os.path.join(run_dir(spark, "raw-csv"), "energy")
    raw.write.mode("overwrite").option("header", True).csv(path)
    df = read_energy_csv(spark, path, columns=["time", *RAW_NAMES.values()])
    df = with_generation_groups(df, C.RAW_GROUP_SPECS["full"])
    return df.select("ts", F.col("total load actual").alias("load"), "renewable", "fossil", "nuclear")


@register("f8_regime_labels", f"""
WITH g AS ({GRID_SQL}),
q AS (SELECT series_id, quantile_cont(load, 0.33) AS q33, quantile_cont(load, 0.66) AS q66 FROM g GROUP BY 1)
SELECT g.series_id, {ts_text('ts')} AS ts,
       CASE WHEN load < q33 THEN 'Low Demand Regime' WHEN load < q66 THEN 'Medium Demand Regime'
            ELSE 'High Demand Regime' END AS regime
FROM g JOIN q USING (series_id)
""")
def q_regime_labels(spark, sf_dir):
    """F8: regime label by 0.33 / 0.66 quantiles with strict bounds (quantiles computed once per series)."""
    from ..operators.profile import exact_quantiles
    g = src.grid_hourly(spark, sf_dir)
    q = exact_quantiles(g, "load", [.33, .66], ["series_id"])
    return g.join(q, "series_id").select("series_id", "ts", col.regime_label("load", F.col("q33"), F.col("q66")).alias("regime"))


@register("s2_coerced_parse", f"""
WITH g AS ({GRID_SQL.replace("CAST(user_id % 8 AS BIGINT)", "CAST(user_id % 1 AS BIGINT)")})
SELECT CASE WHEN hour(ts) % 5 <> 0 THEN {ts_text('ts')} END AS ts, {R('load')} AS load FROM g
""")
def q_coerced_parse(spark, sf_dir):
    """S2 coercing: every fifth hour's time is not a time in the file and comes back as null."""
    import os
    from ..sources.tables import read_energy_csv
    from ..streaming.jobs import run_dir
    g = src.grid_hourly(spark, sf_dir, n_series=1)
    time = F.when(F.hour("ts") % 5 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+00:00'"))
    path = os.path.join(run_dir(spark, "coerced-csv"), "energy")
    g.select(time.alias("time"), F.col("load").alias("total load actual")).write.mode("overwrite").option("header", True).csv(path)
    df = read_energy_csv(spark, path, columns=["time", "total load actual"], coerce=True)
    return df.select("ts", F.col("total load actual").alias("load"))


@register("f14_clean_rule_text", """
SELECT o_orderkey, o_orderpriority || ', ' || o_orderstatus || ', ' || o_orderpriority AS cleaned FROM orders
""")
def q_clean_rule_text(spark, sf_dir):
    """pipes and line ends become commas, parts are trimmed, blanks dropped, order and repeats kept."""
    o = src.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    raw = F.concat(F.lit(" "), "o_orderpriority", F.lit(" | "), "o_orderstatus", F.lit("\n |"), "o_orderpriority", F.lit(" "))
    return o.select("o_orderkey", col.clean_rule_text(raw).alias("cleaned"))


@register("p4_drop_degenerate", f"""
SELECT o_orderkey, {R('o_totalprice')} AS o_totalprice FROM orders
""")
def q_drop_degenerate(spark, sf_dir):
    """An all-zero and a constant column are dropped."""
    o = src.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return fe.drop_degenerate(o.withColumns({"zeros": F.col("o_orderkey") * 0, "constant": F.col("o_orderkey") * 0 + 7}))


_S5_REQUIRED = ["o_orderkey", "o_totalprice"]
_S5_ALL = "count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders"


@register("s5_dataset_refresh", f"""
SELECT CAST(1 AS BIGINT) AS step, TRUE AS replaced, '' AS missing, CAST(1 AS BIGINT) AS version, {_S5_ALL}
UNION ALL SELECT 2, FALSE, 'o_totalprice', 1, {_S5_ALL}
UNION ALL SELECT 3, TRUE, '', 2, {_S5_ALL} WHERE o_orderstatus = 'F'
UNION ALL SELECT 4, FALSE, 'failed', 2, {_S5_ALL} WHERE o_orderstatus = 'F'
""", digits=2)
def q_dataset_refresh(spark, sf_dir):
    """Four arrivals - valid, without a required column, valid, failing while
    it is written - and what readers see after each."""
    path = f"{ensure_checkpoint_dir(spark)}/refresh-{uuid.uuid4().hex}"
    orders = src.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double"))
    broken = F.when(F.col("o_orderkey") > 0, F.raise_error(F.lit("broken reading")).cast("double")).otherwise(F.col("o_totalprice"))
    arrivals = [orders, orders.drop("o_totalprice"), orders.where("o_orderstatus = 'F'"), orders.withColumn("o_totalprice", broken)]
    out = None
    for step, new in enumerate(arrivals, 1):
        try:
            status = snapshots.refresh(new, path, _S5_REQUIRED)
        except Exception as e:
            if "broken reading" not in str(e):
                raise
            status = {"replaced": False, "missing": ["failed"], "version": snapshots.newest(spark, path).version}
        seen = snapshots.current(spark, path).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("total"))
        row = seen.select(F.lit(step).cast("bigint").alias("step"), F.lit(status["replaced"]).alias("replaced"),
                          F.lit(",".join(status["missing"])).alias("missing"), F.lit(status["version"]).alias("version"), "n_rows", "total")
        out = row if out is None else out.unionByName(row)
    return out
