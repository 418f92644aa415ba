"""Lookup / join queries."""

from pyspark.sql import functions as F

from .. import config as C
from ..catalog import FEATURES_SQL, GRID_SQL, GRID1_SQL, R, register, ts_text
from ..functions import columns as col
from ..operators import lookup as lk
from ..plans import features as fe
from ..plans.requests import LAG_LOOKUPS, request_features, slot_lags, slot_means
from ..session import cut_lineage
from ..sources import tables as src


def R9(expr):
    return R(expr, 9)

REQ_SQL = """
SELECT event_id AS request_id, CAST(user_id % 8 AS BIGINT) AS series_id,
       CASE WHEN event_type IN ('view', 'click') THEN date_trunc('hour', ts) ELSE ts END AS ts,
       CASE WHEN event_type = 'view' THEN value ELSE 0.0 END AS solar,
       CASE WHEN event_type = 'click' THEN value ELSE 0.0 END AS wind,
       CASE WHEN event_type = 'error' THEN value ELSE 0.0 END AS gas,
       CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS coal,
       CASE WHEN event_type = 'signup' THEN value ELSE 0.0 END AS nuclear, 0.0 AS hydro
FROM events
"""

ASOF_SQL = f"""
WITH g AS ({GRID_SQL}),
r AS ({REQ_SQL}),
rp AS (SELECT *, ts - INTERVAL 1 HOUR AS p1, ts - INTERVAL 24 HOUR AS p24, ts - INTERVAL 168 HOUR AS p168 FROM r),
m1 AS (SELECT rp.request_id, g.ts AS mt, g.load, g.price FROM rp ASOF LEFT JOIN g ON rp.series_id = g.series_id AND rp.p1 >= g.ts),
m24 AS (SELECT rp.request_id, g.ts AS mt, g.load, g.price FROM rp ASOF LEFT JOIN g ON rp.series_id = g.series_id AND rp.p24 >= g.ts),
m168 AS (SELECT rp.request_id, g.ts AS mt, g.load FROM rp ASOF LEFT JOIN g ON rp.series_id = g.series_id AND rp.p168 >= g.ts),
lags AS (
  SELECT m1.request_id,
    CASE WHEN m1.mt IS NULL THEN 28000.0 ELSE m1.load END AS demand_lag_1h,
    CASE WHEN m24.mt IS NULL THEN 28000.0 ELSE m24.load END AS demand_lag_24h,
    CASE WHEN m168.mt IS NULL THEN 28000.0 ELSE m168.load END AS demand_lag_168h,
    CASE WHEN m1.mt IS NULL THEN 50.0 ELSE m1.price END AS price_lag_1h,
    CASE WHEN m24.mt IS NULL THEN 50.0 ELSE m24.price END AS price_lag_24h
  FROM m1 JOIN m24 USING (request_id) JOIN m168 USING (request_id)),
iv AS (SELECT r.request_id, count(*) AS n_hist, avg(g.load) AS avg_load, avg(g.price) AS avg_price
       FROM r JOIN g ON r.series_id = g.series_id AND g.ts BETWEEN r.ts - INTERVAL 24 HOUR AND r.ts - INTERVAL 1 HOUR
       GROUP BY 1)
"""


@register("j1_asof_lookup", ASOF_SQL + f"""
SELECT request_id, {R('demand_lag_1h')} AS demand_lag_1h, {R('demand_lag_24h')} AS demand_lag_24h,
       {R('demand_lag_168h')} AS demand_lag_168h, {R('price_lag_1h')} AS price_lag_1h,
       {R('price_lag_24h')} AS price_lag_24h FROM lags
""")
def q_asof(spark, sf_dir):
    """Backward as-of lookups at ts-1h/24h/168h with defaults."""
    req = src.requests_from_events(spark, sf_dir)
    hist = cut_lineage(src.grid_hourly(spark, sf_dir))
    out = lk.by_slot(req, ["series_id"], "ts", slot_lags(hist, ["series_id"], "ts", LAG_LOOKUPS))
    return out.select("request_id", *LAG_LOOKUPS)


@register("j2_interval_mean", ASOF_SQL + f"""
SELECT request_id, n_hist, {R9('avg_load')} AS avg_load, {R9('avg_price')} AS avg_price FROM iv
""", digits=9)
def q_interval(spark, sf_dir):
    """Mean of history in [ts-24h, ts-1h]; requests without history there are left out."""
    req = src.requests_from_events(spark, sf_dir)
    hist = src.grid_hourly(spark, sf_dir)
    out = lk.by_slot(req, ["series_id"], "ts", slot_means(hist, ["series_id"], "ts"))
    return out.where("n_hist > 0").select("request_id", "n_hist", "avg_load", "avg_price")


@register("m3_request_features", ASOF_SQL + f"""
SELECT r.request_id, r.series_id,
  CAST(hour(r.ts) AS BIGINT) AS hour, CAST(isodow(r.ts) - 1 AS BIGINT) AS day_of_week,
  CAST(month(r.ts) AS BIGINT) AS month, CAST(isodow(r.ts) >= 6 AS BIGINT) AS is_weekend,
  {R9('sin(2 * pi() * hour(r.ts) / 24)')} AS hour_sin, {R9('cos(2 * pi() * hour(r.ts) / 24)')} AS hour_cos,
  {R9('sin(2 * pi() * month(r.ts) / 12)')} AS month_sin, {R9('cos(2 * pi() * month(r.ts) / 12)')} AS month_cos,
  {R9('solar + wind + hydro')} AS renewable, {R9('gas + coal')} AS fossil, {R9('nuclear')} AS nuclear,
  {R9('solar + wind + hydro + gas + coal + nuclear')} AS total_gen,
  {R9('CASE WHEN solar + wind + hydro + gas + coal + nuclear > 0 THEN (solar + wind + hydro) / (solar + wind + hydro + gas + coal + nuclear) * 100 ELSE 0 END')} AS renewable_pct,
  {R9('demand_lag_1h')} AS demand_lag_1h, {R9('demand_lag_24h')} AS demand_lag_24h, {R9('demand_lag_168h')} AS demand_lag_168h,
  {R9('price_lag_1h')} AS price_lag_1h, {R9('price_lag_24h')} AS price_lag_24h,
  {R9('CASE WHEN coalesce(n_hist, 0) > 0 THEN avg_load ELSE demand_lag_1h END')} AS demand_avg_24h,
  {R9('CASE WHEN coalesce(n_hist, 0) > 0 THEN avg_price ELSE price_lag_1h END')} AS price_avg_24h
FROM r JOIN lags USING (request_id) LEFT JOIN iv USING (request_id)
""", digits=9)
def q_request_features(spark, sf_dir):
    """M3: request feature extraction against the hourly history."""
    req = src.requests_from_events(spark, sf_dir)
    hist = cut_lineage(src.grid_hourly(spark, sf_dir))      # hourly; read once per lookup
    out = request_features(req, hist)
    return out.drop("ts", "solar", "wind", "gas", "coal", "hydro")


_CLASS_SQL = FEATURES_SQL.replace(GRID_SQL, GRID1_SQL) + """
, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS cnt FROM f),
th AS (SELECT quantile_cont(demand_12h, 0.33) AS d33, quantile_cont(demand_12h, 0.66) AS d66,
              quantile_cont(price_12h, 0.33) AS p33, quantile_cont(price_12h, 0.66) AS p66
       FROM n WHERE idx < floor(0.8 * cnt)),
c AS (SELECT n.ts,
        CASE WHEN demand_12h <= d33 THEN 'Low' WHEN demand_12h <= d66 THEN 'Medium' ELSE 'High' END AS demand_class,
        CASE WHEN price_12h <= p33 THEN 'Low' WHEN price_12h <= p66 THEN 'Medium' ELSE 'High' END AS price_class
      FROM n, th)
"""

_REC_VALUES = ", ".join("('{}', '{}', '{}')".format(d, p, t.replace("'", "''")) for (d, p), t in C.REC_TABLE.items())


@register("j3_recommendation_lookup", _CLASS_SQL + f"""
, rec AS (SELECT * FROM (VALUES {_REC_VALUES}) t(dc, pc, recommendation))
SELECT {ts_text('c.ts')} AS ts, demand_class, price_class,
  CAST(CASE demand_class WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE 1 END AS BIGINT) AS demand_code,
  CAST(CASE price_class WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE 1 END AS BIGINT) AS price_code,
  coalesce(rec.recommendation, 'No recommendation available.') AS recommendation
FROM c LEFT JOIN rec ON c.demand_class = rec.dc AND c.price_class = rec.pc
""")
def q_recommendation_lookup(spark, sf_dir):
    """F7 + J3 + J4: train-split thresholds -> classes -> codes -> advice text."""
    from ..operators.ml import chrono_split_label
    from ..operators.profile import quantile_row, scalars
    f = fe.training_features(src.grid_hourly(spark, sf_dir, n_series=1))
    f = chrono_split_label(f, ["series_id"], "ts", guard=False)
    th = quantile_row(f.where(F.col("split") == "train"), {
        "d33": ("demand_12h", 0.33), "d66": ("demand_12h", 0.66), "p33": ("price_12h", 0.33), "p66": ("price_12h", 0.66)})
    t = scalars(th)
    c = f.select("ts", col.three_class("demand_12h", t["d33"], t["d66"]).alias("demand_class"),
                 col.three_class("price_12h", t["p33"], t["p66"]).alias("price_class"))
    c = c.withColumn("demand_code", col.class_code("demand_class")).withColumn("price_code", col.class_code("price_class"))
    return lk.recommend_text(c, "demand_class", "price_class")


@register("j7_scenario_expansion", f"""
WITH r AS ({REQ_SQL}),
s AS (SELECT request_id, unnest(range(0, 12)) AS step, ts FROM r)
SELECT request_id, CAST(step AS BIGINT) AS step, {ts_text('ts + step * INTERVAL 1 HOUR')} AS step_ts,
       CAST(hour(ts + step * INTERVAL 1 HOUR) AS BIGINT) AS hour,
       {R('sin(2 * pi() * hour(ts + step * INTERVAL 1 HOUR) / 24)')} AS hour_sin
FROM s
""")
def q_scenario(spark, sf_dir):
    """Each request x the next 12 hourly steps with step calendar features."""
    req = src.requests_from_events(spark, sf_dir).select("request_id", "ts")
    e = lk.scenario_expand(req, "ts", 12)
    return e.select("request_id", "step", F.date_format("step_ts", "yyyy-MM-dd HH:mm:ss").alias("step_ts"),
                    F.hour("step_ts").alias("hour"), col.cyclic(F.hour("step_ts"), 24, "sin").alias("hour_sin"))


@register("m4_form_defaults", f"""
WITH g AS ({GRID_SQL}),
l AS (SELECT series_id, ts,
        lag(load, 1) OVER w AS demand_lag_1h, lag(load, 24) OVER w AS demand_lag_24h,
        lag(price, 1) OVER w AS price_lag_1h, lag(price, 24) OVER w AS price_lag_24h,
        avg(load) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS demand_avg_24h,
        avg(price) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS price_avg_24h
      FROM g WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT {R('coalesce(demand_lag_1h, 28000.0)')} AS demand_lag_1h, {R('coalesce(demand_lag_24h, 27500.0)')} AS demand_lag_24h,
  {R('coalesce(price_lag_1h, 58.0)')} AS price_lag_1h, {R('coalesce(price_lag_24h, 57.5)')} AS price_lag_24h,
  {R('coalesce(demand_avg_24h, 27800.0)')} AS demand_avg_24h, {R('coalesce(price_avg_24h, 58.0)')} AS price_avg_24h,
  CAST(7800.0 AS DOUBLE) AS "forecast wind onshore day ahead", CAST(4200.0 AS DOUBLE) AS "forecast solar day ahead",
  CAST(28000.0 AS DOUBLE) AS "total load forecast"
FROM l
""")
def q_form_defaults(spark, sf_dir):
    """M4: feature vector with the form defaults for absent / null entries."""
    g = src.grid_hourly(spark, sf_dir)
    spec = C.FeatureSpec(demand_lags=(1, 24), price_lags=(1, 24))
    lags = fe.add_lags(g, spec, ["series_id"], "ts")
    return fe.request_features_from_values(lags, C.DEMAND_FORM_DEFAULTS)


@register("m4_price_form_defaults", f"""
WITH g AS ({GRID_SQL}),
l AS (SELECT lag(price, 1) OVER w AS price_lag_1h, lag(price, 12) OVER w AS price_lag_12h,
        lag(load, 1) OVER w AS demand_lag_1h, lag(load, 12) OVER w AS demand_lag_12h,
        avg(load) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS demand_avg_24h,
        avg(price) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS price_avg_24h
      FROM g WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT {', '.join(f'{R(f"coalesce({c}, CAST({v} AS DOUBLE))" if "lag" in c or "avg" in c else f"CAST({v} AS DOUBLE)")} AS "{c}"'
                  for c, v in C.PRICE_FORM_DEFAULTS.items())}
FROM l
""")
def q_price_form_defaults(spark, sf_dir):
    """M4: price form of the feature vector with its defaults."""
    spec = C.FeatureSpec(demand_lags=(1, 12), price_lags=(1, 12))
    lags = fe.add_lags(src.grid_hourly(spark, sf_dir), spec, ["series_id"], "ts")
    return fe.request_features_from_values(lags, C.PRICE_FORM_DEFAULTS)
