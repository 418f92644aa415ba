"""Recommendation queries."""

from pyspark.sql import functions as F

from .. import config as C
from ..catalog import GRID_SQL, R, register, ts_text
from ..functions import columns as col
from ..operators import ml
from ..operators.profile import quantile_row
from ..plans import features as fe
from ..plans import recommend as rc
from ..plans.requests import request_features
from ..sources import tables as src
from .lookup import ASOF_SQL, REQ_SQL
from .models import SPLIT_SQL

_REC_VALUES = ", ".join("('{}', '{}', '{}')".format(d, p, t.replace("'", "''")) for (d, p), t in C.REC_TABLE.items())

PROFILE_SQL = SPLIT_SQL + f"""
, fit AS (SELECT regr_slope(demand_12h, demand_lag_24h) AS bd, regr_intercept(demand_12h, demand_lag_24h) AS ad,
                 regr_slope(price_12h, price_lag_24h) AS bp, regr_intercept(price_12h, price_lag_24h) AS ap,
                 quantile_cont(demand_12h, 0.33) AS d33, quantile_cont(demand_12h, 0.66) AS d66,
                 quantile_cont(price_12h, 0.33) AS p33, quantile_cont(price_12h, 0.66) AS p66
          FROM sp WHERE split = 'train'),
rq AS (SELECT quantile_cont(demand_12h, 0.33) AS r33, quantile_cont(demand_12h, 0.66) AS r66 FROM sp),
pf AS (SELECT CAST(epoch(ts) AS BIGINT) AS profile_id, ts,
         coalesce(demand_lag_24h, 0.0) * bd + ad AS pred_demand, coalesce(price_lag_24h, 0.0) * bp + ap AS pred_price,
         CASE WHEN demand_12h <= d33 THEN 0 WHEN demand_12h <= d66 THEN 1 ELSE 2 END AS demand_class_enc,
         CASE WHEN price_12h <= p33 THEN 0 WHEN price_12h <= p66 THEN 1 ELSE 2 END AS price_class_enc,
         CASE WHEN coalesce(demand_lag_24h, 0.0) * bd + ad < r33 THEN 0
              WHEN coalesce(demand_lag_24h, 0.0) * bd + ad < r66 THEN 1 ELSE 2 END AS cluster,
         hour_sin, hour_cos, month_sin, month_cos, renewable_pct, is_weekend
       FROM sp, fit, rq WHERE split = 'test'),
pv AS (SELECT *, CAST([pred_demand, pred_price, demand_class_enc, price_class_enc, cluster, hour_sin, hour_cos,
                       month_sin, month_cos, renewable_pct, is_weekend] AS DOUBLE[]) AS vec FROM pf),
rec AS (SELECT * FROM (VALUES {_REC_VALUES}) t(dc, pc, recommendation))
"""


def _vote_sql(pairs_cte: str) -> str:
    return f""",
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, nid) AS rank FROM {pairs_cte}) WHERE rank <= 5),
dm AS (SELECT qid, arg_max(v, struct_pack(c := c, nv := -v)) AS dm FROM
         (SELECT qid, demand_class_enc AS v, count(*) AS c FROM nb GROUP BY 1, 2) GROUP BY qid),
pm AS (SELECT qid, arg_max(v, struct_pack(c := c, nv := -v)) AS pm FROM
         (SELECT qid, price_class_enc AS v, count(*) AS c FROM nb GROUP BY 1, 2) GROUP BY qid),
vt AS (SELECT nb.qid, dm, pm, count_if(demand_class_enc = dm AND price_class_enc = pm) / 5.0 AS confidence,
              string_agg(strftime(nts, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY rank) AS similar_hours
       FROM nb JOIN dm USING (qid) JOIN pm USING (qid) GROUP BY nb.qid, dm, pm),
lab AS (SELECT *, CASE dm WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS demand_class,
                  CASE pm WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS price_class FROM vt),
res AS (SELECT lab.*, coalesce(rec.recommendation, 'No recommendation available.') AS recommendation
        FROM lab LEFT JOIN rec ON lab.demand_class = rec.dc AND lab.price_class = rec.pc)
"""


def _fitted(spark, sf_dir):
    sp = ml.chrono_split_label(fe.training_features(src.grid_hourly(spark, sf_dir, n_series=1)),
                               ["series_id"], "ts", guard=False)
    from ..session import cut_lineage
    sp = cut_lineage(sp)          # read by every fit, the profiles and the neighbours
    train = sp.where(F.col("split") == "train")
    st = train.agg(F.regr_slope("demand_12h", "demand_lag_24h").alias("bd"),
                   F.regr_intercept("demand_12h", "demand_lag_24h").alias("ad"),
                   F.regr_slope("price_12h", "price_lag_24h").alias("bp"),
                   F.regr_intercept("price_12h", "price_lag_24h").alias("ap")).first()
    th = quantile_row(train, {"d33": ("demand_12h", 0.33), "d66": ("demand_12h", 0.66),
                              "p33": ("price_12h", 0.33), "p66": ("price_12h", 0.66)}).first()
    rq = quantile_row(sp, {"r33": ("demand_12h", 0.33), "r66": ("demand_12h", 0.66)}).first()
    # a fitted model: a handful of numbers, held on the driver like any model
    return sp, {**st.asDict(), **th.asDict(), **rq.asDict()}


def _predict(df, m):
    # model inputs go through the feature-row step (P17): null -> 0.0
    pd_ = F.coalesce(F.col("demand_lag_24h"), F.lit(0.0)) * F.lit(m["bd"]) + F.lit(m["ad"])
    pp_ = F.coalesce(F.col("price_lag_24h"), F.lit(0.0)) * F.lit(m["bp"]) + F.lit(m["ap"])
    cl = F.when(pd_ < F.lit(m["r33"]), 0).when(pd_ < F.lit(m["r66"]), 1).otherwise(2)
    return df.withColumn("pred_demand", pd_).withColumn("pred_price", pp_).withColumn("cluster", cl)


def profiles(spark, sf_dir):
    """Profile table of the test split."""
    sp, m = _fitted(spark, sf_dir)
    test = _predict(sp.where(F.col("split") == "test"), m)
    return test.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("profile_id"), "ts", "pred_demand",
                       "pred_price",
                       col.class_code(col.three_class("demand_12h", m["d33"], m["d66"])).alias("demand_class_enc"),
                       col.class_code(col.three_class("price_12h", m["p33"], m["p66"])).alias("price_class_enc"),
                       "cluster", "hour_sin", "hour_cos", "month_sin", "month_cos", "renewable_pct", "is_weekend"), m


_UNITS = ", ".join(f"{R(f'vec[{i}] / sqrt(list_aggregate(list_transform(vec, lambda x: x * x), {chr(39)}sum{chr(39)}))')} AS {c}_unit"
                   for i, c in enumerate(rc.PROFILE_COLS, 1))


@register("m29_profile_table", PROFILE_SQL + f"""
SELECT {ts_text('ts')} AS ts, {R('pred_demand')} AS pred_demand, {R('pred_price')} AS pred_price,
  CAST(demand_class_enc AS BIGINT) AS demand_class_enc, CAST(price_class_enc AS BIGINT) AS price_class_enc,
  CAST(cluster AS BIGINT) AS cluster,
  {_UNITS}
FROM pv
""")
def q_profile_table(spark, sf_dir):
    """Profile table with its eleven L2-normalised components."""
    from ..operators.similarity import l2_normalise
    p, _ = profiles(spark, sf_dir)
    v = l2_normalise(rc.profile_vector(p), "vec", "unit")
    return v.select("ts", "pred_demand", "pred_price", "demand_class_enc", "price_class_enc", "cluster",
                    *[F.col("unit")[i].alias(f"{c}_unit") for i, c in enumerate(rc.PROFILE_COLS)])


@register("m28_recommend_by_index", PROFILE_SQL + """,
pairs AS (SELECT a.profile_id AS qid, a.ts AS qts, b.profile_id AS nid, b.ts AS nts, b.demand_class_enc, b.price_class_enc,
                 list_cosine_similarity(a.vec, b.vec) AS score FROM pv a JOIN pv b ON a.profile_id <> b.profile_id)
""" + _vote_sql("pairs") + f"""
SELECT {ts_text('pv.ts')} AS ts, {R('pred_demand')} AS pred_demand, {R('pred_price')} AS pred_price, CAST(cluster AS BIGINT) AS cluster,
       CASE demand_class_enc WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS demand_class,
       CASE price_class_enc WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS price_class,
       demand_class AS voted_demand_class, price_class AS voted_price_class,
       round(confidence, 2) AS confidence, similar_hours, recommendation
FROM res JOIN pv ON res.qid = pv.profile_id
""")
def q_recommend_by_index(spark, sf_dir):
    """Neighbours of every stored hour (self excluded) -> vote -> advice."""
    p, _ = profiles(spark, sf_dir)
    return rc.recommend_by_index(p, "profile_id", 5).select(
        "ts", "pred_demand", "pred_price", "cluster", "demand_class", "price_class",
        "voted_demand_class", "voted_price_class", "confidence", "similar_hours", "recommendation")


REQ1_SQL = REQ_SQL.replace("CAST(user_id % 8 AS BIGINT)", "CAST(user_id % 1 AS BIGINT)")
ASOF_TAIL = ASOF_SQL.split(f"WITH g AS ({GRID_SQL}),", 1)[1].replace(REQ_SQL, REQ1_SQL)


@register("m27_recommend_from_requests", PROFILE_SQL + ", " + ASOF_TAIL + """,
qf AS (SELECT r.request_id, r.ts,
         coalesce(lags.demand_lag_24h, 0.0) * bd + ad AS pred_demand, coalesce(lags.price_lag_24h, 0.0) * bp + ap AS pred_price,
         hour(r.ts) AS hr, month(r.ts) AS mo, isodow(r.ts) AS dw,
         solar + wind + hydro AS ren, solar + wind + hydro + gas + coal + nuclear AS tot
       FROM r JOIN lags USING (request_id), fit),
qv AS (SELECT qf.request_id, pred_demand, pred_price,
         CASE WHEN pred_demand <= d33 THEN 0 WHEN pred_demand <= d66 THEN 1 ELSE 2 END AS dce,
         CASE WHEN pred_price <= p33 THEN 0 WHEN pred_price <= p66 THEN 1 ELSE 2 END AS pce,
         CASE WHEN pred_demand < r33 THEN 0 WHEN pred_demand < r66 THEN 1 ELSE 2 END AS cl,
         CAST([pred_demand, pred_price,
               CASE WHEN pred_demand <= d33 THEN 0 WHEN pred_demand <= d66 THEN 1 ELSE 2 END,
               CASE WHEN pred_price <= p33 THEN 0 WHEN pred_price <= p66 THEN 1 ELSE 2 END,
               CASE WHEN pred_demand < r33 THEN 0 WHEN pred_demand < r66 THEN 1 ELSE 2 END,
               sin(2 * pi() * hr / 24), cos(2 * pi() * hr / 24), sin(2 * pi() * mo / 12), cos(2 * pi() * mo / 12),
               CASE WHEN tot > 0 THEN ren / tot * 100 ELSE 0 END, CAST(dw >= 6 AS INTEGER)] AS DOUBLE[]) AS vec
       FROM qf, fit, rq),
pairs AS (SELECT q.request_id AS qid, p.profile_id AS nid, p.ts AS nts, p.demand_class_enc, p.price_class_enc,
                 list_cosine_similarity(q.vec, p.vec) AS score FROM qv q, pv p)
""" + _vote_sql("pairs") + """
SELECT qv.request_id, round_even(pred_demand, 1) AS predicted_demand_12h, round_even(pred_price, 2) AS predicted_price_12h,
       CAST(cl AS BIGINT) AS cluster, demand_class, price_class, round(confidence, 2) AS confidence, similar_hours, recommendation
FROM res JOIN qv ON res.qid = qv.request_id
""")
def q_recommend_from_requests(spark, sf_dir):
    """Request -> features (M3) -> predictions, classes, regime -> profile
    vector -> exact cosine top-5 over stored profiles -> vote -> advice."""
    p, m = profiles(spark, sf_dir)
    req = src.requests_from_events(spark, sf_dir, n_series=1)
    from ..session import cut_lineage
    feats = request_features(req, cut_lineage(src.grid_hourly(spark, sf_dir, n_series=1)))
    q = _predict(feats, m)
    q = q.select("request_id", "pred_demand", "pred_price", "cluster",
                 col.class_code(col.three_class("pred_demand", m["d33"], m["d66"])).alias("demand_class_enc"),
                 col.class_code(col.three_class("pred_price", m["p33"], m["p66"])).alias("price_class_enc"),
                 "hour_sin", "hour_cos", "month_sin", "month_cos", "renewable_pct", "is_weekend")
    r = rc.recommend_from_queries(q, p, "request_id", "profile_id", 5)
    return r.join(q.select("request_id", "pred_demand", "pred_price", "cluster"), "request_id").select(
        "request_id", F.bround("pred_demand", 1).alias("predicted_demand_12h"),
        F.bround("pred_price", 2).alias("predicted_price_12h"), "cluster", "demand_class", "price_class",
        "confidence", "similar_hours", "recommendation")
