"""Window-function queries."""

from pyspark.sql import functions as F

from ..catalog import GRID_SQL, GRID1_SQL, R, register, ts_text
from ..operators import timeseries as tsa
from ..operators import windows as win
from ..sources import tables as src

ORDERS_DAILY_SQL = """
SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts,
       count(*) AS n_orders, sum(o_totalprice) AS revenue
FROM orders GROUP BY 1, 2
"""


@register("w0_position", f"""
WITH g AS ({GRID_SQL})
SELECT series_id, {ts_text('ts')} AS ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos
FROM g
""")
def q_position(spark, sf_dir):
    """Dense chronological position via per-day offsets (no per-series window)."""
    g = src.grid_hourly(spark, sf_dir)
    return win.with_position(g, ["series_id"], "ts").select("series_id", "ts", F.col(win.IDX).alias("pos"))


@register("w_orders_daily_windows", f"""
WITH o AS ({ORDERS_DAILY_SQL})
SELECT series_id, {ts_text('ts')} AS ts, n_orders, round(revenue, 6) AS revenue,
  lag(n_orders, 1) OVER w AS orders_lag_1, lag(n_orders, 7) OVER w AS orders_lag_7,
  round(lead(revenue, 12) OVER w, 6) AS revenue_lead_12,
  round(avg(revenue) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 6) AS revenue_avg_prev24,
  round(avg(revenue) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS revenue_avg_incl24,
  round(CASE WHEN count(revenue) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
             THEN avg(revenue) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END, 6) AS revenue_avg_full24
FROM o WINDOW w AS (PARTITION BY series_id ORDER BY ts)
""")
def q_orders_daily_windows(spark, sf_dir):
    """W1/W2/W3/W4/W5 on the daily order series (one series per priority)."""
    d = src.orders_daily(spark, sf_dir)
    lay = win.layout(d, ["series_id"], "ts", back=24, fwd=12)
    w = lay.window()
    return lay.finish(lay.df.withColumns({
        "orders_lag_1": win.lag_rows("n_orders", 1, w),
        "orders_lag_7": win.lag_rows("n_orders", 7, w),
        "revenue_lead_12": win.lead_rows("revenue", 12, w),
        "revenue_avg_prev24": win.rolling_mean("revenue", 24, w),
        "revenue_avg_incl24": win.rolling_mean("revenue", 24, w, include_current=True),
        "revenue_avg_full24": win.rolling_mean("revenue", 24, w, include_current=True, full=True),
    }))


_EWM_R = 1.0 - 2.0 / 25.0


def _ewm_sql(col):
    wt = f"CASE WHEN {col} IS NOT NULL THEN pow({1.0 / _EWM_R!r}, idx) END"
    return (f"sum({wt} * {col}) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
            f" / sum({wt}) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING)")


@register("w6_ewm", f"""
WITH g AS ({GRID_SQL}),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx FROM g)
SELECT series_id, {ts_text('ts')} AS ts, {R('load')} AS load, {R('price')} AS price,
       {R(_ewm_sql('load'))} AS load_ewm24, {R(_ewm_sql('price'))} AS price_ewm24
FROM p
""")
def q_ewm(spark, sf_dir):
    """Exponentially weighted mean, span 24, nulls decay the weights."""
    g = src.grid_hourly(spark, sf_dir).select("series_id", "ts", "load", "price")
    lay = win.layout(g, ["series_id"], "ts", back=win.EWM_HALO)
    return lay.finish(win.ewm_means(lay, lay.df, [("load", "load_ewm24"), ("price", "price_ewm24")]))


@register("w7_interpolate", f"""
WITH g AS ({GRID_SQL}),
p AS (SELECT series_id, ts, price, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx FROM g),
q AS (SELECT *,
  last_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(CASE WHEN price IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
  first_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN price IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
  FROM p)
SELECT series_id, {ts_text('ts')} AS ts, {R('price')} AS price,
  {R('CASE WHEN price IS NOT NULL THEN price WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv '
     'ELSE pv + (nv - pv) * (CAST(idx - pi AS DOUBLE) / CAST(ni - pi AS DOUBLE)) END')} AS price_interp
FROM q
""")
def q_interpolate(spark, sf_dir):
    """Linear positional interpolation of price (two-level carry)."""
    g = src.grid_hourly(spark, sf_dir).select("series_id", "ts", "price")
    lay = win.layout(g, ["series_id"], "ts")
    return lay.finish(win.interpolate_linear(lay, lay.df, "price", "price_interp"))


_DECOMP_SQL = f"""
WITH g AS ({GRID1_SQL}),
s AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM g GROUP BY 1),
h AS (SELECT s.series_id, s.ts, g.load, row_number() OVER (PARTITION BY s.series_id ORDER BY s.ts) - 1 AS idx
      FROM s LEFT JOIN g ON s.series_id = g.series_id AND s.ts = g.ts),
k AS (SELECT *, last_value(load IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN load IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS pi,
             first_value(load IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN load IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS ni
      FROM h WINDOW b AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    a AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p AS (SELECT series_id, ts, idx, CASE WHEN load IS NOT NULL THEN load WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
             ELSE pv + (nv - pv) * (CAST(idx - pi AS DOUBLE) / CAST(ni - pi AS DOUBLE)) END AS load FROM k),
t AS (SELECT *, CAST(idx % 24 AS INTEGER) AS phase,
  CASE WHEN count(load) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25
       THEN (sum(load) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)
             - (lag(load, 12) OVER (PARTITION BY series_id ORDER BY idx) + lead(load, 12) OVER (PARTITION BY series_id ORDER BY idx)) / 2.0) / 24.0
  END AS trend FROM p),
ph0 AS (SELECT series_id, phase, avg(load - trend) AS pa, avg(load / trend) AS pm FROM t GROUP BY 1, 2),
ph AS (SELECT series_id, phase, pa - avg(pa) OVER (PARTITION BY series_id) AS seasonal_add,
              pm / avg(pm) OVER (PARTITION BY series_id) AS seasonal_mul FROM ph0)
"""


_DECOMP_ROWS = f"""
SELECT t.series_id, {ts_text('ts')} AS ts, CAST(t.phase AS BIGINT) AS phase, {R('load')} AS load, {R('trend')} AS trend,
  {R('seasonal_add')} AS seasonal_add, {R('seasonal_mul')} AS seasonal_mul,
  {R('load - trend - seasonal_add')} AS resid_add, {R('load / seasonal_mul / trend')} AS resid_mul
FROM t JOIN ph USING (series_id, phase)
"""


def _hourly_load(spark, sf_dir):
    return tsa.hourly_filled(src.grid_hourly(spark, sf_dir, n_series=1), "load", ["series_id"], "ts")


@register("d1_decompose", _DECOMP_SQL + _DECOMP_ROWS)
def q_decompose(spark, sf_dir):
    """D1 (+W8): classical decomposition, period 24, of the gap-free single-series load."""
    return tsa.decompose(_hourly_load(spark, sf_dir), "load", ["series_id"], "ts", 24)


@register("d2_seasonal_profile", _DECOMP_SQL + f"""
SELECT series_id, CAST(phase AS BIGINT) AS phase, {R('seasonal_add')} AS seasonal_add, {R('seasonal_mul')} AS seasonal_mul FROM ph
""")
def q_seasonal_profile(spark, sf_dir):
    """24-phase daily seasonal figure of the gap-free load."""
    return tsa.seasonal_profile(_hourly_load(spark, sf_dir), "load", ["series_id"], "ts", 24)


@register("d2_week_slice", _DECOMP_SQL + _DECOMP_ROWS + " WHERE idx < 168")
def q_week_slice(spark, sf_dir):
    """Decomposition of the first week (168 hours) of the load."""
    d = tsa.decompose(_hourly_load(spark, sf_dir), "load", ["series_id"], "ts", 24)
    return tsa.week_slice(d, ["series_id"], "ts", 168)


@register("w9_average_rank", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, round(l_quantity, 6) AS l_quantity,
  round(rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
        + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0, 6) AS qty_rank
FROM lineitem
""")
def q_average_rank(spark, sf_dir):
    """Average rank with ties (distinct-count table + running sum + join)."""
    li = src.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return win.average_rank(li, "l_quantity", "qty_rank", keys=["l_returnflag"])


@register("a13_daily_mean", f"""
WITH g AS ({GRID_SQL}),
a AS (SELECT series_id, date_trunc('day', ts) AS ts, avg(load) AS load, avg(price) AS price FROM g GROUP BY 1, 2),
b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM a GROUP BY 1),
s AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM b)
SELECT s.series_id, {ts_text('s.ts')} AS ts, {R('a.load')} AS load, {R('a.price')} AS price
FROM s LEFT JOIN a ON s.series_id = a.series_id AND s.ts = a.ts
""")
def q_daily_mean(spark, sf_dir):
    """Daily resample mean; empty days appear as null rows."""
    g = src.grid_hourly(spark, sf_dir)
    return tsa.resample_mean(g, ["series_id"], "ts", ["load", "price"], "day", "1 day")


@register("d6_long_form", f"""
WITH g AS ({GRID_SQL})
SELECT series_id, {ts_text('ts')} AS ts, measure, {R('value')} AS value
FROM g UNPIVOT INCLUDE NULLS (value FOR measure IN (load, price))
""")
def q_long_form(spark, sf_dir):
    """Actual series in long form for overlays."""
    g = src.grid_hourly(spark, sf_dir)
    return tsa.long_form(g, ["series_id"], "ts", ["load", "price"])
