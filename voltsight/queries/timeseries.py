"""Decomposition and stationarity queries (D3-D5); statistics come from
estimators, so the driver records rows-only checks."""

from pyspark.sql import functions as F

from ..catalog import GRID1_SQL, R, register
from ..operators import stationarity as st
from ..operators import stl
from ..operators import windows as win
from ..sources import tables as src


def _filled(spark, sf_dir, n_series):
    g = src.grid_hourly(spark, sf_dir, n_series=n_series).select("series_id", "ts", "price", "load")
    lay = win.layout(g, ["series_id"], "ts")
    return lay.finish(win.interpolate_linear(lay, lay.df, "price", "price_filled"))


@register("d3_stl")
def q_stl(spark, sf_dir):
    """D3: robust STL (period 24, seasonal 13) of every series' load, in parallel per series."""
    g = src.grid_hourly(spark, sf_dir).select("series_id", "ts", "load")
    return stl.stl_groups(g, ["series_id"], "ts", "load", period=24, seasonal=13, robust=True)


@register("d4_adf")
def q_adf(spark, sf_dir):
    """Augmented Dickey-Fuller test (constant, AIC lag) of the interpolated price series."""
    d = _filled(spark, sf_dir, 1).where(F.col("price_filled").isNotNull())
    r = st.adf(d, "price_filled")
    return spark.createDataFrame([(r["adf_stat"], r["p_value"], r["used_lag"], r["nobs"], r["critical"]["1%"],
                                   r["critical"]["5%"], r["critical"]["10%"])],
                                 "adf_stat double, p_value double, used_lag int, nobs int, crit_1 double, crit_5 double, crit_10 double")


_CRIT = st.KPSS_CT_CRIT
_KPSS_P = ((_CRIT["10%"], .1), (_CRIT["5%"], .05), (_CRIT["2.5%"], .025), (_CRIT["1%"], .01))


@register("d5_kpss", f"""
WITH t AS (SELECT load, CAST(row_number() OVER (ORDER BY ts) - 1 AS DOUBLE) AS i FROM ({GRID1_SQL}) WHERE load IS NOT NULL),
f AS (SELECT regr_slope(load, i) AS b, regr_intercept(load, i) AS a, count(*) AS n FROM t),
e AS (SELECT i, load - (a + b * i) AS e FROM t, f),
eta AS (SELECT sum(c * c) AS c2 FROM (SELECT sum(e) OVER (ORDER BY i) AS c FROM e)),
ac AS (SELECT x.i - y.i AS lag, sum(x.e * y.e) AS p FROM e x JOIN e y ON y.i <= x.i GROUP BY 1),
s AS (SELECT n, max(p) FILTER (WHERE lag = 0) / n + coalesce(sum(2 * p / n) FILTER (WHERE lag BETWEEN 1 AND floor(pow(n, 2.0 / 9))), 0) AS s0,
             coalesce(sum(lag * 2 * p / n) FILTER (WHERE lag BETWEEN 1 AND floor(pow(n, 2.0 / 9))), 0) AS s1 FROM ac, f GROUP BY n),
l AS (SELECT n, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS lags FROM s),
v AS (SELECT l.n, lags, (max(p) FILTER (WHERE lag = 0) + coalesce(sum(2 * p * (1 - lag / (lags + 1))) FILTER (WHERE lag BETWEEN 1 AND lags), 0)) / l.n AS s
      FROM ac, l GROUP BY l.n, lags),
k AS (SELECT n, lags, c2 / (n * n) / s AS stat FROM v, eta)
SELECT {R('stat')} AS kpss_stat, {R('CASE WHEN stat <= ' + str(_KPSS_P[0][0]) + ' THEN 0.1 ' + ' '.join(
    f'WHEN stat <= {x1} THEN {p0} + (stat - {x0}) * ({p1} - {p0}) / ({x1} - {x0})' for (x0, p0), (x1, p1) in zip(_KPSS_P, _KPSS_P[1:])) + ' ELSE 0.01 END')} AS p_value,
       CAST(lags AS BIGINT) AS lags, CAST(n AS BIGINT) AS nobs FROM k
""")
def q_kpss(spark, sf_dir):
    """KPSS test around a trend of the single-series load."""
    g = src.grid_hourly(spark, sf_dir, n_series=1).select("series_id", "ts", "load")
    r = st.kpss(g, "load")
    return spark.createDataFrame([(r["kpss_stat"], r["p_value"], r["lags"], r["nobs"])],
                                 "kpss_stat double, p_value double, lags int, nobs int")
