"""Stationarity tests (D4 ADF, D5 KPSS) as Spark aggregations.

Row-level work (differences, lags, residuals, partial sums, lagged
products) is distributed; what reaches the driver is a d x d matrix of moments or
a few scalars, whose size depends on the lag order, never on the rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import windows as win
from .moments import centred_moments

# ---- fixed values: ADF p-value approximation for the constant-only case ----
# (MacKinnon 1994, one variable): tau bounds and polynomial coefficients.
ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR = 2.74, -18.83, -1.61
ADF_SMALLP = (2.1659, 1.4412, 0.038269)
ADF_LARGEP = (1.7339, 0.93202, -0.12745, -0.010368)
# ---- fixed values: ADF critical values, constant-only (MacKinnon 2010) -----
ADF_CRIT = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040),
            "10%": (-2.56677, -1.5384, -2.809, 0.0)}
# ---- fixed values: KPSS critical values with trend ('ct') ------------------
KPSS_CT_CRIT = {"10%": 0.119, "5%": 0.146, "2.5%": 0.176, "1%": 0.216}


def _norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def adf_pvalue(stat: float) -> float:
    if stat > ADF_TAU_MAX:
        return 1.0
    if stat < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALLP if stat <= ADF_TAU_STAR else ADF_LARGEP
    return _norm_cdf(sum(c * stat ** i for i, c in enumerate(coef)))


def adf(df: DataFrame, x: str, keys=("series_id",), ts: str = "ts", maxlag: int | None = None) -> dict:
    """Augmented Dickey-Fuller test with a constant, lag order by AIC.

    All candidate orders are fitted on the common sample from one pass of
    centred moments (each order is a sub-block; centring stands for the
    constant), then the chosen order is refitted on its full sample with a second
    pass.  The result does not depend on the level of the series.
    """
    keys = list(keys)
    n = df.where(F.col(x).isNotNull()).count()
    if maxlag is None:
        maxlag = int(math.ceil(12.0 * (n / 100.0) ** 0.25))
        maxlag = min(n // 2 - 2, maxlag)
    lay = win.layout(df.select(*keys, ts, x), keys, ts, back=maxlag + 2)
    w = lay.window()
    dy = F.col(x) - F.lag(x, 1).over(w)
    d = lay.df.withColumn("_dy", dy)
    cols = {"_ylag": F.lag(x, 1).over(w)}
    for i in range(1, maxlag + 1):
        cols[f"_dl{i}"] = F.lag("_dy", i).over(w)
    d = lay.finish(d.withColumns(cols), keep_idx=True)
    names = ["_dy", "_ylag"] + [f"_dl{i}" for i in range(1, maxlag + 1)]
    moments = centred_moments(d, names)
    nobs = moments.n
    best = None
    for p in range(0, maxlag + 1):
        _, ssr, _ = moments.least_squares(0, list(range(1, p + 2)))
        k = p + 2
        llf = -nobs / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1.0)
        aic = -2.0 * llf + 2.0 * k
        if best is None or aic < best[0]:
            best = (aic, p)
    p = best[1]
    refit = centred_moments(d, names[:p + 2])
    n2 = refit.n
    beta, ssr, own = refit.least_squares(0, list(range(1, p + 2)))
    sigma2 = ssr / (n2 - p - 2)
    se = math.sqrt(sigma2 * np.linalg.inv(own)[0, 0])
    stat = float(beta[0] / se)
    crit = {k: c[0] + c[1] / n2 + c[2] / n2 ** 2 + c[3] / n2 ** 3 for k, c in ADF_CRIT.items()}
    return {"adf_stat": stat, "p_value": adf_pvalue(stat), "used_lag": p, "nobs": n2, "critical": crit,
            "ic_best": float(best[0])}


def kpss(df: DataFrame, x: str, keys=("series_id",), ts: str = "ts", nlags: int | None = None) -> dict:
    """KPSS test around a deterministic trend ('ct'), automatic lags.

    Detrending by ``regr_slope/regr_intercept`` on the position, partial
    sums by the two-level distributed running sum, autocovariances of the
    residuals by one lag-window aggregation; p-value interpolated in the
    critical-value table and clamped to [0.01, 0.10].
    """
    keys = list(keys)
    lay = win.layout(df.select(*keys, ts, x).where(F.col(x).isNotNull()), keys, ts)
    d = cut_lineage(lay.finish(keep_idx=True))          # each of the passes reads it
    fit = d.agg(F.regr_slope(x, win.IDX).alias("b"), F.regr_intercept(x, win.IDX).alias("a"),
                F.count(F.lit(1)).alias("n")).first()
    n = int(fit["n"])
    e = d.withColumn("_e", F.col(x) - (F.lit(fit["a"]) + F.lit(fit["b"]) * F.col(win.IDX)))
    cum = win.running_sums(e.select(*keys, win.IDX, "_e"), keys, win.IDX, ["_e"])
    eta = cum.agg(F.sum(F.col("cum__e") * F.col("cum__e")).alias("s")).first()["s"] / n ** 2
    covlags = int(n ** (2.0 / 9.0))

    def autocov(L):
        lay2 = win.layout(e.select(*keys, ts, "_e"), keys, ts, back=max(L, 1))
        w = lay2.window()
        cols = {f"_p{i}": F.col("_e") * F.lag("_e", i).over(w) for i in range(1, L + 1)}
        dd = lay2.finish(lay2.df.withColumns(cols))
        r = dd.agg(F.sum(F.col("_e") * F.col("_e")).alias("p0"), *[F.sum(f"_p{i}").alias(f"p{i}") for i in range(1, L + 1)]).first()
        return [float(r["p0"])] + [float(r[f"p{i}"] or 0.0) for i in range(1, L + 1)]

    if nlags is None:
        pr = autocov(covlags)
        s0 = pr[0] / n
        s1 = 0.0
        for i in range(1, covlags + 1):
            v = pr[i] / (n / 2.0)
            s0 += v
            s1 += i * v
        gamma = 1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0)
        nlags = min(int(gamma * n ** (1.0 / 3.0)), n - 1)
    pr = autocov(nlags)
    s_hat = pr[0] + sum(2.0 * pr[i] * (1.0 - i / (nlags + 1.0)) for i in range(1, nlags + 1))
    s_hat /= n
    stat = float(eta / s_hat)
    crit = KPSS_CT_CRIT
    xs, ps = [crit["10%"], crit["5%"], crit["2.5%"], crit["1%"]], [0.10, 0.05, 0.025, 0.01]
    p = float(np.interp(stat, xs, ps))
    return {"kpss_stat": stat, "p_value": p, "lags": nlags, "nobs": n, "critical": dict(crit)}
