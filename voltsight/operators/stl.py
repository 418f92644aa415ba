"""D3: robust STL decomposition per series (``groupBy(series).applyInPandas``).

The LOESS passes follow Cleveland et al. (1990): cycle-subseries smoothing
with one extrapolated point at each end, a low-pass filter (two moving
averages of the period, one of 3, then LOESS), trend LOESS, and bisquare
robustness weights from 6 x median |residual| between outer passes.

Each series is one group: the robustness weights need the series-wide
median of the residuals, so a group cannot be cut into blocks without a
global step per outer pass.  The hourly grid table bounds a series to one
row per hour of the covered period.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def stl_numpy(y: np.ndarray, period: int, seasonal: int = 13, trend: int | None = None,
              low_pass: int | None = None, robust: bool = True, inner: int | None = None,
              outer: int | None = None):
    """Return (seasonal, trend, resid) of a gap-free series."""

    def nxt_odd(v):
        v = int(np.ceil(v))
        return v + 1 if v % 2 == 0 else v

    n = len(y)
    ns = nxt_odd(max(seasonal, 3))
    nt = nxt_odd(trend if trend is not None else 1.5 * period / (1 - 1.5 / ns))
    nl = nxt_odd(low_pass if low_pass is not None else period + 1)
    ni = inner if inner is not None else (2 if robust else 5)
    no = outer if outer is not None else (15 if robust else 0)

    def est(yv, nn, q, xs, nleft, nright, rw):
        h = max(xs - nleft, nright - xs)
        if q > nn:
            h += (q - nn) // 2
        j = np.arange(nleft, nright + 1)
        r = np.abs(j - xs).astype(float)
        w = np.zeros(len(j))
        h9, h1 = 0.999 * h, 0.001 * h
        inside = r <= h9
        w[inside] = np.where(r[inside] <= h1, 1.0, (1 - (r[inside] / h) ** 3) ** 3)
        if rw is not None:
            w = w * rw[nleft - 1:nright]
        a = w.sum()
        if a <= 0:
            return None
        w = w / a
        if h > 0:
            c0 = np.sum(w * j)
            c = np.sum(w * (j - c0) ** 2)
            if np.sqrt(c) > 0.001 * (nn - 1):
                b = (xs - c0) / c
                w = w * (b * (j - c0) + 1.0)
        return float(np.sum(w * yv[nleft - 1:nright]))

    def ess(yv, q, rw):
        """LOESS at every position at once (same windows and weights as
        the point-by-point form)."""
        nn = len(yv)
        if nn < 2:
            return yv.copy()
        pos = np.arange(1, nn + 1)
        if q >= nn:
            left = np.ones(nn, dtype=int)
            width = nn
        else:
            nsh = (q + 1) // 2
            left = np.clip(pos - nsh + 1, 1, nn - q + 1)
            width = q
        J = left[:, None] + np.arange(width)[None, :]
        right = left + width - 1
        h = np.maximum(pos - left, right - pos).astype(float)
        if q > nn:
            h = h + (q - nn) // 2
        r = np.abs(J - pos[:, None]).astype(float)
        hh = h[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(r <= 0.999 * hh, np.where(r <= 0.001 * hh, 1.0, (1 - (r / hh) ** 3) ** 3), 0.0)
        if rw is not None:
            w = w * rw[J - 1]
        a = w.sum(axis=1)
        ok = a > 0
        w = np.where(ok[:, None], w / np.where(ok, a, 1.0)[:, None], 0.0)
        c0 = np.sum(w * J, axis=1)
        c = np.sum(w * (J - c0[:, None]) ** 2, axis=1)
        lin = (h > 0) & (np.sqrt(c) > 0.001 * (nn - 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            b = np.where(lin, (pos - c0) / np.where(lin, c, 1.0), 0.0)
        w = np.where(lin[:, None], w * (b[:, None] * (J - c0[:, None]) + 1.0), w)
        out = np.sum(w * yv[J - 1], axis=1)
        return np.where(ok, out, yv)

    def ma(x, length):
        c = np.cumsum(np.insert(x, 0, 0.0))
        return (c[length:] - c[:-length]) / length

    rw = np.ones(n)
    season = np.zeros(n)
    trnd = np.zeros(n)
    userw = False
    for k in range(no + 1):
        for _ in range(ni):
            det = y - trnd
            C = np.empty(n + 2 * period)
            for j in range(period):
                sub = det[j::period]
                srw = rw[j::period] if userw else None
                kk = len(sub)
                sm = np.empty(kk + 2)
                sm[1:kk + 1] = ess(sub, ns, srw)
                v = est(sub, kk, ns, 0, 1, min(ns, kk), srw)
                sm[0] = sm[1] if v is None else v
                v = est(sub, kk, ns, kk + 1, max(1, kk - ns + 1), kk, srw)
                sm[kk + 1] = sm[kk] if v is None else v
                C[j::period] = sm[: len(C[j::period])]
            low = ess(ma(ma(ma(C, period), period), 3), nl, None)
            season = C[period:period + n] - low
            trnd = ess(y - season, nt, rw if userw else None)
        if k >= no:
            break
        r = np.abs(y - season - trnd)
        cmad = 6.0 * np.median(r)
        c9, c1 = 0.999 * cmad, 0.001 * cmad
        rw = np.where(r <= c1, 1.0, np.where(r <= c9, (1 - (r / cmad) ** 2) ** 2, 0.0)) if cmad > 0 else np.ones(n)
        userw = True
    return season, trnd, y - season - trnd


def stl_groups(df, keys, ts: str, x: str, period: int = 24, seasonal: int = 13, robust: bool = True):
    """D3 on every series in parallel: one ``applyInPandas`` group per series."""
    keys = list(keys)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, ts).schema.fields] +
                       [f"{x} double", "seasonal double", "trend double", "resid double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        pdf = pdf.sort_values(ts).reset_index(drop=True)
        y = pdf[x].to_numpy(dtype=float)
        s, t, r = stl_kernel(y, period, seasonal=seasonal, robust=robust)
        out = pdf[keys + [ts, x]].copy()
        out["seasonal"], out["trend"], out["resid"] = s, t, r
        return out

    stl_kernel = stl_numpy
    return df.select(*keys, ts, x).groupBy(*keys).applyInPandas(run, schema)
