"""Positional window operators (W0-W10) that scale past one task per series.

pandas-style ``shift``/``rolling``/``ewm``/``interpolate`` are *positional*:
row ``t`` looks at rows ``t-k``.  A plain ``Window.partitionBy(series_id)``
puts a whole series into one task, which breaks when one series holds a
third of all rows.  The layout used here instead:

1. **W0 dense index** - rows are counted per ``(series, day)`` (a tiny
   table), a running sum over that table gives each day's offset, and
   ``idx = offset + row_number() over (series, day)``.  No window ever sees
   more than one series-day.
2. **Halo blocks** - ``block = idx div B``; rows within ``back`` positions of
   the block end are copied into the next block (and ``fwd`` rows into the
   previous one).  Windows then run over ``(series, block)`` partitions of at
   most ``B + back + fwd`` rows and only *owner* rows are kept.
3. **Two-level carry** - unbounded operators (forward fill, linear
   interpolation, exact EWM) combine the in-block result with a per-block
   summary carried across the small block table.

There is one layout for every size; tests hold it against the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

IDX, BLK, OWN = "_idx", "_blk", "_own"
DEFAULT_BLOCK = 4096


@dataclass
class Layout:
    """A DataFrame laid out for positional windows."""

    df: DataFrame
    keys: list
    part: list           # window partition columns
    blocked: bool

    def window(self):
        return Window.partitionBy(*self.part).orderBy(IDX)

    def finish(self, df: DataFrame | None = None, keep_idx: bool = False) -> DataFrame:
        out = (df if df is not None else self.df)
        if self.blocked:
            out = out.where(F.col(OWN))
        drop = [BLK, OWN] + ([] if keep_idx else [IDX])
        return out.drop(*[c for c in drop if c in out.columns])


ROWS_PER_BUCKET = 1_000_000


def with_quantile_bucket(df: DataFrame, order: str, out: str, rows_per_bucket: int | None = None) -> DataFrame:
    """Equal-count range buckets of the order column (approximate quantiles,
    a bounded split list on the driver, applied by ``Bucketizer``): a hot day
    or hour is cut into as many buckets as its row count needs.  Exactness
    does not depend on the split points - they only decide where work is
    divided."""
    from pyspark.ml.feature import Bucketizer
    is_ts = dict(df.dtypes)[order].startswith("timestamp")
    key = F.unix_micros(F.col(order).cast("timestamp")) if is_ts else F.col(order)
    d = df.withColumn("_qk", key.cast("double"))
    n = d.count()
    nb = max(1, -(-n // (rows_per_bucket or ROWS_PER_BUCKET)))
    if nb == 1:
        return d.drop("_qk").withColumn(out, F.lit(0))
    splits = sorted(set(d.approxQuantile("_qk", [i / nb for i in range(1, nb)], 0.5 / nb)))
    b = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_qk", outputCol=out,
                   handleInvalid="keep")
    return b.transform(d).drop("_qk")


def _bucket(order: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(order)) if unit else F.lit(0)


def with_position(df: DataFrame, keys, order: str = "ts", tiebreak=(), bucket_unit: str = "day",
                  length: str | None = None) -> DataFrame:
    """Dense 0-based chronological position ``_idx`` within each series.

    The per-bucket count table has one row per (series, bucket); its running
    sum is the only window whose partition spans a whole series, and it is
    tiny (days, not rows).  ``bucket_unit='day'`` bounds a bucket by the
    grain (24 rows for the hourly table); ``'quantile'`` uses equal-count
    time ranges for inputs with no such bound (raw sub-second readings).
    ``length`` names a column for the number of rows of the series.
    """
    keys = list(keys)
    bkt = "_bkt"
    d = with_quantile_bucket(df, order, bkt) if bucket_unit == "quantile" else \
        df.withColumn(bkt, _bucket(order, bucket_unit))
    counts = d.groupBy(*keys, bkt).agg(F.count(F.lit(1)).alias("_n"))
    wrun = Window.partitionBy(*keys).orderBy(bkt).rowsBetween(Window.unboundedPreceding, -1)
    total = [F.sum("_n").over(Window.partitionBy(*keys)).alias(length)] if length else []
    offsets = counts.select(*keys, bkt, F.coalesce(F.sum("_n").over(wrun), F.lit(0)).alias("_off"), *total)
    # Merged, never broadcast: with rows below the threshold AQE may broadcast them to the
    # offsets, which lie by series, and then a series is in one task.  The shuffle is the
    # one the row_number window below needs anyway.
    d = d.join(offsets.hint("shuffle_merge"), on=keys + [bkt], how="inner")
    w = Window.partitionBy(*keys, bkt).orderBy(F.col(order), *[F.col(c) for c in tiebreak])
    return d.withColumn(IDX, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint")).drop(bkt, "_off")


def layout(df: DataFrame, keys, order: str = "ts", back: int = 0, fwd: int = 0,
           block_size: int | None = None, tiebreak=(),
           bucket_unit: str = "day", length: str | None = None) -> Layout:
    """Lay ``df`` out for positional windows needing ``back``/``fwd`` rows of context;
    ``length`` as in ``with_position``."""
    keys = list(keys)
    B = int(block_size or DEFAULT_BLOCK)
    if back > B or fwd > B:
        raise ValueError(f"block size {B} must be >= halo ({back} back, {fwd} forward)")
    d = with_position(df, keys, order, tiebreak, bucket_unit, length)
    blk = F.floor(F.col(IDX) / F.lit(B)).cast("bigint")
    pos = F.col(IDX) - blk * F.lit(B)
    copies = [F.struct(blk.alias("b"), F.lit(True).alias("o"))]
    if back:
        copies.append(F.when(pos >= B - back, F.struct((blk + 1).alias("b"), F.lit(False).alias("o"))))
    if fwd:
        copies.append(F.when(pos < fwd, F.struct((blk - 1).alias("b"), F.lit(False).alias("o"))))
    d = d.withColumn("_cp", F.explode(F.filter(F.array(*copies), lambda s: s.isNotNull())))
    d = d.withColumn(BLK, F.col("_cp.b")).withColumn(OWN, F.col("_cp.o")).drop("_cp")
    return Layout(d, keys, keys + [BLK], True)


def carry(lay: Layout, df: DataFrame, forward=(), backward=()) -> DataFrame:
    """Fill values across the whole series, several columns at once.

    ``forward``/``backward`` hold ``(value, out, idx_out or None)``: ``out``
    is the last (next) non-null ``value`` of an owner row at or before
    (after) the row, ``idx_out`` its position.  In-block ``last/first
    (ignorenulls)`` windows, plus - for blocks without such a value - one
    summary aggregation over the small block table, windows over it, and a
    single join back.
    """
    wf = lay.window().rowsBetween(Window.unboundedPreceding, 0)
    wbk = lay.window().rowsBetween(0, Window.unboundedFollowing)
    cols = {}
    for value, out, idx_out in forward:
        v = F.when(F.col(OWN), F.col(value)) if lay.blocked else F.col(value)
        cols[out] = F.last(v, ignorenulls=True).over(wf)
        if idx_out:
            cols[idx_out] = F.last(F.when(v.isNotNull(), F.col(IDX)), ignorenulls=True).over(wf)
    for value, out, idx_out in backward:
        v = F.when(F.col(OWN), F.col(value)) if lay.blocked else F.col(value)
        cols[out] = F.first(v, ignorenulls=True).over(wbk)
        if idx_out:
            cols[idx_out] = F.first(F.when(v.isNotNull(), F.col(IDX)), ignorenulls=True).over(wbk)
    df = df.withColumns(cols)
    if not lay.blocked:
        return df
    aggs, sel = [], []
    wprev = Window.partitionBy(*lay.keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    wnext = Window.partitionBy(*lay.keys).orderBy(BLK).rowsBetween(1, Window.unboundedFollowing)
    fills = []
    for n, (value, out, idx_out) in enumerate(forward):
        at = F.when(F.col(value).isNotNull(), F.col(IDX))
        aggs += [F.max_by(F.col(value), at).alias(f"_fv{n}"), F.max(at).alias(f"_fi{n}")]
        sel += [F.last(f"_fv{n}", ignorenulls=True).over(wprev).alias(f"_cfv{n}"),
                F.last(f"_fi{n}", ignorenulls=True).over(wprev).alias(f"_cfi{n}")]
        fills.append((out, f"_cfv{n}"))
        if idx_out:
            fills.append((idx_out, f"_cfi{n}"))
    for n, (value, out, idx_out) in enumerate(backward):
        at = F.when(F.col(value).isNotNull(), F.col(IDX))
        aggs += [F.min_by(F.col(value), at).alias(f"_bv{n}"), F.min(at).alias(f"_bi{n}")]
        sel += [F.first(f"_bv{n}", ignorenulls=True).over(wnext).alias(f"_cbv{n}"),
                F.first(f"_bi{n}", ignorenulls=True).over(wnext).alias(f"_cbi{n}")]
        fills.append((out, f"_cbv{n}"))
        if idx_out:
            fills.append((idx_out, f"_cbi{n}"))
    summ = df.where(F.col(OWN)).groupBy(*lay.part).agg(*aggs).select(*lay.part, *sel)
    df = df.join(summ, on=lay.part, how="left")
    df = df.withColumns({out: F.coalesce(F.col(out), F.col(c)) for out, c in fills})
    tmp = [f"_c{d}{k}{n}" for d, items in (("f", forward), ("b", backward)) for n in range(len(items)) for k in "vi"]
    return df.drop(*tmp)


def carry_forward(lay: Layout, df: DataFrame, value: str, out: str, idx_col: str | None = None) -> DataFrame:
    """Forward fill ``value`` (owner rows only) across the whole series."""
    return carry(lay, df, forward=[(value, out, idx_col)])


def carry_backward(lay: Layout, df: DataFrame, value: str, out: str, idx_col: str | None = None) -> DataFrame:
    """Backward fill (next non-null at or after the row)."""
    return carry(lay, df, backward=[(value, out, idx_col)])


# ---------------------------------------------------------------- operators
def lag_rows(x: str, k: int, w) -> Column:
    """Positional ``shift(k)``."""
    return F.lag(F.col(x), k).over(w)


def lead_rows(x: str, k: int, w) -> Column:
    """Positional ``shift(-k)``."""
    return F.lead(F.col(x), k).over(w)


def rolling_mean(x: str, n: int, w, include_current: bool = False, full: bool = False) -> Column:
    """W3/W4/W5 trailing means over ``n`` rows.

    ``include_current=False`` is ``rolling(n, min_periods=1).mean().shift(1)``
    (leak-free); ``True`` is ``rolling(n, min_periods=1).mean()``; ``full``
    requires ``n`` non-null values (``rolling(n).mean()``).
    """
    frame = w.rowsBetween(-n + 1, 0) if include_current else w.rowsBetween(-n, -1)
    avg = F.avg(F.col(x)).over(frame)
    if full:
        return F.when(F.count(F.col(x)).over(frame) == n, avg)
    return avg


def centred_ma(x: str, period: int, w) -> Column:
    """Centred 2xperiod moving average (even period), null at the edges
    and wherever the window holds a null (convolution semantics)."""
    h = period // 2
    frame = w.rowsBetween(-h, h)
    s = F.sum(F.col(x)).over(frame)
    ends = (F.lag(F.col(x), h).over(w) + F.lead(F.col(x), h).over(w)) / 2.0
    return F.when(F.count(F.col(x)).over(frame) == 2 * h + 1, (s - ends) / float(period))


EWM_HALO = 450


def ewm_means(lay: Layout, df: DataFrame, pairs, span: float = 24.0) -> DataFrame:
    """``ewm(span).mean()`` (adjust=True, nulls decay the weights) of
    several ``(column, out)`` pairs, sharing one carry step.

    Needs the block layout with ``back >= EWM_HALO``.  At an owner row with a
    value, the running ``sum(w_j x_j) / sum(w_j)`` from the block's first
    (halo) row, with ``w_j = r^-(j - block start)``: the common factor
    ``r^t`` cancels and the exponent stays below ``B + halo`` so it never
    overflows.  History older than the halo weighs < 1e-15 relative to the
    row's own weight of 1.  Rows without a value carry the last result
    forward, which is exact since nulls scale numerator and denominator alike.
    """
    if not lay.blocked:
        raise ValueError("ewm_means needs layout(..., back>=EWM_HALO)")
    r = 1.0 - 2.0 / (span + 1.0)
    run = lay.window().rowsBetween(Window.unboundedPreceding, 0)
    base = F.min(F.col(IDX)).over(Window.partitionBy(*lay.part))
    rel = (F.col(IDX) - base).cast("double")
    tmp = {}
    for n, (x, _) in enumerate(pairs):
        xv = F.col(x)
        wt = F.when(xv.isNotNull(), F.pow(F.lit(1.0 / r), rel))
        tmp[f"_ewm_at{n}"] = F.when(xv.isNotNull() & F.col(OWN), F.sum(wt * xv).over(run) / F.sum(wt).over(run))
    df = df.withColumns(tmp)
    df = carry(lay, df, forward=[(f"_ewm_at{n}", out, None) for n, (_, out) in enumerate(pairs)])
    return df.drop(*tmp)


def ewm_mean(lay: Layout, df: DataFrame, x: str, out: str, span: float = 24.0) -> DataFrame:
    """W6 for one column (see ``ewm_means``)."""
    return ewm_means(lay, df, [(x, out)], span)


def interpolate_linear(lay: Layout, df: DataFrame, x: str, out: str) -> DataFrame:
    """Pandas ``interpolate()`` (linear in position); leading nulls stay
    null, trailing nulls take the last value."""
    df = carry(lay, df, forward=[(x, "_pv", "_pi")], backward=[(x, "_nv", "_ni")])
    frac = (F.col(IDX) - F.col("_pi")).cast("double") / (F.col("_ni") - F.col("_pi")).cast("double")
    val = (F.when(F.col(x).isNotNull(), F.col(x))
            .when(F.col("_pv").isNull(), F.lit(None))
            .when(F.col("_nv").isNull(), F.col("_pv"))
            .otherwise(F.col("_pv") + (F.col("_nv") - F.col("_pv")) * frac))
    return df.withColumn(out, val.cast("double")).drop("_pv", "_pi", "_nv", "_ni")


# ------------------------------------------------------------ W9 / W10
def running_sums(df: DataFrame, keys, order: str, cols, inclusive: bool = True, n_buckets: int = 256,
                 rel_err: float = 0.001) -> DataFrame:
    """Running sums of ``cols`` along ``order`` within ``keys`` without a
    window over a whole key.

    Approximate quantiles of ``order`` (``n_buckets - 1`` split points, a
    bounded driver list) cut the rows into ordered range buckets; bucket
    totals are summed over the small (keys, bucket) table and joined back;
    the in-bucket running sum is a window over (keys, bucket).  Exact: the
    buckets only decide where work is split, every row is counted.
    """
    from pyspark.ml.feature import Bucketizer
    keys = list(keys)
    d = df.withColumn("_rk", F.col(order).cast("double"))
    splits = sorted(set(d.approxQuantile("_rk", [i / n_buckets for i in range(1, n_buckets)], rel_err)))
    if splits:
        d = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_rk", outputCol="_rb",
                       handleInvalid="keep").transform(d).drop("_rk")
    else:
        d = d.drop("_rk").withColumn("_rb", F.lit(0.0))
    tot = d.groupBy(*keys, "_rb").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wb = Window.partitionBy(*keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_rb", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in cols])
    d = d.join(tot, on=keys + ["_rb"], how="inner")
    w = Window.partitionBy(*keys, "_rb").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    out = {f"cum_{c}": F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0)) for c in cols}
    return d.withColumns(out).drop("_rb", *[f"_o_{c}" for c in cols])


#: a value with more than this part of all rows is hot; there are fewer of them than this
HOT_VALUES = 1024


def average_rank(df: DataFrame, x: str, out: str, keys=()) -> DataFrame:
    """``rank(method='average')``: ties share the mean of their ranks.

    Distributed form: distinct values with counts (partial aggregation keeps
    the shuffle to one row per value and task), an exclusive running count over the
    distinct table (``running_sums``), then ranks go back to the rows.  Values with more
    than 1 / ``HOT_VALUES`` of all rows, so fewer than ``HOT_VALUES`` of them, go back by
    broadcast; the others by a join in which rows that are done already, and nulls, are
    spread over ``HOT_VALUES`` keys that match nothing.  Null stays null.
    """
    keys = list(keys)
    cnt = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"))
    ranks = cut_lineage(running_sums(cnt, keys, x, ["_c"], inclusive=False).select(
        *keys, x, "_c", (F.col("cum__c") + (F.col("_c") + 1) / 2.0).alias(out)))
    many = (ranks.agg(F.sum("_c")).first()[0] or 0) / HOT_VALUES
    # a part of the join key for all rows: a constant one would be dropped from it
    spread = lambda c: F.pmod(c, F.lit(HOT_VALUES)).alias("_s")
    hot = ranks.where(F.col("_c") > many).select(*keys, x, F.col(out).alias("_hot"))
    rest = ranks.where(F.col("_c") <= many).select(*keys, F.col(x).alias("_x"), spread(F.xxhash64(x)), F.col(out).alias("_rest"))
    done = F.col("_hot").isNotNull() | F.col(x).isNull()
    rows = df.join(F.broadcast(hot), on=keys + [x], how="left")
    rows = rows.withColumn("_x", F.when(~done, F.col(x))).withColumn(
        "_s", spread(F.when(done, F.monotonically_increasing_id()).otherwise(F.xxhash64(x))))
    return rows.join(rest, on=keys + ["_x", "_s"], how="left").select(
        *df.columns, F.coalesce("_hot", "_rest").alias(out))


def rank_sorted(df: DataFrame, score: str, name: str, out: str = "rank", ascending: bool = False) -> DataFrame:
    """1-based rank of a small sorted result (name breaks ties)."""
    o = F.col(score).asc() if ascending else F.col(score).desc()
    return df.withColumn(out, F.row_number().over(Window.orderBy(o, F.col(name))))

