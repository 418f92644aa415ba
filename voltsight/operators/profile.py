"""Profiling, data-quality and drift operators (A1-A12, A14, A20, P4-P18,
M32-M34).

Each operator is one (or a few) aggregation passes; results that have one
row per column are produced with ``stack`` from a single wide aggregate so
the data is scanned once however many columns are profiled.  Scalars that
feed back into row-level predicates (quantiles, medians, bounds) are 1-row
aggregates used as scalar subqueries (``DataFrame.scalar``) - no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import with_generation_groups
from ..session import cut_lineage
from . import windows as win

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def scalars(row: DataFrame) -> dict:
    """Columns of a 1-row aggregate as scalar subqueries (no join needed)."""
    names = row.columns
    sub = row.select(F.struct(*[F.col(n) for n in names]).alias("_s")).scalar()
    return {n: sub.getField(n) for n in names}


def _stack(row: DataFrame, names, fields, value_names) -> DataFrame:
    """Turn a 1-row wide aggregate into one row per column name."""
    parts = []
    for n in names:
        parts.append(f"'{n}'")
        parts += [f"`{f}__{n}`" for f in fields]
    expr = f"stack({len(names)}, {', '.join(parts)}) as (column_name, {', '.join(value_names)})"
    return row.selectExpr(expr)


# ----------------------------------------------------------------- A1-A4
def group_mean_profile(df: DataFrame, keys, cols) -> DataFrame:
    """A1: per-group means."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """A2: counts per value (order at output)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def _order_statistics(values: DataFrame, x: str, probs, names) -> DataFrame:
    """Linear-interpolated quantiles (numpy default) of ``x`` per struct ``_g``.

    Values are counted first, a distributed running count places them, and each
    quantile reads its two neighbours off it: no key's values meet in one buffer.
    """
    counts = cut_lineage(values.where(F.col(x).isNotNull()).groupBy("_g", x).agg(F.count(F.lit(1)).alias("_c")))
    placed = win.running_sums(counts, ["_g"], x, ["_c"])
    totals = counts.groupBy("_g").agg(F.sum("_c").alias("_n"))
    placed = placed.join(totals, "_g")
    at = [(F.lit(float(p)) * (F.col("_n") - 1)) for p in probs]
    ends = []
    for i, pos in enumerate(at):
        for side, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            ends.append(F.min(F.when(F.col("cum__c") > k, F.col(x))).alias(f"_{side}{i}"))
    found = placed.groupBy("_g").agg(F.max("_n").alias("_n"), *ends)
    out = []
    for i, (pos, name) in enumerate(zip(at, names)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        between = (F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi
        out.append(F.when(lo == hi, lo).otherwise(between).alias(name))
    return found.select("_g", *out)


def exact_quantiles(df: DataFrame, col: str, probs, keys=(), names=None) -> DataFrame:
    """A3: exact linear-interpolated quantiles (numpy default) per key; a key
    without values has null quantiles."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    keys = list(keys)
    if not keys:
        return quantile_row(df, {n: (col, p) for n, p in zip(names, probs)})
    d = df.select(F.struct(*[F.col(k) for k in keys]).alias("_g"), F.col(col).cast("double").alias("_x"))
    out = d.select("_g").distinct().join(_order_statistics(d, "_x", probs, names), "_g", "left")
    return out.select(*[F.col(f"_g.{k}").alias(k) for k in keys], *names)


def quantile_row(df: DataFrame, wanted: dict) -> DataFrame:
    """One row of exact quantiles: ``wanted`` maps an output name to ``(column, p)``."""
    cols = sorted({c for c, _ in wanted.values()})
    probs = sorted({p for _, p in wanted.values()})
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "_col", "_x")
    q = _order_statistics(long.select(F.struct("_col").alias("_g"), "_x"), "_x", probs,
                          [f"_q{i}" for i in range(len(probs))])
    return q.agg(*[F.max(F.when(F.col("_g._col") == c, F.col(f"_q{probs.index(p)}"))).alias(name)
                   for name, (c, p) in wanted.items()])


def column_medians(df: DataFrame, cols) -> DataFrame:
    """A4: median of every listed column, one pass over all of them."""
    return quantile_row(df, {c: (c, 0.5) for c in cols})


# ----------------------------------------------------------------- A5-A9
def zero_counts(df: DataFrame, cols) -> DataFrame:
    """A5: zero / non-zero counts per column; null counts as non-zero."""
    row = df.agg(F.count(F.lit(1)).alias("n__"),
                 *[F.count_if(F.col(c) == 0).alias(f"z__{c}") for c in cols])
    row = row.select(*[F.col(f"z__{c}") for c in cols],
                     *[(F.col("n__") - F.col(f"z__{c}")).alias(f"nz__{c}") for c in cols])
    return _stack(row, cols, ["z", "nz"], ["zeros", "non_zeros"])


def null_ratios(df: DataFrame, cols=None) -> DataFrame:
    """Null ratio per column with severity (> .5 issue, > .1 warning)."""
    cols = cols or df.columns
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"r__{c}") for c in cols])
    out = _stack(row, cols, ["r"], ["null_ratio"])
    sev = F.when(F.col("null_ratio") > 0.5, "issue").when(F.col("null_ratio") > 0.1, "warning").otherwise("ok")
    return out.withColumn("severity", sev)


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """Rows beyond the first occurrence (nulls compare equal)."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def target_checks(df: DataFrame, target: str) -> DataFrame:
    """Value count, zero variance, negatives of a target."""
    t = F.col(target)
    return df.agg(F.count(t).alias("n_values"),
                  (F.stddev_samp(t) == 0).alias("zero_variance"),
                  F.count_if(t < 0).alias("n_negative"))


def column_checks(df: DataFrame, cols) -> DataFrame:
    """Entirely-null and <= 1 distinct value per column."""
    row = df.agg(*[F.count(F.col(c)).alias(f"n__{c}") for c in cols],
                 *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).cast("bigint").alias(f"d__{c}") for c in cols])
    out = _stack(row, cols, ["n", "d"], ["n_values", "single"])
    return out.select("column_name", (F.col("n_values") == 0).alias("all_null"), (F.col("single") == 1).alias("low_variance"))


def integrity_verdict(findings: DataFrame) -> DataFrame:
    """``n_issues, n_warnings, passed`` (no issue); a strict run stops
    where ``passed`` is false, any other goes on."""
    issues, warnings = (F.count_if(F.col("severity") == x) for x in ("issue", "warning"))
    return findings.agg(issues.alias("n_issues"), warnings.alias("n_warnings"), (issues == 0).alias("passed"))


def integrity_findings(df: DataFrame, target: str) -> DataFrame:
    """Issues and warnings of the integrity check as rows.

    Columns: severity, check, column_name, message.  ``passed`` is
    ``count(severity = 'issue') == 0``.
    """
    cols = df.columns
    num = numeric_columns(df)
    nr = null_ratios(df, cols).where("severity <> 'ok'").select(
        "severity", F.lit("null_ratio").alias("check"), "column_name",
        F.format_string("Column '%s' has %s%% null values", F.col("column_name"),
                        F.format_number(F.bround(F.col("null_ratio") * 100, 1), 1)).alias("message"))
    dup = duplicate_rows(df).where("duplicates > 0").select(
        F.lit("warning").alias("severity"), F.lit("duplicates").alias("check"),
        F.lit(None).cast("string").alias("column_name"),
        F.format_string("Found %d duplicate rows", F.col("duplicates")).alias("message"))
    tc = target_checks(df, target)
    tgt = tc.select(F.explode(F.array(
        F.when(F.col("n_values") == 0, F.struct(F.lit("issue").alias("s"), F.lit("target_empty").alias("c"),
                                                 F.lit(f"Target column '{target}' has no valid values").alias("m"))),
        F.when((F.col("n_values") > 0) & F.col("zero_variance"),
               F.struct(F.lit("issue").alias("s"), F.lit("target_zero_variance").alias("c"),
                        F.lit(f"Target column '{target}' has zero variance").alias("m"))),
        F.when(F.col("n_negative") > 0,
               F.struct(F.lit("warning").alias("s"), F.lit("target_negative").alias("c"),
                        F.lit(f"Target column '{target}' contains negative values").alias("m"))),
    )).alias("f")).where(F.col("f").isNotNull()).select(
        F.col("f.s").alias("severity"), F.col("f.c").alias("check"), F.lit(target).alias("column_name"),
        F.col("f.m").alias("message"))
    cc = column_checks(df, num)
    col_rows = cc.where("all_null or low_variance").select(
        F.when(F.col("all_null"), "issue").otherwise("warning").alias("severity"),
        F.when(F.col("all_null"), "all_null").otherwise("low_variance").alias("check"),
        "column_name",
        F.when(F.col("all_null"), F.format_string("Column '%s' is entirely null", F.col("column_name")))
         .otherwise(F.format_string("Column '%s' has only one unique value (low variance)", F.col("column_name")))
         .alias("message"))
    return nr.unionByName(dup).unionByName(tgt).unionByName(col_rows)


# ----------------------------------------------------------------- A10-A12
def correlation_long(df: DataFrame, cols) -> DataFrame:
    """A10: pairwise-complete Pearson correlation of every column pair, one agg."""
    aggs = [F.corr(F.col(a), F.col(b)).alias(f"c__{a}__{b}") for a in cols for b in cols]
    row = df.agg(*aggs)
    parts = ", ".join(f"'{a}', '{b}', `c__{a}__{b}`" for a in cols for b in cols)
    return row.selectExpr(f"stack({len(cols) ** 2}, {parts}) as (col_a, col_b, corr)")


def histogram(df: DataFrame, x: str, bins: int = 30, keys=()) -> DataFrame:
    """Fixed-width bins between min and max (last bin closed).

    min/max are a grouped aggregate joined back; counts are one grouped
    aggregate with map-side combine.
    """
    keys = list(keys)
    b = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    if keys:
        d = df.where(F.col(x).isNotNull()).join(b, on=keys, how="inner")
    else:
        sc = scalars(b)
        d = df.where(F.col(x).isNotNull()).withColumns({"_lo": sc["_lo"], "_hi": sc["_hi"]})
    width = F.col("_hi") - F.col("_lo")
    idx = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col(x) - F.col("_lo")) / width * bins) + 1, F.lit(bins)))
    d = d.withColumn("bin", idx.cast("bigint"))
    out = d.groupBy(*keys, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    return out.select(*keys, "bin",
                      (F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_lo"),
                      (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_hi"),
                      "count")


def kde_curve(df: DataFrame, x: str, points: int = 64) -> DataFrame:
    """Gaussian kernel density on a fixed grid of ``points`` between
    min and max, Scott bandwidth ``1.06 * std * n^(-1/5)``.

    One aggregation with a sum per grid point (``points`` is a fixed parameter): rows
    are added up where they are read, none is copied, and one row is shuffled per task.
    """
    st = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.stddev_samp(x).alias("_sd"),
                F.count(x).alias("_n"))
    st = st.withColumn("_h", F.col("_sd") * 1.06 * F.pow(F.col("_n").cast("double"), -0.2))
    sc = scalars(st)
    d = df.where(F.col(x).isNotNull()).select(x, *[sc[n].alias(n) for n in ("_lo", "_hi", "_n", "_h")])
    at = [F.col("_lo") + F.lit(i) * (F.col("_hi") - F.col("_lo")) / (points - 1) for i in range(points)]
    sums = [F.sum(F.exp(-0.5 * F.pow((a - F.col(x)) / F.col("_h"), 2)) / math.sqrt(2 * math.pi)) for a in at]
    one = d.groupBy("_lo", "_hi", "_n", "_h").agg(*[s.alias(f"_s{i}") for i, s in enumerate(sums)])
    return one.select("_n", "_h", F.posexplode(F.array(*[
        F.struct(a.alias("at"), F.col(f"_s{i}").alias("s")) for i, a in enumerate(at)])).alias("point", "v")).select(
        "point", "v.at", (F.col("v.s") / (F.col("_n") * F.col("_h"))).alias("density"))


# ----------------------------------------------------------------- A14, A20, P10
def mode_smallest(df: DataFrame, x: str, keys=()) -> DataFrame:
    """Most frequent value, smallest on ties."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(x).alias("x"))).alias("_b"))
    best = best.select(*keys, F.col("_b.x").alias(f"{x}_mode"))
    return df.select(*keys).distinct().join(best, list(keys), "left") if keys else best


def box_summary(df: DataFrame, x: str, keys=()) -> DataFrame:
    """A20 + P10 bounds: five numbers and the 1.5 IQR fences."""
    q = exact_quantiles(df, x, [0, .25, .5, .75, 1], keys, ["min", "q1", "median", "q3", "max"])
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("lower_fence", F.col("q1") - 1.5 * iqr).withColumn("upper_fence", F.col("q3") + 1.5 * iqr)


def iqr_outliers(df: DataFrame, x: str, keys=()) -> DataFrame:
    """P10: count and percentage of values outside the IQR fences."""
    keys = list(keys)
    b = box_summary(df, x, keys).select(*keys, "lower_fence", "upper_fence")
    if keys:
        d = df.join(b, on=keys, how="inner")
    else:
        sc = scalars(b)
        d = df.withColumns({"lower_fence": sc["lower_fence"], "upper_fence": sc["upper_fence"]})
    out = (F.col(x) < F.col("lower_fence")) | (F.col(x) > F.col("upper_fence"))
    return d.groupBy(*keys).agg(F.count_if(out).alias("n_outliers"), F.count(F.lit(1)).alias("n_rows")) \
            .withColumn("outlier_pct", F.col("n_outliers") / F.col("n_rows") * 100.0)


# ----------------------------------------------------------------- P6-P18
def median_impute(df: DataFrame, target: str, cols) -> DataFrame:
    """Drop rows without target, fill numeric nulls with column medians."""
    d = df.where(F.col(target).isNotNull())
    med = scalars(column_medians(d, cols))
    return d.select(*[F.coalesce(F.col(c), med[c]).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def auto_feature_matrix(df: DataFrame, exclude_tokens=("demand", "price")) -> DataFrame:
    """Numeric columns whose name avoids the tokens; null -> 0."""
    cols = [c for c in numeric_columns(df) if not any(t in c for t in exclude_tokens)]
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


def finite(col: str) -> Column:
    """Not null, not NaN, not infinite."""
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def date_range(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Inclusive date range, written as a half-open ``ts`` range so the
    Parquet scan can prune on the min/max statistics."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) &
                    (F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))


def median_split(df: DataFrame, x: str, out: str, keys=()) -> DataFrame:
    """``x > median(x)`` as 0/1 (null stays null)."""
    keys = list(keys)
    m = exact_quantiles(df, x, [0.5], keys, ["_med"])
    d = df.join(m, on=keys, how="left") if keys else df.withColumn("_med", scalars(m)["_med"])
    return d.withColumn(out, (F.col(x) > F.col("_med")).cast("int")).drop("_med")


def generation_breakdown(df: DataFrame, keys, groups, other=()) -> DataFrame:
    """Sums per generation group, the rest (``other``), their total and the
    renewable share rounded half to even to one digit; nulls count as zero."""
    d = with_generation_groups(df, groups)
    rest = F.lit(0.0)
    for c in other:
        rest = rest + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    total = F.col("renewable") + F.col("fossil") + F.col("nuclear") + rest
    share = F.when(total > 0, F.col("renewable") / total * 100.0).otherwise(F.lit(0.0))
    return d.select(*keys, "renewable", "fossil", "nuclear", rest.alias("other"), total.alias("total"),
                    F.bround(share, 1).alias("renewable_share"))


def generation_mix(df: DataFrame, keys, sources) -> DataFrame:
    """Negatives clamped to 0, share of each source in the row total
    (row-local: the total is a column expression, no shuffle)."""
    keys = list(keys)
    clamp = {s: F.greatest(F.coalesce(F.col(s).cast("double"), F.lit(0.0)), F.lit(0.0)) for s in sources}
    total = None
    for c in clamp.values():
        total = c if total is None else total + c
    long = df.select(*keys, total.alias("_tot"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("source"), c.alias("mw")) for s, c in clamp.items()])).alias("_s"))
    return long.select(*keys, "_s.source", "_s.mw",
                       F.when(F.col("_tot") > 0, F.col("_s.mw") / F.col("_tot") * 100.0).otherwise(F.lit(0.0))
                        .alias("share_pct"))


def deterministic_sample(df: DataFrame, n: int, key_cols, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, chosen by a seeded hash order (repeatable;
    TakeOrdered keeps only ``n`` rows per task before the final merge)."""
    return df.orderBy(F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed)), *key_cols).limit(n)
