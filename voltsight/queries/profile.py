"""Profiling / data-quality queries."""

from pyspark.sql import functions as F

from .. import config as C
from ..catalog import FEATURE_COLS_DOUBLE, FEATURE_COLS_INT, FEATURES_SQL, GRID_SQL, GRID1_SQL, R, register, ts_text
from ..operators import profile as pr
from ..operators import windows as win
from ..plans import features as fe
from ..sources import tables as src

GRID_MEASURES = ("load", "price", "solar", "wind", "gas", "coal", "nuclear")
LI_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _grid(spark, sf_dir, n=8):
    return src.grid_hourly(spark, sf_dir, n_series=n)


def _li(spark, sf_dir, cols=None):
    li = src.read_table(spark, sf_dir, "lineitem")
    return li.select(*cols) if cols else li


@register("a1_group_mean", """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity,
       round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount,
       round(avg(l_tax), 6) AS l_tax
FROM lineitem GROUP BY 1, 2
""")
def q_group_mean(spark, sf_dir):
    """A1: group mean profile."""
    return pr.group_mean_profile(_li(spark, sf_dir), ["l_returnflag", "l_linestatus"], LI_NUM)


@register("a2_value_counts", "SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY 1")
def q_value_counts(spark, sf_dir):
    """A2: value counts."""
    return pr.value_counts(_li(spark, sf_dir, ["l_returnflag"]), "l_returnflag")


@register("a3_quantiles", f"""
WITH g AS ({GRID_SQL})
SELECT series_id, {R('quantile_cont(load, 0.33)')} AS q33, {R('quantile_cont(load, 0.66)')} AS q66,
       {R('quantile_cont(price, 0.33)')} AS price_q33, {R('quantile_cont(price, 0.66)')} AS price_q66
FROM g GROUP BY 1
""")
def q_quantiles(spark, sf_dir):
    """A3: exact linear-interpolated quantiles per series."""
    g = _grid(spark, sf_dir)
    a = pr.exact_quantiles(g, "load", [.33, .66], ["series_id"])
    b = pr.exact_quantiles(g, "price", [.33, .66], ["series_id"], ["price_q33", "price_q66"])
    return a.join(b, "series_id")


@register("a4_medians", """
SELECT round(median(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice,
       round(median(l_discount), 6) AS l_discount, round(median(l_tax), 6) AS l_tax FROM lineitem
""")
def q_medians(spark, sf_dir):
    """A4: median of every numeric column."""
    return pr.column_medians(_li(spark, sf_dir), LI_NUM)


@register("a5_zero_counts", """
SELECT column_name, zeros, non_zeros FROM (
  SELECT 'l_quantity' AS column_name, CAST(count_if(l_quantity = 0) AS BIGINT) AS zeros,
         CAST(count(*) - count_if(l_quantity = 0) AS BIGINT) AS non_zeros FROM lineitem
  UNION ALL SELECT 'l_extendedprice', CAST(count_if(l_extendedprice = 0) AS BIGINT), CAST(count(*) - count_if(l_extendedprice = 0) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'l_discount', CAST(count_if(l_discount = 0) AS BIGINT), CAST(count(*) - count_if(l_discount = 0) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'l_tax', CAST(count_if(l_tax = 0) AS BIGINT), CAST(count(*) - count_if(l_tax = 0) AS BIGINT) FROM lineitem)
""")
def q_zero_counts(spark, sf_dir):
    """A5: zero / non-zero counts per column."""
    return pr.zero_counts(_li(spark, sf_dir), LI_NUM)


def _null_ratio_sql():
    parts = [f"SELECT '{c}' AS column_name, avg(CAST({c} IS NULL AS DOUBLE)) AS null_ratio FROM g" for c in
             ("series_id", "ts") + GRID_MEASURES]
    return f"WITH g AS ({GRID_SQL}), r AS ({' UNION ALL '.join(parts)})"


@register("a6_null_ratios", _null_ratio_sql() + f"""
SELECT column_name, {R('null_ratio')} AS null_ratio,
       CASE WHEN null_ratio > 0.5 THEN 'issue' WHEN null_ratio > 0.1 THEN 'warning' ELSE 'ok' END AS severity
FROM r
""")
def q_null_ratios(spark, sf_dir):
    """Null ratio per column with severity."""
    return pr.null_ratios(_grid(spark, sf_dir))


@register("a7_duplicates", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicates
FROM lineitem
""")
def q_duplicates(spark, sf_dir):
    """Duplicate rows beyond the first occurrence."""
    return pr.duplicate_rows(src.read_table(spark, sf_dir, "lineitem"))


@register("a8_target_checks", f"""
WITH g AS ({GRID_SQL})
SELECT count(price) AS n_values, stddev_samp(price) = 0 AS zero_variance, CAST(count_if(price < 0) AS BIGINT) AS n_negative FROM g
""")
def q_target_checks(spark, sf_dir):
    """Target checks (no values, zero variance, negatives)."""
    return pr.target_checks(_grid(spark, sf_dir), "price")


def _col_checks_sql():
    parts = [f"SELECT '{c}' AS column_name, count({c}) = 0 AS all_null, count(DISTINCT {c}) <= 1 AS low_variance FROM f"
             for c in FEATURE_COLS_DOUBLE + FEATURE_COLS_INT]
    return FEATURES_SQL + " " + " UNION ALL ".join(parts)


@register("a9_column_checks", _col_checks_sql())
def q_column_checks(spark, sf_dir):
    """Entirely-null / single-valued columns of the feature table."""
    f = fe.training_features(_grid(spark, sf_dir))
    return pr.column_checks(f, list(FEATURE_COLS_DOUBLE + FEATURE_COLS_INT))


def _corr_sql():
    pairs = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'corr({a}, {b})')} AS corr FROM g"
             for a in GRID_MEASURES for b in GRID_MEASURES]
    return f"WITH g AS ({GRID_SQL}) " + " UNION ALL ".join(pairs)


@register("a10_correlation", _corr_sql())
def q_correlation(spark, sf_dir):
    """A10: pairwise-complete Pearson correlation matrix (long form)."""
    return pr.correlation_long(_grid(spark, sf_dir), GRID_MEASURES)


@register("a11_histogram", f"""
WITH g AS ({GRID_SQL}),
b AS (SELECT series_id, min(load) AS lo, max(load) AS hi FROM g GROUP BY 1),
d AS (SELECT g.series_id, lo, hi, CAST(CASE WHEN hi - lo = 0 THEN 1
        ELSE least(floor((load - lo) / (hi - lo) * 30) + 1, 30) END AS BIGINT) AS bin
      FROM g JOIN b USING (series_id) WHERE load IS NOT NULL)
SELECT series_id, bin, {R('lo + (bin - 1) * (hi - lo) / 30')} AS bin_lo, {R('lo + bin * (hi - lo) / 30')} AS bin_hi,
       count(*) AS count
FROM d GROUP BY series_id, bin, lo, hi
""")
def q_histogram(spark, sf_dir):
    """30-bin histogram of load per series."""
    return pr.histogram(_grid(spark, sf_dir), "load", 30, ["series_id"])


@register("a12_kde", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(l_extendedprice) AS n,
                  stddev_samp(l_extendedprice) * 1.06 * pow(CAST(count(l_extendedprice) AS DOUBLE), -0.2) AS h FROM lineitem),
p AS (SELECT i AS point, lo + i * (hi - lo) / 63 AS x_at, n, h FROM s, range(0, 64) t(i))
SELECT CAST(point AS BIGINT) AS point, round(x_at, 6) AS x_at,
       round(sum(exp(-0.5 * pow((x_at - l_extendedprice) / h, 2)) / sqrt(2 * pi())) / (n * h) * 1e9, 6) AS density_e9
FROM p, lineitem WHERE l_extendedprice IS NOT NULL GROUP BY point, x_at, n, h
""")
def q_kde(spark, sf_dir):
    """Gaussian KDE of extended price on a 64-point grid (density x 1e9)."""
    k = pr.kde_curve(_li(spark, sf_dir, ["l_extendedprice"]), "l_extendedprice", 64)
    return k.select("point", F.col("at").alias("x_at"), (F.col("density") * 1e9).alias("density_e9"))


@register("a14_mode", """
WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_returnflag, max(n) AS mx FROM c GROUP BY 1)
SELECT c.l_returnflag, round(min(l_quantity), 6) AS l_quantity_mode FROM c JOIN m ON c.l_returnflag = m.l_returnflag AND n = mx
GROUP BY 1
""")
def q_mode(spark, sf_dir):
    """Mode with the smallest value on ties."""
    return pr.mode_smallest(_li(spark, sf_dir, ["l_returnflag", "l_quantity"]), "l_quantity", ["l_returnflag"])


@register("a20_box_summary", f"""
WITH g AS ({GRID_SQL}),
q AS (SELECT series_id, quantile_cont(load, [0, 0.25, 0.5, 0.75, 1]) AS v FROM g GROUP BY 1)
SELECT series_id, {R('v[1]')} AS min, {R('v[2]')} AS q1, {R('v[3]')} AS median, {R('v[4]')} AS q3, {R('v[5]')} AS max,
       {R('v[2] - 1.5 * (v[4] - v[2])')} AS lower_fence, {R('v[4] + 1.5 * (v[4] - v[2])')} AS upper_fence
FROM q
""")
def q_box_summary(spark, sf_dir):
    """Box-plot five numbers with IQR fences."""
    return pr.box_summary(_grid(spark, sf_dir), "load", ["series_id"])


@register("p10_iqr_outliers", f"""
WITH g AS ({GRID_SQL}),
q AS (SELECT series_id, quantile_cont(load, 0.25) AS q1, quantile_cont(load, 0.75) AS q3 FROM g GROUP BY 1),
b AS (SELECT series_id, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT series_id, CAST(count_if(load < lo OR load > hi) AS BIGINT) AS n_outliers, count(*) AS n_rows,
       {R('count_if(load < lo OR load > hi) / count(*) * 100.0')} AS outlier_pct
FROM g JOIN b USING (series_id) GROUP BY 1
""")
def q_iqr_outliers(spark, sf_dir):
    """P10: IQR outlier count and percentage per series."""
    return pr.iqr_outliers(_grid(spark, sf_dir), "load", ["series_id"])


def _degenerate_sql():
    cols_d = ("series_id", "load", "price", "nuclear", "renewable", "fossil", "total_gen", "renewable_pct",
              "hour", "day_of_week", "month", "is_weekend", "hour_sin", "hour_cos", "month_sin", "month_cos",
              "demand_lag_1h", "demand_lag_12h", "demand_lag_24h", "demand_lag_168h", "price_lag_1h",
              "price_lag_12h", "price_lag_24h", "demand_avg_24h", "price_avg_24h", "demand_12h", "price_12h")
    parts = [f"SELECT '{c}' AS column_name, count_if({c} = 0) = count(*) AS all_zero, count(DISTINCT {c}) = 1 AS constant FROM f"
             for c in cols_d]
    return FEATURES_SQL + " " + " UNION ALL ".join(parts)


@register("p4_degenerate_columns", _degenerate_sql())
def q_degenerate(spark, sf_dir):
    """All-zero / constant columns of the feature table (pandas null rules)."""
    return fe.degenerate_columns(fe.training_features(_grid(spark, sf_dir)))


@register("p6_median_impute", f"""
WITH g AS ({GRID_SQL}),
k AS (SELECT * FROM g WHERE load IS NOT NULL),
m AS (SELECT median(price) AS price, median(solar) AS solar, median(wind) AS wind, median(gas) AS gas,
             median(coal) AS coal, median(nuclear) AS nuclear FROM k)
SELECT k.series_id, {ts_text('k.ts')} AS ts, {R('k.load')} AS load,
  {R('coalesce(k.price, m.price)')} AS price, {R('coalesce(k.solar, m.solar)')} AS solar,
  {R('coalesce(k.wind, m.wind)')} AS wind, {R('coalesce(k.gas, m.gas)')} AS gas,
  {R('coalesce(k.coal, m.coal)')} AS coal, {R('coalesce(k.nuclear, m.nuclear)')} AS nuclear
FROM k, m
""")
def q_median_impute(spark, sf_dir):
    """Median imputation after dropping rows without target."""
    return pr.median_impute(_grid(spark, sf_dir), "load", ["price", "solar", "wind", "gas", "coal", "nuclear"])


@register("p7_auto_features", FEATURES_SQL + f"""
SELECT series_id, {R('coalesce(load, 0)')} AS load, {R('nuclear')} AS nuclear, {R('renewable')} AS renewable,
  {R('fossil')} AS fossil, {R('total_gen')} AS total_gen, {R('renewable_pct')} AS renewable_pct,
  CAST(hour AS DOUBLE) AS hour, CAST(day_of_week AS DOUBLE) AS day_of_week, CAST(month AS DOUBLE) AS month,
  CAST(is_weekend AS DOUBLE) AS is_weekend,
  {R('hour_sin')} AS hour_sin, {R('hour_cos')} AS hour_cos, {R('month_sin')} AS month_sin, {R('month_cos')} AS month_cos
FROM f WHERE price_12h IS NOT NULL AND isfinite(price_12h)
""")
def q_auto_features(spark, sf_dir):
    """P7 + P8: numeric features avoiding demand/price names (null -> 0) on rows with a finite target."""
    f = fe.training_features(_grid(spark, sf_dir)).where(pr.finite("price_12h"))
    return pr.auto_feature_matrix(f.drop("ts")).withColumn("series_id", F.col("series_id").cast("bigint"))


@register("p9_date_range", f"""
WITH g AS ({GRID_SQL})
SELECT series_id, {ts_text('ts')} AS ts, {R('load')} AS load FROM g
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'
""")
def q_date_range(spark, sf_dir):
    """Inclusive date-range filter (pushed to the scan as a ts range)."""
    ev = src.read_table(spark, sf_dir, "events")
    ev = pr.date_range(ev, "ts", "2024-01-05", "2024-01-12")
    sid = (F.col("user_id") % 8).cast("bigint")
    return ev.groupBy(sid.alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")) \
             .agg(F.sum("value").alias("load"))


@register("p12_head", f"""
WITH g AS ({GRID1_SQL})
SELECT {ts_text('ts')} AS ts, {R('load')} AS load FROM g ORDER BY g.ts LIMIT 100
""")
def q_head(spark, sf_dir):
    """Chronological head of 100 rows (TakeOrdered)."""
    return _grid(spark, sf_dir, 1).orderBy("ts").limit(100).select("ts", "load")


@register("p13_chrono_split", FEATURES_SQL.replace(GRID_SQL, GRID1_SQL) + f"""
, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS cnt FROM f)
SELECT {ts_text('ts')} AS ts, CASE WHEN idx < floor(0.8 * cnt) THEN 'train' ELSE 'test' END AS split FROM n
""")
def q_chrono_split(spark, sf_dir):
    """Chronological 80/20 split of the single-series feature table."""
    from ..operators.ml import chrono_split_label
    f = fe.training_features(_grid(spark, sf_dir, 1))
    return chrono_split_label(f, ["series_id"], "ts").select("ts", "split")


@register("p14_sample")
def q_sample(spark, sf_dir):
    """Seeded deterministic sample of at most 3,000 rows after a null drop."""
    li = _li(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"]).dropna()
    return pr.deterministic_sample(li, 3000, ["l_orderkey", "l_linenumber"], seed=42)


@register("p14_sample_properties", """
WITH n AS (SELECT least(3000, count(*)) AS n FROM lineitem
           WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL)
SELECT n AS rows, n AS rows_of_the_table, n AS rows_repeated, TRUE AS other_seed_differs FROM n
""")
def q_sample_properties(spark, sf_dir):
    """Size of the sample, how many of its rows the table holds, how many a
    second draw over other partitions repeats, and that another seed draws others."""
    li = _li(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"]).dropna()
    keys = ["l_orderkey", "l_linenumber"]
    a, b, c = (pr.deterministic_sample(d, 3000, keys, seed=s) for d, s in ((li, 42), (li.repartition(7), 42), (li, 43)))

    def in_both(x, y):
        return pr.scalars(x.intersectAll(y).agg(F.count(F.lit(1)).alias("n")))["n"]
    size = a.agg(F.count(F.lit(1)).alias("rows"))
    return size.select("rows", in_both(a, li).alias("rows_of_the_table"), in_both(a, b).alias("rows_repeated"),
                       (in_both(a, c) < F.col("rows")).alias("other_seed_differs"))


@register("p15_median_split", f"""
WITH g AS ({GRID_SQL}), m AS (SELECT series_id, median(load) AS med FROM g GROUP BY 1)
SELECT g.series_id, {ts_text('ts')} AS ts, CAST(load > med AS BIGINT) AS load_high FROM g JOIN m USING (series_id)
""")
def q_median_split(spark, sf_dir):
    """Label ``x > median`` per series."""
    g = _grid(spark, sf_dir).select("series_id", "ts", "load")
    return pr.median_split(g, "load", "load_high", ["series_id"]).drop("load")


@register("p16_positional_slices", f"""
WITH g AS ({GRID_SQL}),
p AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx,
             count(*) OVER (PARTITION BY series_id) AS n FROM g)
SELECT series_id, {ts_text('ts')} AS ts, idx < 24 AS first_day, idx < 168 AS first_week, idx = n // 2 AS middle
FROM p WHERE idx < 168 OR idx = n // 2
""")
def q_positional_slices(spark, sf_dir):
    """First 24 / 168 rows and the middle row of each series (W0 index)."""
    g = _grid(spark, sf_dir).select("series_id", "ts")
    p = win.with_position(g, ["series_id"], "ts")
    n = g.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    p = p.join(n, "series_id")
    idx = F.col(win.IDX)
    mid = idx == F.floor(F.col("_n") / 2)
    return p.where((idx < 168) | mid).select("series_id", "ts", (idx < 24).alias("first_day"),
                                             (idx < 168).alias("first_week"), mid.alias("middle"))


@register("p17_feature_row", FEATURES_SQL + f"""
SELECT {R('coalesce(demand_lag_1h, 0.0)')} AS demand_lag_1h, {R('coalesce(price_lag_1h, 0.0)')} AS price_lag_1h,
       {R('coalesce(hour_sin, 0.0)')} AS hour_sin, CAST(0.0 AS DOUBLE) AS forecast_solar_day_ahead,
       {R('coalesce(renewable_pct, 0.0)')} AS renewable_pct FROM f
""")
def q_feature_row(spark, sf_dir):
    """Exact feature list, missing or null -> 0.0."""
    from ..functions.columns import feature_row
    f = fe.training_features(_grid(spark, sf_dir))
    return feature_row(f, ["demand_lag_1h", "price_lag_1h", "hour_sin", "forecast_solar_day_ahead", "renewable_pct"])


@register("p18_generation_mix", f"""
WITH g AS ({GRID_SQL}),
c AS (SELECT series_id, ts, greatest(coalesce(solar, 0), 0) AS solar, greatest(coalesce(wind, 0), 0) AS wind,
             greatest(coalesce(gas, 0), 0) AS gas, greatest(coalesce(coal, 0), 0) AS coal,
             greatest(coalesce(nuclear, 0), 0) AS nuclear FROM g),
t AS (SELECT *, solar + wind + gas + coal + nuclear AS tot FROM c),
l AS (SELECT series_id, ts, tot, source, mw FROM t UNPIVOT (mw FOR source IN (solar, wind, gas, coal, nuclear)))
SELECT series_id, {ts_text('ts')} AS ts, source, {R('mw')} AS mw,
       {R('CASE WHEN tot > 0 THEN mw / tot * 100.0 ELSE 0.0 END')} AS share_pct FROM l
""")
def q_generation_mix(spark, sf_dir):
    """Generation mix shares per hour."""
    return pr.generation_mix(_grid(spark, sf_dir), ["series_id", "ts"], ["solar", "wind", "gas", "coal", "nuclear"])


@register("p18_generation_breakdown", f"""
WITH g AS ({GRID_SQL}),
b AS (SELECT series_id, ts, coalesce(solar, 0) + coalesce(wind, 0) AS renewable, coalesce(gas, 0) + coalesce(coal, 0) AS fossil,
             coalesce(nuclear, 0) AS nuclear FROM g),
t AS (SELECT *, renewable + fossil + nuclear AS total FROM b)
SELECT series_id, {ts_text('ts')} AS ts, {R('renewable')} AS renewable, {R('fossil')} AS fossil, {R('nuclear')} AS nuclear,
       CAST(0 AS DOUBLE) AS other, {R('total')} AS total,
       round_even(CASE WHEN total > 0 THEN renewable / total * 100.0 ELSE 0 END, 1) AS renewable_share FROM t
""")
def q_generation_breakdown(spark, sf_dir):
    """Generation by group per hour with the rounded renewable share."""
    return pr.generation_breakdown(_grid(spark, sf_dir), ["series_id", "ts"], C.GRID_GROUPS)


_INTEGRITY_SQL = f"""
WITH g AS ({GRID_SQL}),
nr AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, avg(CAST({c} IS NULL AS DOUBLE)) AS r FROM g" for c in ("series_id", "ts") + GRID_MEASURES)}),
cc AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS d FROM g" for c in ("series_id",) + GRID_MEASURES)}),
dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS k FROM g),
tc AS (SELECT count(price) AS n, stddev_samp(price) AS sd, count_if(price < 0) AS neg FROM g)
SELECT CASE WHEN r > 0.5 THEN 'issue' ELSE 'warning' END AS severity, 'null_ratio' AS "check", column_name,
       printf('Column ''%s'' has %s%% null values', column_name, printf('%.1f', round_even(r * 100, 1))) AS message
FROM nr WHERE r > 0.1
UNION ALL SELECT 'warning', 'duplicates', NULL, printf('Found %d duplicate rows', k) FROM dup WHERE k > 0
UNION ALL SELECT 'issue', 'target_empty', 'price', 'Target column ''price'' has no valid values' FROM tc WHERE n = 0
UNION ALL SELECT 'issue', 'target_zero_variance', 'price', 'Target column ''price'' has zero variance' FROM tc WHERE n > 0 AND sd = 0
UNION ALL SELECT 'warning', 'target_negative', 'price', 'Target column ''price'' contains negative values' FROM tc WHERE neg > 0
UNION ALL SELECT CASE WHEN n = 0 THEN 'issue' ELSE 'warning' END, CASE WHEN n = 0 THEN 'all_null' ELSE 'low_variance' END,
       column_name, CASE WHEN n = 0 THEN printf('Column ''%s'' is entirely null', column_name)
                         ELSE printf('Column ''%s'' has only one unique value (low variance)', column_name) END
FROM cc WHERE n = 0 OR d <= 1
"""


@register("m34_integrity_verdict", f"""
SELECT 'price' AS target, count(*) FILTER (severity = 'issue') AS n_issues, count(*) FILTER (severity = 'warning') AS n_warnings,
       count_if(severity = 'issue') = 0 AS passed FROM ({_INTEGRITY_SQL})
UNION ALL
SELECT 'load', count(*) FILTER (severity = 'issue'), count(*) FILTER (severity = 'warning'), count_if(severity = 'issue') = 0
FROM ({_INTEGRITY_SQL.replace("count(price) AS n, stddev_samp(price) AS sd, count_if(price < 0)",
                              "count(load) AS n, stddev_samp(load) AS sd, count_if(load < 0)")})
""")
def q_integrity_verdict(spark, sf_dir):
    """Issues, warnings and the verdict for both targets."""
    g = _grid(spark, sf_dir)
    return pr.integrity_verdict(pr.integrity_findings(g, "price")).withColumn("target", F.lit("price")).unionByName(
        pr.integrity_verdict(pr.integrity_findings(g, "load")).withColumn("target", F.lit("load")))


@register("m34_integrity", _INTEGRITY_SQL)
def q_integrity(spark, sf_dir):
    """Data-integrity findings (null ratios, duplicates, target and column checks)."""
    return pr.integrity_findings(_grid(spark, sf_dir), "price")
