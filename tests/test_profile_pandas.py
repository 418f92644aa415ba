"""pandas parity of profiling operators (the semantics being reproduced)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from voltsight.operators import profile as pr
from voltsight.operators import timeseries as tsa
from voltsight.operators import windows as win
from voltsight.sources import tables as src


def test_corr_is_pairwise_complete_like_pandas(spark):
    g = src.grid_hourly(spark, SF01, n_series=1)
    cols = ["load", "price", "solar", "coal"]
    got = pr.correlation_long(g, cols).toPandas().set_index(["col_a", "col_b"])["corr"]
    exp = g.select(*cols).toPandas().corr()
    for a in cols:
        for b in cols:
            assert abs(got[(a, b)] - exp.loc[a, b]) < 1e-12


def test_average_rank_like_pandas(spark):
    li = src.read_table(spark, SF01, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    got = win.average_rank(li, "l_quantity", "r").toPandas().sort_values(["l_orderkey", "l_linenumber"])
    exp = got["l_quantity"].rank(method="average")
    np.testing.assert_allclose(got["r"].to_numpy(), exp.to_numpy())


def test_daily_resample_like_pandas(spark):
    pdf = pd.DataFrame({"series_id": 0, "ts": pd.to_datetime(["2024-01-01 03:00", "2024-01-01 05:00", "2024-01-04 01:00"]),
                        "x": [1.0, 3.0, 10.0]})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = tsa.resample_mean(df, ["series_id"], "ts", ["x"]).toPandas().sort_values("ts")
    exp = pdf.set_index("ts")["x"].resample("D").mean()
    assert list(got["x"].isna()) == list(exp.isna())          # empty days appear as null
    np.testing.assert_allclose(got["x"].dropna().to_numpy(), exp.dropna().to_numpy())


def test_mode_smallest_and_quantiles_like_pandas(spark):
    pdf = pd.DataFrame({"k": [1] * 6, "x": [3.0, 1.0, 3.0, 1.0, 2.0, 7.0]})
    df = spark.createDataFrame(pdf)
    assert pr.mode_smallest(df, "x", ["k"]).first()["x_mode"] == pdf["x"].mode()[0]
    q = pr.exact_quantiles(df, "x", [0.33, 0.66]).first()
    np.testing.assert_allclose([q["q33"], q["q66"]], np.percentile(pdf["x"], [33, 66]))


def test_zero_and_null_rules_like_pandas(spark):
    pdf = pd.DataFrame({"a": [0.0, 0.0, None], "b": [0.0, 0.0, 0.0], "c": [5.0, None, 5.0]})
    df = spark.createDataFrame(pdf)
    from voltsight.plans.features import degenerate_columns
    rep = degenerate_columns(df).toPandas().set_index("column_name")
    for c in "abc":
        assert bool(rep.loc[c, "all_zero"]) == bool((pdf[c] == 0).all())
        assert bool(rep.loc[c, "constant"]) == bool(pdf[c].nunique() == 1)


def test_quantiles_equal_numpy_for_every_key(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 5, 400)] + [("one", 7.5), ("none", None), (None, 1.0), (None, 4.0)]
    rows += [("wide", float(v)) for v in rng.normal(0, 1e6, 301)]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = [0.0, .25, 1 / 3, .5, .9, 1.0]
    got = {r.k: r for r in pr.exact_quantiles(df, "x", probs, ["k"], list("abcdef")).collect()}
    assert set(got) == {"hot", "one", "none", "wide", None}
    for k, r in got.items():
        x = [v for n, v in rows if n == k and v is not None]
        assert list(r)[1:] == ([None] * 6 if not x else pytest.approx(list(np.quantile(x, probs)), rel=1e-12))
    assert pr.column_medians(df.withColumn("y", F.lit(None).cast("double")), ["x", "y"]).first().y is None
