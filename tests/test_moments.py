"""Centred moments and what rests on them don't notice the level of their input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltsight.operators import ml
from voltsight.operators import stationarity as st
from voltsight.operators.moments import Moments, centred_moments


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 3)) @ rng.normal(size=(3, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["y"] = x @ [1.0, -2.0, 0.5] + rng.normal(scale=0.1, size=5000)
    return spark.createDataFrame(pdf).repartition(7), pdf


def shifted(df, by):
    return df.select(*[(F.col(c) + by).alias(c) for c in df.columns])


def test_moments_equal_numpy_at_any_offset(table):
    df, pdf = table
    for by in (0.0, 1e8):
        m = centred_moments(shifted(df, by), ["a", "b", "c", "y"])
        assert m.n == len(pdf)
        np.testing.assert_allclose(m.mean - by, pdf.mean(), atol=1e-6)
        np.testing.assert_allclose(m.covariance(), np.cov(pdf.to_numpy().T), rtol=1e-6, atol=1e-6)


def test_merge_order_does_not_matter():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) + [1e9, -3.0]
    parts = [Moments.of(p) for p in np.split(x, [7, 8, 150])] + [Moments.of(x[:0])]
    total = parts[0] + (parts[1] + parts[4]) + (parts[2] + parts[3])
    np.testing.assert_allclose(total.comoment, Moments.of(x).comoment, rtol=1e-6, atol=1e-4)


def test_rows_with_nulls_take_no_part_and_empty_tables_have_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (3.0, 8.0)], "a double, b double")
    m = centred_moments(df, ["a", "b"])
    assert m.n == 2 and m.mean.tolist() == [2.0, 5.0] and m.comoment.tolist() == [[2.0, 6.0], [6.0, 18.0]]
    assert centred_moments(df.where("a > 9"), ["a", "b"]).n == 0


def test_pca_and_ridge_do_not_notice_an_offset(table):
    df, _ = table
    plain, moved = ml.pca_fit(df, ["a", "b", "c"], k=3), ml.pca_fit(shifted(df, 1e9), ["a", "b", "c"], k=3)
    np.testing.assert_allclose(plain["explained_ratio"], moved["explained_ratio"], atol=1e-5)
    plain, moved = (ml.bayesian_ridge(d, "y", ["a", "b", "c"]) for d in (df, shifted(df, 1e8)))
    np.testing.assert_allclose(plain["coef"], moved["coef"], atol=1e-5)


def test_adf_does_not_notice_an_offset(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"series_id": 0, "ts": pd.date_range("2024-01-01", periods=600, freq="h"), "x": rng.uniform(size=600)})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    plain = st.adf(df, "x")
    moved = st.adf(df.withColumn("x", F.col("x") + 1e8), "x")
    assert plain["used_lag"] == moved["used_lag"] and plain["adf_stat"] == pytest.approx(moved["adf_stat"], rel=1e-5)
    # ordinary least squares on the same rows
    x, p = pdf.x.to_numpy(), plain["used_lag"]
    dy = np.diff(x)
    rows = np.array([[x[t], *(dy[t - i] for i in range(1, p + 1))] for t in range(p, len(dy))])
    design = np.column_stack([np.ones(len(rows)), rows])
    beta, ssr, *_ = np.linalg.lstsq(design, dy[p:], rcond=None)
    se = np.sqrt(ssr[0] / (len(rows) - design.shape[1]) * np.linalg.inv(design.T @ design)[1, 1])
    assert plain["nobs"] == len(rows) and plain["adf_stat"] == pytest.approx(beta[1] / se, rel=1e-8)


def test_constant_series_is_an_error(spark):
    pdf = pd.DataFrame({"series_id": 0, "ts": pd.date_range("2024-01-01", periods=100, freq="h"), "x": 3.0})
    with pytest.raises(ValueError):
        st.adf(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "x")
