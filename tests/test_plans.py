"""Physical-plan guards: pushdown, pruning, partial aggregation, no
cartesian products in the operators that replace pair-wise work."""

import io
from contextlib import redirect_stdout

from conftest import SF01
from voltsight import catalog, queries  # noqa: F401


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_date_range_pushed_to_scan(spark):
    p = _plan(catalog.QUERIES["p9_date_range"](spark, SF01))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in p


def test_grid_aggregation_is_partial_then_final_and_pruned(spark):
    p = _plan(catalog.QUERIES["grid_hourly"](spark, SF01))
    assert p.count("HashAggregate") >= 2
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p


def test_no_cartesian_products(spark):
    for name in ("j6_similar_by_index", "a11_histogram", "p10_iqr_outliers", "p6_median_impute",
                 "m34_integrity", "j1_asof_lookup", "r3_association_rules", "m1_training_features",
                 "p13_chrono_split", "j3_recommendation_lookup", "m18_time_series_folds", "m29_profile_table"):
        p = _plan(catalog.QUERIES[name](spark, SF01))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_quantiles_keep_no_key_in_one_buffer(spark):
    for name in ("a3_quantiles", "a4_medians", "a20_box_summary", "p6_median_impute", "p10_iqr_outliers", "p15_median_split",
                 "f8_regime_labels", "j3_recommendation_lookup"):
        p = _plan(catalog.QUERIES[name](spark, SF01))
        assert "percentile" not in p and "mode(" not in p, name


def test_requests_are_neither_exploded_nor_regrouped(spark):
    p = _plan(catalog.QUERIES["m3_request_features"](spark, SF01))
    assert p.count("Scan parquet") == 2          # the requests, once as rows (tree and details); lookups read checkpoints
