"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (full plan,
nothing collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "grid_hourly", "m1_training_features", "w_orders_daily_windows", "w6_ewm", "w7_interpolate",
    "d1_decompose", "w9_average_rank", "a10_correlation", "a11_histogram", "m34_integrity",
    "j1_asof_lookup", "j2_interval_mean", "m3_request_features", "r3_association_rules",
    "j5_similarity_topk", "m30_model_comparison", "m32_feature_drift",
]


def replicated(spark, sf_dir: str, copies: int = 10) -> dict:
    """The window-heavy plans on 10x replicated series (80 instead of 8)."""
    from voltsight.operators import windows as win
    from voltsight.plans.features import training_features
    from voltsight.sources import tables as src
    ev = src.replicate_events(src.read_table(spark, sf_dir, "events"), copies)
    out = {}
    t0 = time.perf_counter()
    training_features(src.grid_from_events(ev, 8 * copies)).write.format("noop").mode("overwrite").save()
    out["m1_training_features"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    g = src.grid_from_events(ev, 8 * copies).select("series_id", "ts", "load", "price")
    lay = win.layout(g, ["series_id"], "ts", back=win.EWM_HALO)
    d = win.interpolate_linear(lay, win.ewm_mean(lay, lay.df, "load", "load_ewm24"), "price", "price_interp")
    lay.finish(d).write.format("noop").mode("overwrite").save()
    out["w6_w7_ewm_interpolate"] = round(time.perf_counter() - t0, 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from voltsight.session import build_session
    from voltsight import catalog, queries  # noqa: F401

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="voltsight-bench")
    names = [n for n in HEADLINE if n in catalog.QUERIES]
    # warm-up: JVM, codegen caches, parquet footers
    catalog.QUERIES["grid_hourly"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    rep = replicated(spark, sf_dir, copies=10)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "replicated_series_10x": rep}))
    spark.stop()


if __name__ == "__main__":
    main()
