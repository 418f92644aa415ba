"""voltsight: Spark-first analytics for hourly grid telemetry.

Feature tables, profiling, decomposition and stationarity tests,
association rules, model evaluation and similarity recommendations, all as
DataFrame / Spark ML / Structured Streaming plans.
"""

try:  # ship grouped-map closures to Python workers by value (no install on executors)
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
