"""Scans and the training feature table."""

from ..catalog import FEATURES_SQL, GRID_SQL, GRID1_SQL, R, _select_features_sql, register, ts_text
from ..sources import tables as src

# --------------------------------------------------------------------------
# Scans
# --------------------------------------------------------------------------
@register("grid_hourly", f"""
WITH g AS ({GRID_SQL})
SELECT series_id, {ts_text('ts')} AS ts, {R('load')} AS load, {R('price')} AS price,
       {R('solar')} AS solar, {R('wind')} AS wind, {R('gas')} AS gas, {R('coal')} AS coal,
       {R('nuclear')} AS nuclear FROM g
""")
def q_grid_hourly(spark, sf_dir):
    """Hourly multi-series grid table derived from events."""
    return src.grid_hourly(spark, sf_dir)


@register("m1_training_features", FEATURES_SQL + _select_features_sql())
def q_training_features(spark, sf_dir):
    """M1: training feature table."""
    from ..plans.features import training_features
    return training_features(src.grid_hourly(spark, sf_dir))


@register("m1_training_features_single", FEATURES_SQL.replace(GRID_SQL, GRID1_SQL) + _select_features_sql())
def q_training_features_single(spark, sf_dir):
    """M1 on the single-series form of the grid table."""
    from ..plans.features import training_features
    return training_features(src.grid_hourly(spark, sf_dir, n_series=1))
