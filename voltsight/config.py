"""Named configuration: column groups, class labels, recommendation texts.

Everything below the "fixed values" marker must equal the behaviour being
reproduced (label texts, thresholds, default fills); it is kept together and
in natural order so it can be audited at a glance.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Column-group variants of the "renewable / fossil / other" split.
# The hourly table of the library uses short measure names; ``GRID_COLUMNS``
# maps the long generation names of a raw energy CSV onto them.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class GroupSpec:
    """Which measures form the renewable / fossil / nuclear / other totals."""

    name: str
    renewable: tuple[str, ...]
    fossil: tuple[str, ...]
    nuclear: tuple[str, ...] = ()
    other: tuple[str, ...] = ()
    with_pct: bool = True


# ---- fixed values: group membership of the four variants -------------------
RAW_GROUP_SPECS = {
    "full": GroupSpec(
        "full",
        renewable=("generation solar", "generation wind onshore",
                   "generation hydro run-of-river and poundage",
                   "generation hydro water reservoir",
                   "generation hydro pumped storage consumption",
                   "generation biomass", "generation other renewable"),
        fossil=("generation fossil gas", "generation fossil hard coal",
                "generation fossil brown coal/lignite", "generation fossil oil"),
        nuclear=("generation nuclear",),
        other=("generation other", "generation waste"),
    ),
    "mining": GroupSpec(
        "mining",
        renewable=("generation solar", "generation wind onshore",
                   "generation hydro run-of-river and poundage",
                   "generation hydro water reservoir", "generation biomass"),
        fossil=("generation fossil gas", "generation fossil hard coal"),
        nuclear=("generation nuclear",),
    ),
    "request": GroupSpec(
        "request",
        renewable=("generation solar", "generation wind onshore",
                   "generation hydro water reservoir"),
        fossil=("generation fossil gas", "generation fossil hard coal"),
        nuclear=("generation nuclear",),
    ),
    "flow": GroupSpec(
        "flow",
        renewable=("generation solar", "generation wind onshore"),
        fossil=("generation fossil gas", "generation fossil hard coal"),
        with_pct=False,
    ),
}

# The derived test fixture ``grid_hourly`` carries only five generation
# measures; every variant collapses onto this one split for it.
GRID_GROUPS = GroupSpec("grid", renewable=("solar", "wind"), fossil=("gas", "coal"),
                        nuclear=("nuclear",))

# ---- fixed values: class labels and codes ----------------------------------
CLASS_LABELS = ("Low", "Medium", "High")
CLASS_CODE = {"Low": 0, "Medium": 1, "High": 2}

# ---- fixed values: association-rule item vocabulary ------------------------
LEVEL_SUFFIXES = ("LOW", "MED", "HIGH")
TIME_PERIODS = ("time_NIGHT", "time_MORNING", "time_AFTERNOON", "time_EVENING")
SEASONS = ("season_WINTER", "season_SPRING", "season_SUMMER", "season_AUTUMN")
WEEKEND_LABELS = {1: "is_WEEKEND", 0: "is_WEEKDAY"}
RULE_MIN_SUPPORT = 0.05
RULE_MAX_LEN = 3
RULE_MIN_LIFT = 1.2
RULE_MIN_CONFIDENCE = 0.5

# ---- fixed values: recommendation texts keyed by (demand, price) class -----
REC_TABLE = {
    ("Low", "Low"): "Low demand and low price: ideal time to charge EVs and run heavy appliances.",
    ("Low", "Medium"): "Low demand, moderate price: good time for non-critical loads.",
    ("Low", "High"): "Low demand but high price: avoid discretionary usage despite low grid load.",
    ("Medium", "Low"): "Moderate demand, low price: favorable window for flexible loads.",
    ("Medium", "Medium"): "Balanced conditions: maintain standard operations.",
    ("Medium", "High"): "Moderate demand but high price: defer non-essential consumption.",
    ("High", "Low"): "High demand but low price: grid is stressed but affordable.",
    ("High", "Medium"): "Peak demand, moderate price: reduce non-essential usage.",
    ("High", "High"): "Peak demand and high price: minimize usage immediately.",
}
REC_DEFAULT = "No recommendation available."

# ---- fixed values: default fills of the request feature step ---------------
DEFAULT_DEMAND = 28000.0
DEFAULT_PRICE = 50.0

# ---- fixed values: bounds of the drift checks -------------------------------
FEATURE_DRIFT_BELOW = 0.95
LABEL_DRIFT_BELOW = 0.35

# ---- fixed values: required columns of a new dataset -----------------------
REQUIRED_COLUMNS = ("time", "total load actual", "price actual")


@dataclass
class FeatureSpec:
    """Parameters of the training feature table (M1/M2)."""

    groups: GroupSpec = GRID_GROUPS
    demand_col: str = "load"
    price_col: str = "price"
    demand_lags: tuple[int, ...] = (1, 12, 24, 168)
    price_lags: tuple[int, ...] = (1, 12, 24)
    rolling: int = 24
    horizon: int = 12
    month_offset: int = 0
    required: tuple[str, ...] = ("demand_lag_168h", "price_lag_24h", "price_lag_12h", "demand_lag_12h")
    extra_keep: tuple[str, ...] = field(default_factory=tuple)


FLOW_SPEC = FeatureSpec(demand_lags=(1, 24), price_lags=(1, 24), required=("demand_lag_24h", "price_lag_24h"))

# ---- fixed values: defaults of the entered-values feature forms (M4) -------
DEMAND_FORM_DEFAULTS = {
    "demand_lag_1h": 28000.0, "demand_lag_24h": 27500.0, "price_lag_1h": 58.0, "price_lag_24h": 57.5,
    "demand_avg_24h": 27800.0, "price_avg_24h": 58.0, "forecast wind onshore day ahead": 7800.0,
    "forecast solar day ahead": 4200.0, "total load forecast": 28000.0,
}
PRICE_FORM_DEFAULTS = {
    "price_lag_1h": 58.0, "price_lag_12h": 57.0, "demand_lag_1h": 28000.0, "demand_lag_12h": 27200.0,
    "forecast wind onshore day ahead": 7800.0, "forecast solar day ahead": 4200.0,
    "price_avg_24h": 58.0, "demand_avg_24h": 27800.0, "total load forecast": 28000.0,
}
