"""Parameters of the forecasting and replenishment rules.

Fixed values: these numbers must equal the rules the library reproduces
(thresholds, windows, weights, caps), so they are stated plainly here and
nowhere else.  Product-specific configuration (aliases, lane overrides,
periodic / sporadic / obsolete product sets) is data: callers pass it as
small DataFrames or Python collections; the defaults are empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
LANES = ("daily", "periodic", "intermittent", "dormant")
ROUTING_WINDOW = 28
EXTENDED_WINDOWS = (60, 90)
MIN_ORDER_DAYS = 3
DORMANT_ZERO_RATE = 0.95
INTERMITTENT_ZERO_RATE = 0.65
PERIODIC_DELIVERY_WINDOW = 3
HORIZON_DAYS = 14

DOW_RECENT_DAYS = 21
DOW_DECAY = 0.95
DOW_TREND_CLIP = (0.3, 3.0)
V1_TREND_DAYS = 20

TREND_7_28_CLIP = (0.2, 5.0)
PRODUCT_CV_CLIP = (0.0, 10.0)
TIER_HIGH_MIN = 5.0
TIER_LOW_MIN = 0.5

SAFETY_MULTIPLIER = 1.15
SAFETY_VOLATILE_EXTRA = 0.10
SAFETY_VOLATILE_CV = 1.0
SPORADIC_MIN_ORDER_FREQ = 0.05

CORRECTION_CLIP = (0.5, 2.0)
CORRECTION_MIN_POINTS = 3
DEFAULT_WEIGHTS = {"dow": 0.33, "exp": 0.34, "gbt": 0.33}
WEIGHT_ERROR_FLOOR = 1e-3
GBT_ABSENT_FACTOR = 1.1
PER_PRODUCT_MIN_OBS = 7
BACKTEST_TEST_DAYS = 14
BACKTEST_MIN_TRAIN = 21
BACKTEST_MIN_TRAIN_ROWS = 7
GBT_MIN_ROWS = 20
RECENCY_HALF_LIFE = 30

CONFIDENCE_WEIGHTS = {"data": 0.30, "accuracy": 0.35, "stability": 0.20, "calibration": 0.15}
CONFIDENCE_HIGH = 70
CONFIDENCE_MEDIUM = 40

# replenishment app
FORECAST_METHODS = ("historical_simple_v1", "historical_weighted_v1")
USAGE_WINDOW_SHORT = 30
USAGE_WINDOW_LONG = 60
MIN_DATA_POINTS_HIGH = 5
WEIGHTED_DECAY = 0.9
WEIGHTED_DOW_MULTIPLIER = 0.0
ROUNDING_RULES = ("round_up_case_pack", "round_up_integer", "none")
PLAN_STATUSES = ("draft", "in_progress", "completed")
LINE_STATUSES = ("pending", "picked", "shorted", "loaded", "delivered")
CONFIDENCE_LEVELS = ("high", "medium", "low")
CSV_ROW_NOTICE = 10000           # files with more rows are flagged, never cut
CSV_MAX_QUANTITY = 999999
CSV_MAX_NOTE_LENGTH = 500        # longer notes are flagged, never cut
ACTIVITY_LOG_LIMIT = 200
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class ProductConfig:
    """Product-level configuration (the reference keeps it in literals)."""

    aliases: dict = field(default_factory=dict)          # variant name -> canonical
    lane_overrides: dict = field(default_factory=dict)   # product -> lane
    periodic: frozenset = frozenset()
    sporadic: frozenset = frozenset()
    obsolete: frozenset = frozenset()
    stores: tuple | None = None                           # None = keep every store
    rules: object = None      # DataFrame of catalogue.rules_at, in place of overrides and sets


@dataclass(frozen=True)
class AppParams:
    """Replenishment-app settings (defaults equal the reference config)."""

    forecast_method: str = "historical_simple_v1"
    window_short: int = USAGE_WINDOW_SHORT
    window_long: int = USAGE_WINDOW_LONG
    min_data_points: int = MIN_DATA_POINTS_HIGH
    decay: float = WEIGHTED_DECAY
    dow_multiplier: float = WEIGHTED_DOW_MULTIPLIER
    routing_window: int = ROUTING_WINDOW
    dormant_zero_rate: float = DORMANT_ZERO_RATE
    intermittent_zero_rate: float = INTERMITTENT_ZERO_RATE
    delivery_window: int = PERIODIC_DELIVERY_WINDOW
