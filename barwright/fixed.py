"""Numbers, labels and lists that results depend on.

Everything here is a constant of the domain rules, kept as plain text in
natural order so that it can be compared with a specification by eye.
"""

EXCHANGES = ["DSE", "CSE"]
ACTIONS = ["BUY", "HOLD", "SELL", "WATCH"]
SYNTHETIC_SOURCES = ["cse_mirror_fallback", "synthetic_demo", "synthetic_fallback"]

# Data quality
ABNORMAL_JUMP_PCT = 25.0
GAP_CALENDAR_DAYS = 10
STALE_RUN_MIN_LENGTH = 5
REVISION_EPSILON = 1e-9
TRAINING_EXCLUDE_FLAGS = [
    "non_positive_open",
    "non_positive_high",
    "non_positive_low",
    "non_positive_close",
    "negative_volume",
    "high_below_low",
    "close_out_of_range",
    "abnormal_jump",
]
STRICT_EXCLUDE_FLAGS = [*TRAINING_EXCLUDE_FLAGS, "open_out_of_range"]
RESEARCH_FLAGS = ["external_research_backfill", "unadjusted_prices", "traded_value_unavailable"]

# Feature lists
FORWARD_FEATURES = [
    "rsi_14", "macd_hist", "return_5d", "return_20d", "volatility_20", "volume_ratio",
    "turnover_ratio", "dist_sma20", "dist_sma50", "rel_ret_1d", "rel_ret_5d", "rel_ret_20d",
    "stock_sector_rel_1d", "sector_index_rel_1d", "vol_regime", "trend_regime",
]
NEXT_CLOSE_FEATURES = [
    "rsi_14", "macd_hist", "return_5d", "return_20d", "volatility_20", "volume_ratio",
    "dist_sma20", "dist_sma50", "index_ret_1d", "sector_ret_1d", "breadth", "rel_ret_1d",
    "rel_ret_5d", "rel_ret_20d", "stock_sector_rel_1d", "sector_index_rel_1d", "vol_regime",
    "trend_regime", "return_1d", "return_2d", "return_3d", "intraday_return", "overnight_gap",
    "range_atr", "close_location", "volume_acceleration", "turnover_acceleration",
    "up_down_streak",
]
TECHNICAL_FEATURES = [
    "rsi_14", "macd_hist", "return_5d", "return_20d", "volatility_20", "volume_ratio",
    "dist_sma20", "dist_sma50",
]

# Sentiment gauge: exclusive upper bound of each label
SENTIMENT_BOUNDS = [
    (-60, "Extremely Bearish"),
    (-30, "Bearish"),
    (-10, "Slightly Bearish"),
    (10, "Neutral"),
    (30, "Slightly Bullish"),
    (60, "Bullish"),
    (101, "Extremely Bullish"),
]
# Confidence bands: inclusive lower bound of each label
CONFIDENCE_BANDS = [
    (0.80, "Very high"),
    (0.60, "High"),
    (0.40, "Moderate"),
    (0.20, "Low"),
]
CONFIDENCE_FLOOR = "Very low"
EVIDENCE_BANDS = [(300, "Stronger evidence"), (100, "Moderate"), (30, "Limited"), (1, "Very limited")]
EVIDENCE_NONE = "No evidence"

# Next-close learning
BIAS_ALPHA_GLOBAL = 0.08
BIAS_ALPHA_STOCK = 0.12
BIAS_CAP = 0.01
BIAS_MIN_SETTLES = 8
FLAT_RETURN = 0.005
MIN_DIRECTION_CONFIDENCE = 0.65
LIQUID_TOP_N = 80
MIN_HISTORY = 40

# Trading costs in percent per side
BROKERAGE_PCT = 0.30
TAX_PCT = 0.05
SPREAD_PCT = 0.10
SLIPPAGE_PCT = 0.10
MIN_LIQUIDITY_SHARES = 100
ENTRY_RETRY_SESSIONS = 5
TRADING_DAYS_PER_YEAR = 250

# Reliability
WINDOW_SIZES = [30, 90, 180, 365]
PSI_MODERATE = 0.10
PSI_MAJOR = 0.25
HIGH_CALIBRATION_ERROR = 0.15

# Operations
STALE_DATA_DAYS = 4
STUCK_JOB_MINUTES = 20
ORPHAN_GRACE_SECONDS = 120
DEFAULT_HARD_LIMIT_SECONDS = 600

# Price-history ranges in days
HISTORY_RANGES = {"3d": 3, "7d": 7, "15d": 15, "30d": 30, "3m": 90, "6m": 180, "1y": 365, "2y": 730, "5y": 1825}
