"""Fixed values that must equal the original system's for equal results.

These are data, not logic: names, thresholds, message texts, maps.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the behaviour being reproduced)
# ---------------------------------------------------------------------------

# Merchant categories and locations of the transaction data, in order.
MERCHANT_CATEGORIES = [
    "Groceries", "Gas Station", "Online Retail", "Fast Food",
    "Travel", "Subscription", "Utility Bill", "ATM Withdrawal",
    "Jewelry", "Electronics", "Gambling",
]
LOCATIONS = ["Helsinki", "Oulu", "Tampere", "Turku", "Espoo", "Vantaa"]

# Scoring rules.
HIGH_VALUE_THRESHOLD = 5000.00
SUSPICIOUS_MERCHANT = "Gambling"
STANDARD_LOCATION = "Helsinki"
DEVIATION_THRESHOLD = 5.0
MIN_HISTORY_COUNT = 5          # rule needs history count > 5
ML_RISK_THRESHOLD = 0.7
DEVIATION_EPSILON = 1e-6
REASON_HIGH_VALUE = "High Value"
REASON_COMBO = "Suspicious Combo"
REASON_DEVIATION = "High Deviation"
REASON_ML = "ML Risk"
ALERT_ML = "ML Anomaly"
ALERT_DEVIATION = "High Deviation from Avg"
REASON_JOINER = " & "

# Required request fields, in the order they are checked.
REQUIRED_FIELDS = ["transaction_id", "account_id", "amount",
                   "merchant_category", "location", "timestamp"]

# Review statuses.
STATUSES = ["NEW", "INVESTIGATED", "FRAUD", "DISMISSED"]

# Alert severities and their thresholds.
CRITICAL_RISK_THRESHOLD = 0.9
HIGH_RISK_THRESHOLD = 0.8
WARNING_RISK_THRESHOLD = 0.6
SEVERITY_HIGH_VALUE = 5000.0
NOTIFY_SEVERITIES = ["high", "critical"]
CHANNELS = ["slack", "discord", "teams", "email", "webhook"]

# Payload colours / emoji per severity (critical, high, warning, info).
SLACK_COLORS = {"critical": "#FF0000", "high": "#FF6600", "warning": "#FFCC00", "info": "#0099FF"}
SLACK_EMOJI = {"critical": "\U0001F6A8", "high": "⚠️", "warning": "⚡", "info": "ℹ️"}
DISCORD_COLORS = {"critical": 16711680, "high": 16737792, "warning": 16776960, "info": 43775}
TEAMS_COLORS = {"critical": "attention", "high": "warning", "warning": "warning", "info": "accent"}
ALERT_FOOTER = "Fraud Detection System"
TEAMS_CONTEXT = "https://schema.org/extensions"

# Card-charge metadata category map, in its natural (lookup) order.
CATEGORY_MAPPING = [
    ("subscription", "Subscription"),
    ("food_delivery", "Food"),
    ("online_shopping", "Shopping"),
    ("travel", "Travel"),
    ("entertainment", "Entertainment"),
    ("utilities", "Utilities"),
    ("gas_station", "Gas"),
    ("restaurant", "Food"),
    ("hotel", "Travel"),
    ("gambling", "Gambling"),
]

# Review risk bands.
RISK_HIGH = 0.8
RISK_MEDIUM = 0.5

# Model lifecycle.
MIN_TRAIN_SAMPLES = 1000
MAX_NULL_FRACTION = 0.1
PROMOTION_MIN_IMPROVEMENT = 0.02
MODEL_STAGES = ["None", "Staging", "Production", "Archived"]
TRAIN_FEATURES_3 = ["amount", "account_avg_amount", "deviation_from_avg"]
TRAIN_FEATURES_9 = ["amount", "account_avg_amount", "deviation_from_avg",
                    "account_tx_count", "amount_to_max_ratio",
                    "hour", "day_of_week", "is_weekend", "is_night"]
QUALITY_REQUIRED_COLUMNS = ["transaction_id", "account_id", "amount", "timestamp", "is_fraud"]

# Drift verdict.
DRIFT_MIN_SAMPLES = 100
BASELINE_F1 = 0.7
DEGRADATION_THRESHOLD = 0.1
MAX_PREDICTION_RATE = 0.8
MIN_PREDICTION_RATE = 0.001
MAX_FPR = 0.3
MAX_FNR = 0.5

# Retention (days).
RETENTION_DAYS = 90
ARCHIVE_DAYS = 365
PURGE_DAYS = 2555

# Isolation forest.
N_TREES = 100
MAX_SAMPLES = 256
FOREST_SEED = 42
EULER_GAMMA = 0.5772156649

# Monitoring alert rules: name, metric, window (s), op, threshold, for (s),
# severity, service, evaluation interval (s).
ALERT_RULES = [
    ("HighRiskFraudSpike", "anomaly_rate", 300, ">", 0.1, 120, "critical", "fraud-detection", 30),
    ("TransactionVolumeSpike", "processed_rate", 300, ">", 10.0, 300, "warning", "fraud-detection", 30),
    ("TransactionProcessingErrors", "error_rate", 300, ">", 0.01, 120, "warning", "detection-service", 30),
    ("APIHighErrorRate", "http_error_share", 300, ">", 0.05, 120, "warning", "api", 30),
    ("APIHighLatency", "latency_p95", 300, ">", 1.0, 300, "warning", "api", 30),
    ("NoTransactionsProcessed", "processed_increase", 600, "==", 0.0, 600, "warning", "detection-service", 60),
    ("AnomalyRateTooHigh", "anomaly_share", 1800, ">", 0.5, 900, "warning", "ml-model", 60),
    ("AnomalyRateTooLow", "anomaly_share", 1800, "<", 0.001, 900, "info", "ml-model", 60),
]

# Histogram bucket upper bounds (seconds); +Inf is implicit.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
PROCESSING_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0]
CACHE_TTL_SECONDS = 60

# amounts beyond this add nothing to sums of money (exact in a double)
MAX_MONEY = 1e13

# drift alert rules: (alert, severity, service, ``for`` in seconds)
DRIFT_ALERT = ("ModelDriftDetected", "warning", "ml-model", 300)
F1_ALERT = ("ModelF1ScoreLow", "critical", "ml-model", 600)
F1_FLOOR = 0.5
