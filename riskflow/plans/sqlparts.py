"""Independent SQL formulations (DuckDB dialect) of the shared views.

These are the oracle side of the correctness gate: plain window / CASE /
aggregate SQL over the driver tables, written separately from the Spark
operators (which use skew-safe multi-level plans for the same results).
"""

from riskflow import constants as C
from riskflow.operators.rules import REFERENCE_MAX_SCORE, REFERENCE_MIN_SCORE


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


CATS = _list(C.MERCHANT_CATEGORIES)
LOCS = _list(C.LOCATIONS)
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

TX = f"""tx AS (
  SELECT printf('TRX_%07d', event_id) AS transaction_id,
         printf('ACC_%04d', user_id) AS account_id,
         ts AS "timestamp",
         round(value * 20, 2) AS amount,
         {CATS}[event_id % 11 + 1] AS merchant_category,
         {LOCS}[{K} % 6 + 1] AS location,
         CAST(CASE WHEN event_type = 'error' AND value >= 100 THEN 1 ELSE 0 END AS INTEGER) AS is_fraud
  FROM events)"""

REQ = f"""req0 AS (
  SELECT *, {K} AS k, unnest(CASE WHEN {K} = 5 THEN [0, 1] WHEN {K} = 11 THEN [0, 0] ELSE [0] END) AS copy FROM events),
req AS (
  SELECT printf('TRX_%07d', event_id) AS transaction_id,
         CASE WHEN k = 0 THEN NULL ELSE printf('ACC_%04d', user_id) END AS account_id,
         CASE WHEN k = 2 THEN 'n/a'
              WHEN k = 1 THEN '-' || CAST(round(value * 20, 2) * (copy + 1) AS VARCHAR)
              WHEN k = 4 THEN '0' WHEN k = 6 THEN '12d' WHEN k = 9 THEN '1e300' WHEN k = 10 THEN 'NaN'
              ELSE CAST(round(value * 20, 2) * (copy + 1) AS VARCHAR) END AS amount,
         CASE WHEN k = 3 THEN NULL ELSE {CATS}[event_id % 11 + 1] END AS merchant_category,
         {LOCS}[k % 6 + 1] AS location,
         CASE WHEN k = 7 THEN '12:30:00' WHEN k = 8 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '+02:00'
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS "timestamp",
         CAST(CASE WHEN event_type = 'error' AND value >= 100 THEN 1 ELSE 0 END AS INTEGER) AS is_fraud,
         ts + to_hours(copy) AS arrival_ts,
         copy
  FROM req0)"""

UTC_TS = """CASE WHEN "timestamp" LIKE '%+02:00'
       THEN TRY_CAST(replace("timestamp", '+02:00', '') AS TIMESTAMP) - INTERVAL 2 HOUR
       ELSE TRY_CAST("timestamp" AS TIMESTAMP) END"""

REASON = f"""CASE
    WHEN transaction_id IS NULL THEN 'Missing required field: transaction_id'
    WHEN account_id IS NULL THEN 'Missing required field: account_id'
    WHEN amount IS NULL THEN 'Missing required field: amount'
    WHEN merchant_category IS NULL THEN 'Missing required field: merchant_category'
    WHEN location IS NULL THEN 'Missing required field: location'
    WHEN "timestamp" IS NULL THEN 'Missing required field: timestamp'
    WHEN TRY_CAST(amount AS DOUBLE) IS NULL THEN 'Invalid amount format: ' || amount
    WHEN TRY_CAST(amount AS DOUBLE) <= 0
      THEN 'Invalid amount: ' || CAST(TRY_CAST(amount AS DOUBLE) AS VARCHAR) || ' (must be positive)'
    WHEN is_fraud IS NULL THEN 'Missing required field: is_fraud'
    WHEN ({UTC_TS}) IS NULL THEN 'Invalid timestamp format: ' || "timestamp"
  END"""

VALIDATED = f"""validated AS (SELECT *, {REASON} AS reject_reason FROM req),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY arrival_ts, copy) AS arrival_rank
  FROM validated WHERE reject_reason IS NULL),
accepted AS (
  SELECT transaction_id, account_id, {UTC_TS} AS "timestamp",
         TRY_CAST(amount AS DOUBLE) AS amount, merchant_category, location, is_fraud, arrival_ts, copy
  FROM ranked WHERE arrival_rank = 1)"""


EVENT_ORDER = '"timestamp", transaction_id'
ARRIVAL_ORDER = "arrival_ts, copy, transaction_id"


def hist(src: str, name: str = "hist", order: str = EVENT_ORDER) -> str:
    """W1 + E1 over CTE ``src``: plain running window, current row excluded. Amounts that
    are no money add 0."""
    return f"""{name}_w AS (
  SELECT *,
         CAST(count(*) OVER w AS BIGINT) AS account_tx_count,
         CAST(COALESCE(sum(CASE WHEN abs(amount) <= 1e13 THEN CAST(round(amount * 100) AS BIGINT) ELSE 0 END) OVER w, 0) AS DOUBLE) AS _sum
  FROM {src}
  WINDOW w AS (PARTITION BY account_id ORDER BY {order}
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_a AS (
  SELECT * EXCLUDE (_sum),
         CASE WHEN account_tx_count > 0 THEN _sum / (CAST(account_tx_count AS DOUBLE) * 100.0) ELSE 0.0 END
           AS account_avg_amount
  FROM {name}_w),
{name} AS (
  SELECT *,
         CASE WHEN account_avg_amount > 0
              THEN (amount - account_avg_amount) / (account_avg_amount + 1e-6) ELSE 0.0 END
           AS deviation_from_avg
  FROM {name}_a)"""


LO = f"CAST({REFERENCE_MIN_SCORE!r} AS DOUBLE)"
HI = f"CAST({REFERENCE_MAX_SCORE!r} AS DOUBLE)"
RAW = ("round(CAST(0.1 AS DOUBLE) - CAST(0.03 AS DOUBLE) * ln(1.0 + amount / 100.0)"
       " - CAST(0.01 AS DOUBLE) * least(abs(deviation_from_avg), 10.0), 9)")


def scaled(raw: str = RAW) -> str:
    return f"(1.0 - ({raw} - {LO}) / ({HI} - {LO}))"


def flags(src: str, name: str, score: str = "ml_anomaly_score") -> str:
    """R1-R4 flags over ``src`` (needs amount, category, location, deviation, count, score)."""
    return f"""{name} AS (
  SELECT *,
         COALESCE(amount >= 5000.0, false) AS r_high_value,
         COALESCE(merchant_category = 'Gambling' AND location IS DISTINCT FROM 'Helsinki', false) AS r_combo,
         COALESCE(deviation_from_avg >= 5.0 AND account_tx_count > 5, false) AS r_deviation,
         COALESCE({score} >= 0.7, false) AS r_ml
  FROM {src})"""


REASON_SQL = """CASE WHEN r_ml THEN 'ML Anomaly'
            WHEN r_deviation THEN 'High Deviation from Avg'
            ELSE NULLIF(concat_ws(' & ', CASE WHEN r_high_value THEN 'High Value' END,
                                         CASE WHEN r_combo THEN 'Suspicious Combo' END), '') END"""

SCORED_COLS = ("transaction_id, account_id, \"timestamp\", amount, merchant_category, location, is_fraud, "
               "ml_anomaly_score, alert_reason, is_anomaly, status")


def scored(src: str = "tx", name: str = "scored", keep_features: bool = False, order: str = EVENT_ORDER) -> str:
    """Full scoring over CTE ``src`` -> CTE ``name`` with the SCORED columns."""
    cols = "*" if keep_features else SCORED_COLS
    return f"""{hist(src, name + '_h', order)},
{name}_s AS (SELECT *, {scaled()} AS ml_anomaly_score FROM {name}_h),
{flags(name + '_s', name + '_f')},
{name}_r AS (SELECT *, {REASON_SQL} AS alert_reason FROM {name}_f),
{name}_x AS (
  SELECT *, CAST(alert_reason IS NOT NULL AS INTEGER) AS is_anomaly,
         CASE WHEN alert_reason IS NOT NULL THEN 'NEW' END AS status
  FROM {name}_r),
{name} AS (SELECT {cols} FROM {name}_x)"""


DECISIONS = """decisions AS (
  SELECT transaction_id,
         CASE WHEN is_fraud = 1 THEN 'FRAUD'
              WHEN merchant_category IN ('Groceries', 'Utility Bill') THEN 'DISMISSED'
              WHEN merchant_category = 'Travel' THEN 'investigated' END AS new_status
  FROM scored WHERE is_anomaly = 1)"""

REVIEWED = f"""{DECISIONS},
reviewed AS (
  SELECT s.* REPLACE (
           CASE WHEN s.location = 'Espoo' THEN NULL
                ELSE COALESCE(upper(d.new_status), s.status) END AS status)
  FROM scored s LEFT JOIN (SELECT * FROM decisions WHERE new_status IS NOT NULL) d
    ON s.transaction_id = d.transaction_id)"""

# the canonical prologue: events -> tx -> scored -> reviewed
BASE = f"WITH {TX},\n{scored('tx')},\n{REVIEWED}"


def with_base(body: str) -> str:
    return BASE + "\n" + body
