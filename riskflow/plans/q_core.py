"""Registered queries: ingest, features, scoring, review."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskflow.functions import exprs as X
from riskflow.operators import features, ingest, review, rules, score
from riskflow.plans import views
from riskflow.plans.registry import query
from riskflow.plans.sqlparts import ARRIVAL_ORDER, BASE, REQ, TX, VALIDATED, flags, hist, scored, with_base
from riskflow.session import reliable, scratch_path
from riskflow.sources import adapters
from riskflow.sources.tables import projected_scan, write_partitioned

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_FMT_SQL = "'%Y-%m-%d %H:%M:%S.%f'"
REQ_BASE = f"WITH {REQ},\n{VALIDATED}"

# ---------------------------------------------------------------- ingest


@query("validate", REQ_BASE + "\nSELECT transaction_id, arrival_ts, copy, reject_reason FROM validated")
def q_validate(spark, d):
    return ingest.validate(adapters.event_requests(spark, d)).select(
        "transaction_id", "arrival_ts", "copy", "reject_reason")


@query("rejects", REQ_BASE + """
SELECT transaction_id, reject_reason, arrival_ts FROM validated WHERE reject_reason IS NOT NULL
UNION ALL
SELECT transaction_id, 'Duplicate transaction_id' AS reject_reason, arrival_ts FROM ranked WHERE arrival_rank > 1""")
def q_rejects(spark, d):
    _, rejects = ingest.split_requests(adapters.event_requests(spark, d))
    return rejects


@query("dedupe_first", REQ_BASE + "\nSELECT * EXCLUDE (arrival_ts, copy) FROM accepted")
def q_dedupe_first(spark, d):
    accepted, _ = ingest.split_requests(adapters.event_requests(spark, d))
    return accepted.drop("arrival_ts", "copy")


@query("clean_location", f"""WITH {TX}
SELECT transaction_id, trim(replace(CASE WHEN is_fraud = 1 THEN ' ' || location || chr(10) || ' '
                                         ELSE location END, chr(10), '')) AS location
FROM tx""")
def q_clean_location(spark, d):
    # fraud-labelled rows come from a feed that pads the location text
    dirty = views.tx(spark, d).withColumn(
        "location", F.when(F.col("is_fraud") == 1, F.concat(F.lit(" "), "location", F.lit("\n "))).otherwise(F.col("location")))
    return ingest.clean_location(dirty).select("transaction_id", "location")


@query("schema_evolve", f"""WITH {TX}
SELECT *, CAST(NULL AS DOUBLE) AS ml_anomaly_score, CAST(NULL AS VARCHAR) AS alert_reason,
       CAST(NULL AS INTEGER) AS is_anomaly, CAST(NULL AS VARCHAR) AS status FROM tx""")
def q_schema_evolve(spark, d):
    return ingest.schema_evolve(views.tx(spark, d))


@query("projected_scan", with_base("""SELECT transaction_id, account_id, amount, merchant_category, location,
       "timestamp", is_fraud, ml_anomaly_score FROM scored"""))
def q_projected_scan(spark, d):
    return projected_scan(views.scored(spark, d), ["transaction_id", "account_id", "amount", "merchant_category",
                                                   "location", "timestamp", "is_fraud", "ml_anomaly_score"])


# ---------------------------------------------------------------- features


@query("account_aggregates", f"""WITH {TX}
SELECT account_id, count(*) AS account_tx_count,
       CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100.0)
         AS account_avg_amount
FROM tx GROUP BY account_id""")
def q_account_aggregates(spark, d):
    return features.account_aggregates(views.tx(spark, d))


@query("history_before_row", f"""WITH {TX},
{hist('tx')}
SELECT transaction_id, account_id, account_tx_count, account_avg_amount, deviation_from_avg FROM hist""")
def q_history_before_row(spark, d):
    return features.history_before_row(views.tx(spark, d)).select(
        "transaction_id", "account_id", "account_tx_count", "account_avg_amount", "deviation_from_avg")


@query("history_by_arrival", f"""WITH {REQ},
{VALIDATED},
{hist('accepted', order=ARRIVAL_ORDER)}
SELECT transaction_id, account_id, account_tx_count, account_avg_amount FROM hist""")
def q_history_by_arrival(spark, d):
    """W1 on a feed whose arrival order is not its event order."""
    accepted, _ = ingest.split_requests(adapters.event_requests(spark, d))
    return features.history_before_row(accepted, order=("arrival_ts", "copy", "transaction_id")).select(
        "transaction_id", "account_id", "account_tx_count", "account_avg_amount")


@query("batch_history", f"""WITH {TX}
SELECT account_id, count(*) AS account_tx_count,
       CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100.0)
         AS account_avg_amount
FROM tx
WHERE "timestamp" < TIMESTAMP '2024-01-30 00:00:00'
  AND account_id IN (SELECT account_id FROM tx WHERE "timestamp" >= TIMESTAMP '2024-01-30 00:00:00')
GROUP BY account_id""")
def q_batch_history(spark, d):
    t = views.tx(spark, d)
    cut = F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00"))
    return features.batch_history(t.where(F.col("timestamp") >= cut), t.where(F.col("timestamp") < cut))


ACCOUNT_FEATURES_SQL = f"""WITH {TX},
af0 AS (
  SELECT *,
         CAST(sum(CAST(round(amount * 100) AS BIGINT)) OVER a AS DOUBLE)
           / (CAST(count(amount) OVER a AS DOUBLE) * 100.0) AS account_avg_amount,
         count(amount) OVER a AS account_tx_count,
         max(amount) OVER a AS account_max_amount
  FROM tx WINDOW a AS (PARTITION BY account_id)),
af AS (
  SELECT *, (amount - account_avg_amount) / (account_avg_amount + 1e-6) AS deviation_from_avg,
         amount / (account_max_amount + 1e-6) AS amount_to_max_ratio
  FROM af0)"""


@query("account_features", ACCOUNT_FEATURES_SQL + """
SELECT transaction_id, account_avg_amount, account_tx_count, account_max_amount,
       deviation_from_avg, amount_to_max_ratio FROM af""")
def q_account_features(spark, d):
    return features.account_features(views.tx(spark, d)).select(
        "transaction_id", "account_avg_amount", "account_tx_count", "account_max_amount",
        "deviation_from_avg", "amount_to_max_ratio")


TIME_SQL = """hour("timestamp") AS hour, CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
       CAST(isodow("timestamp") - 1 >= 5 AS INTEGER) AS is_weekend,
       CAST(hour("timestamp") >= 22 OR hour("timestamp") <= 6 AS INTEGER) AS is_night"""


@query("time_features", f"WITH {TX}\nSELECT transaction_id, {TIME_SQL} FROM tx")
def q_time_features(spark, d):
    return features.time_features(views.tx(spark, d)).select(
        "transaction_id", "hour", "day_of_week", "is_weekend", "is_night")


FEATURE_MATRIX_SQL = ACCOUNT_FEATURES_SQL + f""",
fm AS (
  SELECT transaction_id, is_fraud,
         COALESCE(CAST(amount AS DOUBLE), 0.0) AS amount,
         COALESCE(CAST(account_avg_amount AS DOUBLE), 0.0) AS account_avg_amount,
         COALESCE(CAST(deviation_from_avg AS DOUBLE), 0.0) AS deviation_from_avg,
         COALESCE(CAST(account_tx_count AS DOUBLE), 0.0) AS account_tx_count,
         COALESCE(CAST(amount_to_max_ratio AS DOUBLE), 0.0) AS amount_to_max_ratio,
         CAST(hour("timestamp") AS DOUBLE) AS hour,
         CAST(isodow("timestamp") - 1 AS DOUBLE) AS day_of_week,
         CAST(isodow("timestamp") - 1 >= 5 AS DOUBLE) AS is_weekend,
         CAST(hour("timestamp") >= 22 OR hour("timestamp") <= 6 AS DOUBLE) AS is_night
  FROM af)"""


@query("feature_matrix", FEATURE_MATRIX_SQL + "\nSELECT * FROM fm")
def q_feature_matrix(spark, d):
    return features.feature_matrix(views.tx(spark, d))


SPLIT_SQL = f"""WITH {TX},
sp AS (
  SELECT transaction_id, is_fraud,
         row_number() OVER (PARTITION BY is_fraud ORDER BY md5(transaction_id || ':42'), transaction_id) AS rk,
         count(*) OVER (PARTITION BY is_fraud) AS n
  FROM tx)"""


@query("stratified_split", SPLIT_SQL + """
SELECT transaction_id, is_fraud, CASE WHEN rk <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM sp""")
def q_stratified_split(spark, d):
    return features.stratified_split(views.tx(spark, d).select("transaction_id", "is_fraud"))


# ---------------------------------------------------------------- scoring

SCORED_FEAT = f"WITH {TX},\n{scored('tx', keep_features=True)}"


@query("scale_score", SCORED_FEAT + "\nSELECT transaction_id, ml_anomaly_score FROM scored")
def q_scale_score(spark, d):
    return views.scored(spark, d).select("transaction_id", "ml_anomaly_score")


@query("rule_hits", SCORED_FEAT + """
SELECT transaction_id, r_high_value, r_combo, r_deviation, r_ml,
       concat_ws(',', CASE WHEN r_high_value THEN 'High Value' END, CASE WHEN r_combo THEN 'Suspicious Combo' END,
                      CASE WHEN r_deviation THEN 'High Deviation' END, CASE WHEN r_ml THEN 'ML Risk' END) AS fired_rules
FROM scored""")
def q_rule_hits(spark, d):
    h = features.history_before_row(views.tx(spark, d))
    h = h.withColumn("ml_anomaly_score", X.scale_score(rules.reference_raw_score(),
                                                       rules.REFERENCE_MIN_SCORE, rules.REFERENCE_MAX_SCORE))
    r = rules.rule_hits(h)
    return r.select("transaction_id", "r_high_value", "r_combo", "r_deviation", "r_ml",
                    F.array_join("fired_rules", ",").alias("fired_rules"))


@query("alert_reason", SCORED_FEAT + "\nSELECT transaction_id, alert_reason, is_anomaly, status FROM scored")
def q_alert_reason(spark, d):
    return views.scored(spark, d).select("transaction_id", "alert_reason", "is_anomaly", "status")


@query("rules_fallback", f"""WITH {TX},
{hist('tx')},
fb AS (SELECT *, CAST(NULL AS DOUBLE) AS ml_anomaly_score FROM hist),
{flags('fb', 'fbf')}
SELECT transaction_id,
       CASE WHEN r_deviation THEN 'High Deviation from Avg'
            ELSE NULLIF(concat_ws(' & ', CASE WHEN r_high_value THEN 'High Value' END,
                                         CASE WHEN r_combo THEN 'Suspicious Combo' END), '') END AS reason_rules_mode,
       CAST(NULL AS DOUBLE) AS score_rules_mode,
       CAST(NULL AS VARCHAR) AS reason_zero_mode,
       0.0 AS score_zero_mode
FROM fbf""")
def q_rules_fallback(spark, d):
    """The model is unavailable (raw score NULL for every row)."""
    t = views.tx(spark, d)
    none = F.lit(None).cast("double")
    a = score.score_transactions(t, raw=none, fallback="rules").select(
        "transaction_id", F.col("alert_reason").alias("reason_rules_mode"),
        F.col("ml_anomaly_score").alias("score_rules_mode"))
    b = score.score_transactions(t, raw=none, fallback="zero").select(
        "transaction_id", F.col("alert_reason").alias("reason_zero_mode"),
        F.col("ml_anomaly_score").alias("score_zero_mode"))
    return a.join(b, "transaction_id")


# ---------------------------------------------------------------- review

SCORED_SQL_COLS = ("transaction_id, account_id, \"timestamp\", amount, merchant_category, location, is_fraud, "
                   "ml_anomaly_score, alert_reason, is_anomaly, status")


@query("top_anomalies", with_base(f"""SELECT {SCORED_SQL_COLS} FROM reviewed WHERE is_anomaly = 1
ORDER BY ml_anomaly_score DESC NULLS LAST, transaction_id LIMIT 100"""))
def q_top_anomalies(spark, d):
    return review.top_anomalies(views.reviewed(spark, d), limit=100)


@query("top_anomalies_page", with_base(f"""SELECT {SCORED_SQL_COLS} FROM reviewed
WHERE is_anomaly = 1 AND ml_anomaly_score >= 0.3 AND status = 'FRAUD'
ORDER BY ml_anomaly_score DESC NULLS LAST, transaction_id LIMIT 20 OFFSET 10"""))
def q_top_anomalies_page(spark, d):
    return review.top_anomalies(views.reviewed(spark, d), limit=20, offset=10, min_score=0.3, status="FRAUD")


@query("anomalies_filtered", with_base(f"""SELECT {SCORED_SQL_COLS} FROM reviewed
WHERE is_anomaly = 1 AND ml_anomaly_score >= 0.5 AND status = 'NEW'"""))
def q_anomalies_filtered(spark, d):
    return review.anomalies_filtered(views.reviewed(spark, d), min_score=0.5, status="new")


@query("normalise_status", with_base(f"""SELECT transaction_id, upper(COALESCE(status, 'NEW')) AS status,
       strftime("timestamp", {TS_FMT_SQL}) AS "timestamp" FROM reviewed WHERE is_anomaly = 1"""))
def q_normalise_status(spark, d):
    return review.normalise_status(views.anomalies(spark, d)).select("transaction_id", "status", "timestamp")


@query("review_queue", with_base("""SELECT transaction_id, amount, alert_reason, upper(COALESCE(status, 'NEW')) AS status
FROM reviewed WHERE is_anomaly = 1
  AND amount BETWEEN (SELECT min(amount) FROM reviewed WHERE is_anomaly = 1)
                 AND (SELECT max(amount) FROM reviewed WHERE is_anomaly = 1)
  AND upper(COALESCE(status, 'NEW')) IN ('NEW', 'INVESTIGATED')"""))
def q_review_queue(spark, d):
    return review.review_queue(views.anomalies(spark, d)).select("transaction_id", "amount", "alert_reason", "status")


@query("review_queue_filtered", with_base("""SELECT transaction_id, amount, alert_reason, upper(COALESCE(status, 'NEW')) AS status
FROM reviewed WHERE is_anomaly = 1 AND amount BETWEEN 100.0 AND 6000.0
  AND alert_reason = 'Suspicious Combo' AND upper(COALESCE(status, 'NEW')) IN ('NEW', 'FRAUD')"""))
def q_review_queue_filtered(spark, d):
    return review.review_queue(views.anomalies(spark, d), amount_range=(100.0, 6000.0),
                               reason="Suspicious Combo", statuses=["new", "FRAUD"]).select(
        "transaction_id", "amount", "alert_reason", "status")


@query("high_risk_open", with_base("""SELECT transaction_id, ml_anomaly_score FROM reviewed
WHERE is_anomaly = 1 AND COALESCE(ml_anomaly_score, 0.0) >= 0.8 AND upper(COALESCE(status, 'NEW')) = 'NEW'"""))
def q_high_risk_open(spark, d):
    return review.high_risk_open(views.anomalies(spark, d)).select("transaction_id", "ml_anomaly_score")


@query("point_lookup", with_base(f"""SELECT {SCORED_SQL_COLS} FROM reviewed WHERE account_id = 'ACC_0007'"""))
def q_point_lookup(spark, d):
    return views.reviewed(spark, d).where(F.col("account_id") == "ACC_0007")


@query("latest_transactions", with_base(f"""SELECT {SCORED_SQL_COLS} FROM reviewed
ORDER BY "timestamp" DESC, transaction_id DESC LIMIT 10"""))
def q_latest_transactions(spark, d):
    return review.latest_transactions(views.reviewed(spark, d), 10)


@query("status_update", with_base("SELECT transaction_id, status FROM reviewed"))
def q_status_update(spark, d):
    return views.reviewed(spark, d).select("transaction_id", "status")


@query("status_update_months", with_base("SELECT transaction_id, status FROM reviewed"))
def q_status_update_months(spark, d):
    """J5 on the stored monthly layout: only the months of updated rows are rewritten."""
    path = scratch_path(spark, f"scored-{uuid.uuid4().hex[:12]}")
    write_partitioned(views.scored(spark, d), path)
    table = spark.read.parquet(path)
    review.update_months(spark, path, reliable(score.review_decisions(table)))
    return score.legacy_rows_without_status(spark.read.parquet(path)).select("transaction_id", "status")


@query("status_update_report", with_base("""SELECT d.transaction_id, upper(d.new_status) AS new_status,
       CAST(count(s.transaction_id) AS BIGINT) AS matched_rows
FROM (SELECT * FROM decisions WHERE new_status IS NOT NULL) d
LEFT JOIN scored s ON s.transaction_id = d.transaction_id
GROUP BY d.transaction_id, d.new_status"""))
def q_status_update_report(spark, d):
    s = views.scored(spark, d)
    dec = score.review_decisions(s)
    matched = review.status_update(s, dec)[1]
    m = matched.select("transaction_id").withColumn("matched_rows", F.lit(1).cast("long"))
    return (dec.join(m, "transaction_id", "left")
               .select("transaction_id", F.upper("new_status").alias("new_status"),
                       F.coalesce("matched_rows", F.lit(0).cast("long")).alias("matched_rows")))


@query("risk_band", with_base("""SELECT transaction_id,
       CASE WHEN COALESCE(ml_anomaly_score, 0.0) >= 0.8 THEN 'HIGH'
            WHEN COALESCE(ml_anomaly_score, 0.0) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band
FROM reviewed WHERE is_anomaly = 1"""))
def q_risk_band(spark, d):
    return views.anomalies(spark, d).select("transaction_id", X.risk_band().alias("risk_band"))


@query("display_row", with_base("""SELECT transaction_id,
       CASE WHEN COALESCE(ml_anomaly_score, 0.0) >= 0.8 THEN 'HIGH'
            WHEN COALESCE(ml_anomaly_score, 0.0) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
       format('{:.3f}', COALESCE(ml_anomaly_score, 0.0)) || ' (' ||
       CASE WHEN COALESCE(ml_anomaly_score, 0.0) >= 0.8 THEN 'HIGH'
            WHEN COALESCE(ml_anomaly_score, 0.0) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END || ')' AS score_text,
       '€' || format('{:,.2f}', amount) AS amount_text,
       strftime("timestamp", '%Y-%m-%d %H:%M') AS time_text
FROM reviewed WHERE is_anomaly = 1"""))
def q_display_row(spark, d):
    return review.display_row(views.anomalies(spark, d))


@query("kpis", with_base("""SELECT (SELECT count(*) FROM reviewed) AS total_transactions,
       (SELECT count(*) FROM reviewed WHERE is_anomaly = 1) AS total_anomalies,
       round(COALESCE((SELECT count(*) FROM reviewed WHERE is_anomaly = 1) * 100.0
                      / NULLIF((SELECT count(*) FROM reviewed), 0), 0.0), 4) AS anomaly_rate_pct"""))
def q_kpis(spark, d):
    return review.kpis(views.reviewed(spark, d))


@query("by_category", with_base("""SELECT merchant_category, count(*) AS count FROM reviewed
WHERE is_anomaly = 1 AND upper(COALESCE(status, 'NEW')) <> 'DISMISSED'
GROUP BY merchant_category ORDER BY count DESC, merchant_category"""))
def q_by_category(spark, d):
    return review.by_category(views.anomalies(spark, d))


@query("by_status", with_base("""SELECT upper(COALESCE(status, 'NEW')) AS status, count(*) AS count FROM reviewed
WHERE is_anomaly = 1 GROUP BY 1 ORDER BY count DESC, status"""))
def q_by_status(spark, d):
    return review.by_status(views.anomalies(spark, d))


@query("filter_values", with_base("""SELECT
  (SELECT string_agg(alert_reason, ',' ORDER BY alert_reason) FROM (SELECT DISTINCT alert_reason FROM reviewed WHERE is_anomaly = 1)) AS reasons,
  (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT upper(COALESCE(status, 'NEW')) AS s FROM reviewed WHERE is_anomaly = 1)) AS statuses,
  (SELECT min(amount) FROM reviewed WHERE is_anomaly = 1) AS min_amount,
  (SELECT max(amount) FROM reviewed WHERE is_anomaly = 1) AS max_amount"""))
def q_filter_values(spark, d):
    fv = review.filter_values(views.anomalies(spark, d))
    return fv.select(F.array_join("reasons", ",").alias("reasons"), F.array_join("statuses", ",").alias("statuses"),
                     "min_amount", "max_amount")


@query("anomaly_count", with_base("SELECT count(*) AS count FROM reviewed WHERE is_anomaly = 1"))
def q_anomaly_count(spark, d):
    return review.anomaly_count(views.reviewed(spark, d))


__all__ = ["BASE"]
