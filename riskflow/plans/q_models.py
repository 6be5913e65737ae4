"""Registered queries: alerts, evaluation, drift, model lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import alerts, drift, evaluate, features, lifecycle, rules
from riskflow.plans import views
from riskflow.plans.registry import query
from riskflow.session import reliable
from riskflow.plans.sqlparts import BASE, SCORED_COLS, TX

AS_OF = "2024-01-31 00:00:00"
ENABLED = ["slack", "email", "webhook"]

STORE = BASE + f""",
store AS (
  SELECT transaction_id, account_id, "timestamp", amount, merchant_category, location, is_fraud,
         CAST(NULL AS DOUBLE) AS ml_anomaly_score, CAST(NULL AS VARCHAR) AS alert_reason,
         CAST(NULL AS INTEGER) AS is_anomaly, CAST(NULL AS VARCHAR) AS status
  FROM tx WHERE "timestamp" < TIMESTAMP '2024-01-04 00:00:00'
  UNION ALL
  SELECT {SCORED_COLS} FROM reviewed WHERE "timestamp" >= TIMESTAMP '2024-01-04 00:00:00'),
pred AS (
  SELECT transaction_id, "timestamp", is_fraud AS actual_label, is_anomaly AS predicted_label,
         ml_anomaly_score, status
  FROM store WHERE is_anomaly IS NOT NULL)"""

SEV_SQL = """CASE WHEN ml_anomaly_score >= 0.9 THEN 'critical'
            WHEN ml_anomaly_score >= 0.8 OR amount >= 5000.0 THEN 'high'
            WHEN ml_anomaly_score >= 0.6 THEN 'warning' ELSE 'info' END"""

# ---------------------------------------------------------------- alerts


@query("severity", BASE + f"""
SELECT transaction_id, {SEV_SQL} AS severity, {SEV_SQL} IN ('high', 'critical') AS notify
FROM reviewed WHERE is_anomaly = 1""")
def q_severity(spark, d):
    return alerts.with_severity(views.anomalies(spark, d)).select("transaction_id", "severity", "notify")


OUTBOX_SQL = BASE + f""",
sev AS (SELECT *, {SEV_SQL} AS severity FROM reviewed WHERE is_anomaly = 1),
box AS (
  SELECT transaction_id, unnest(['slack', 'email', 'webhook']) AS channel, severity
  FROM sev WHERE severity IN ('high', 'critical'))"""


@query("alert_outbox", OUTBOX_SQL + "\nSELECT transaction_id, channel, severity FROM box")
def q_alert_outbox(spark, d):
    return alerts.outbox(views.reviewed(spark, d), enabled=ENABLED).select("transaction_id", "channel", "severity")


@query("alert_payloads")
def q_alert_payloads(spark, d):
    """Payload JSON per (alert, channel) -- golden-tested in pytest."""
    return alerts.outbox(views.reviewed(spark, d), enabled=list(alerts.C.CHANNELS))


@query("alert_log", OUTBOX_SQL + """
SELECT b.transaction_id, b.severity, string_agg(b.channel, ',' ORDER BY b.channel) AS channels,
       count(*) AS n_channels, r.ml_anomaly_score, r."timestamp"
FROM box b JOIN reviewed r ON r.transaction_id = b.transaction_id
GROUP BY b.transaction_id, b.severity, r.ml_anomaly_score, r."timestamp\"""")
def q_alert_log(spark, d):
    r = views.reviewed(spark, d)
    return alerts.delivery_log(alerts.outbox(r, enabled=ENABLED), r)


@query("alert_counts", OUTBOX_SQL + """,
lg AS (SELECT b.transaction_id, b.severity, r."timestamp" FROM box b JOIN reviewed r USING (transaction_id)
       GROUP BY ALL)
SELECT date_trunc('day', "timestamp") AS window_start, severity, count(*) AS alerts FROM lg GROUP BY ALL""")
def q_alert_counts(spark, d):
    r = views.reviewed(spark, d)
    return alerts.alert_counts(alerts.delivery_log(alerts.outbox(r, enabled=ENABLED), r))


@query("ab_route", f"""WITH {TX}
SELECT transaction_id, CAST(('0x' || substr(md5(transaction_id), 1, 8)) AS BIGINT) % 100 AS ab_bucket,
       CASE WHEN CAST(('0x' || substr(md5(transaction_id), 1, 8)) AS BIGINT) % 100 < 10 THEN 'B' ELSE 'A' END
         AS model_variant
FROM tx""")
def q_ab_route(spark, d):
    return alerts.ab_route(views.tx(spark, d), split=0.1).select("transaction_id", "ab_bucket", "model_variant")


# ---------------------------------------------------------------- evaluation


@query("union_append", STORE + "\nSELECT * FROM store")
def q_union_append(spark, d):
    return views.store(spark, d)


@query("lookback", STORE + f"""
SELECT * FROM store WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def q_lookback(spark, d):
    return evaluate.lookback(views.store(spark, d), AS_OF, 7)


@query("scored_only", STORE + "\nSELECT * FROM pred")
def q_scored_only(spark, d):
    return views.predictions(spark, d)


CONF_SQL = """count(*) FILTER (WHERE actual_label = 0 AND predicted_label = 0) AS tn,
       count(*) FILTER (WHERE actual_label = 0 AND predicted_label = 1) AS fp,
       count(*) FILTER (WHERE actual_label = 1 AND predicted_label = 0) AS fn,
       count(*) FILTER (WHERE actual_label = 1 AND predicted_label = 1) AS tp,
       count(*) AS sample_count,
       COALESCE(avg(CAST(actual_label AS DOUBLE)), 0.0) AS fraud_rate,
       COALESCE(avg(CAST(predicted_label AS DOUBLE)), 0.0) AS prediction_rate"""


def metrics_sql(src: str, digits: int | None = 6, keys: str = "") -> str:
    r = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: e)
    div = lambda a, b: f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"
    return f"""SELECT {keys}tn, fp, fn, tp, sample_count,
       {r(div('tp', 'tp + fp'))} AS precision, {r(div('tp', 'tp + fn'))} AS recall,
       {r(div('2 * tp', '2 * tp + fp + fn'))} AS f1_score, {r(div('tp + tn', 'sample_count'))} AS accuracy,
       {r(div('fp', 'tn + fp'))} AS false_positive_rate, {r(div('fn', 'fn + tp'))} AS false_negative_rate,
       {r('fraud_rate')} AS fraud_rate, {r('prediction_rate')} AS prediction_rate
FROM {src}"""


@query("confusion", STORE + "\nSELECT tn, fp, fn, tp, sample_count FROM (SELECT " + CONF_SQL + " FROM pred)")
def q_confusion(spark, d):
    return evaluate.confusion(views.predictions(spark, d)).select("tn", "fp", "fn", "tp", "sample_count")


@query("class_metrics", STORE + ",\ncm AS (SELECT " + CONF_SQL + " FROM pred)\n" + metrics_sql("cm"))
def q_class_metrics(spark, d):
    return evaluate.class_metrics(views.predictions(spark, d))


def verdict_sql(baseline: float = 0.7, thr: float = 0.1) -> str:
    pct = lambda c: f"format('{{:.1f}}', {c} * 100) || '%'"
    return f"""CASE WHEN sample_count < 100 THEN false
            WHEN {baseline} - f1_score > {thr} THEN true
            WHEN prediction_rate > 0.8 THEN true WHEN prediction_rate < 0.001 THEN true
            WHEN false_positive_rate > 0.3 THEN true WHEN false_negative_rate > 0.5 THEN true
            ELSE false END AS drift_detected,
       CASE WHEN sample_count < 100 THEN 'Insufficient samples (' || sample_count || ') for drift detection'
            WHEN {baseline} - f1_score > {thr}
              THEN 'F1 degradation: ' || format('{{:.3f}}', {baseline} - f1_score) || ' (threshold: {thr})'
            WHEN prediction_rate > 0.8
              THEN 'Excessive fraud predictions: ' || {pct('prediction_rate')} || ' (possible model malfunction)'
            WHEN prediction_rate < 0.001
              THEN 'Too few fraud predictions: ' || {pct('prediction_rate')} || ' (model may not be detecting fraud)'
            WHEN false_positive_rate > 0.3 THEN 'High false positive rate: ' || {pct('false_positive_rate')}
            WHEN false_negative_rate > 0.5 THEN 'High false negative rate: ' || {pct('false_negative_rate')}
            ELSE 'Model performance within acceptable range' END AS drift_reason"""


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


DRIFT_SQL = STORE + f""",
cm AS (SELECT {CONF_SQL} FROM pred WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY),
m AS ({metrics_sql('cm', None)})
SELECT * EXCLUDE (precision, recall, f1_score, accuracy, false_positive_rate, false_negative_rate,
                  fraud_rate, prediction_rate),
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       round(accuracy, 6) AS accuracy, round(false_positive_rate, 6) AS false_positive_rate,
       round(false_negative_rate, 6) AS false_negative_rate, round(fraud_rate, 6) AS fraud_rate,
       round(prediction_rate, 6) AS prediction_rate,
       {verdict_sql()}
FROM m"""


@query("drift_verdict", DRIFT_SQL)
def q_drift_verdict(spark, d):
    return _rounded(drift.drift_verdict(evaluate.lookback(views.predictions(spark, d), AS_OF, 7)))


DAILY_SQL = STORE + f""",
cm AS (SELECT date_trunc('day', "timestamp") AS day, {CONF_SQL} FROM pred GROUP BY 1),
m AS ({metrics_sql('cm', None, 'day, ')}),
daily AS (SELECT *, {verdict_sql()} FROM m)"""


@query("drift_daily", DAILY_SQL + """
SELECT day, tn, fp, fn, tp, sample_count, round(f1_score, 6) AS f1_score, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(prediction_rate, 6) AS prediction_rate, drift_detected, drift_reason
FROM daily""")
def q_drift_daily(spark, d):
    dd = drift.drift_daily(views.predictions(spark, d))
    return _rounded(dd.select("day", "tn", "fp", "fn", "tp", "sample_count", "f1_score", "precision", "recall",
                              "prediction_rate", "drift_detected", "drift_reason"))


@query("drift_alerts", DAILY_SQL + """,
held AS (
  SELECT day, 'ModelDriftDetected' AS alert, 'warning' AS severity, 5 AS mins FROM daily WHERE drift_detected
  UNION ALL SELECT day, 'ModelF1ScoreLow', 'critical', 10 FROM daily WHERE f1_score < 0.5),
runs AS (SELECT *, day - to_days(CAST(row_number() OVER (PARTITION BY alert ORDER BY day) AS INTEGER)) AS run FROM held)
SELECT alert, severity, 'ml-model' AS service, min(day) AS active_start, min(day) + to_minutes(any_value(mins)) AS firing_start,
       max(day) + INTERVAL 1 DAY AS firing_end
FROM runs GROUP BY alert, severity, run""")
def q_drift_alerts(spark, d):
    return drift.drift_alerts(drift.drift_daily(views.predictions(spark, d)))


# ---- training-side evaluation on the stratified test split

FEATS = ["amount", "deviation_from_avg", "account_tx_count", "amount_to_max_ratio", "hour"]


def _train_frame(spark, d):
    t = views.tx(spark, d)
    f = features.time_features(features.account_features(t))
    f = f.withColumn("raw_score", rules.reference_raw_score("amount", "deviation_from_avg"))
    return features.stratified_split(f)


TRAIN_SQL = f"""WITH {TX},
tf0 AS (
  SELECT *,
         CAST(sum(CAST(round(amount * 100) AS BIGINT)) OVER a AS DOUBLE)
           / (CAST(count(amount) OVER a AS DOUBLE) * 100.0) AS account_avg_amount,
         count(amount) OVER a AS account_tx_count, max(amount) OVER a AS account_max_amount,
         row_number() OVER (PARTITION BY is_fraud ORDER BY md5(transaction_id || ':42'), transaction_id) AS rk,
         count(*) OVER (PARTITION BY is_fraud) AS n
  FROM tx WINDOW a AS (PARTITION BY account_id)),
tf1 AS (
  SELECT *, (amount - account_avg_amount) / (account_avg_amount + 1e-6) AS deviation_from_avg,
         amount / (account_max_amount + 1e-6) AS amount_to_max_ratio, hour("timestamp") AS hour,
         CASE WHEN rk <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM tf0),
tf AS (
  SELECT *, round(CAST(0.1 AS DOUBLE) - CAST(0.03 AS DOUBLE) * ln(1.0 + amount / 100.0)
                  - CAST(0.01 AS DOUBLE) * least(abs(deviation_from_avg), 10.0), 9) AS raw_score
  FROM tf1)"""


@query("eval_stats", TRAIN_SQL + """,
ev AS (
  SELECT count(*) FILTER (WHERE is_fraud = 1 AND raw_score < 0) AS tp,
         count(*) FILTER (WHERE is_fraud = 0 AND raw_score < 0) AS fp,
         count(*) FILTER (WHERE is_fraud = 1 AND raw_score >= 0) AS fn,
         avg(CAST(raw_score < 0 AS DOUBLE)) AS rate, min(raw_score) AS mn, max(raw_score) AS mx,
         avg(raw_score) AS mean, stddev_pop(raw_score) AS sd
  FROM tf WHERE split = 'test')
SELECT round(COALESCE(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0), 6) AS precision,
       round(COALESCE(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0), 6) AS recall,
       round(COALESCE(2 * tp / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0), 6) AS f1_score,
       round(rate, 6) AS fraud_detection_rate, round(mn, 6) AS min_anomaly_score,
       round(mx, 6) AS max_anomaly_score, round(mean, 6) AS mean_anomaly_score, round(sd, 6) AS std_anomaly_score
FROM ev""")
def q_eval_stats(spark, d):
    return evaluate.eval_stats(_train_frame(spark, d).where("split = 'test'"))


@query("roc_auc", TRAIN_SQL + """,
g AS (SELECT -raw_score AS s, count(*) FILTER (WHERE is_fraud = 1) AS pos,
             count(*) FILTER (WHERE is_fraud = 0) AS neg
      FROM tf WHERE split = 'test' GROUP BY 1),
c AS (SELECT *, COALESCE(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS below FROM g)
SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                  THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) ELSE 0.0 END, 6) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM c""")
def q_roc_auc(spark, d):
    return evaluate.roc_auc(_train_frame(spark, d).where("split = 'test'"), "is_fraud", -F.col("raw_score"))


@query("null_profile", STORE + f"""
SELECT count(*) AS row_count,
       round(count(*) FILTER (WHERE transaction_id IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_frac_transaction_id,
       round(count(*) FILTER (WHERE account_id IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_frac_account_id,
       round(count(*) FILTER (WHERE amount IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_frac_amount,
       round(count(*) FILTER (WHERE "timestamp" IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_frac_timestamp,
       round(count(*) FILTER (WHERE is_fraud IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_frac_is_fraud,
       COALESCE(max(CAST(amount <= 0 AS INTEGER)), 0) AS any_nonpositive_amount,
       round(avg(CAST(is_fraud AS DOUBLE)), 6) AS fraud_rate
FROM store WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY""")
def q_null_profile(spark, d):
    return evaluate.null_profile(evaluate.lookback(views.store(spark, d), AS_OF, 90))


@query("quality_gate", STORE + f""",
p AS (SELECT count(*) AS n, max(CAST(amount <= 0 AS INTEGER)) AS nonpos, avg(CAST(is_fraud AS DOUBLE)) AS fr,
             greatest(count(*) FILTER (WHERE transaction_id IS NULL), count(*) FILTER (WHERE account_id IS NULL),
                      count(*) FILTER (WHERE amount IS NULL), count(*) FILTER (WHERE "timestamp" IS NULL),
                      count(*) FILTER (WHERE is_fraud IS NULL)) / CAST(count(*) AS DOUBLE) AS worst_null
      FROM store WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)
SELECT 1 AS check_order, 'min_samples' AS "check", 'error' AS severity, COALESCE(n < 1000, false) AS failed FROM p
UNION ALL SELECT 2, 'required_columns', 'error', false FROM p
UNION ALL SELECT 3, 'excessive_nulls', 'error', COALESCE(worst_null > 0.1, false) FROM p
UNION ALL SELECT 4, 'amount_positive', 'error', COALESCE(nonpos = 1, false) FROM p
UNION ALL SELECT 5, 'no_fraud_labels', 'warning', COALESCE(fr = 0, false) FROM p
UNION ALL SELECT 6, 'high_fraud_rate', 'warning', COALESCE(fr > 0.5, false) FROM p""")
def q_quality_gate(spark, d):
    return evaluate.quality_gate(evaluate.lookback(views.store(spark, d), AS_OF, 90))


DRIFT_FEATS = ["amount", "deviation_from_avg", "account_tx_count", "hour"]
SPLIT_TS = "2024-01-16 00:00:00"


def _drift_sides(spark, d):
    t = views.tx(spark, d)
    f = features.time_features(features.account_features(t))
    cut = F.to_timestamp_ntz(F.lit(SPLIT_TS))
    return f.where(F.col("timestamp") < cut), f.where(F.col("timestamp") >= cut)


LONG_SQL = f"""WITH {TX},
f0 AS (
  SELECT *,
         CAST(sum(CAST(round(amount * 100) AS BIGINT)) OVER a AS DOUBLE)
           / (CAST(count(amount) OVER a AS DOUBLE) * 100.0) AS account_avg_amount,
         count(amount) OVER a AS account_tx_count
  FROM tx WINDOW a AS (PARTITION BY account_id)),
f1 AS (SELECT *, (amount - account_avg_amount) / (account_avg_amount + 1e-6) AS deviation_from_avg,
              hour("timestamp") AS hour,
              CASE WHEN "timestamp" < TIMESTAMP '{SPLIT_TS}' THEN 'ref' ELSE 'cur' END AS side FROM f0),
lng AS (
  SELECT side, 'amount' AS feature, CAST(amount AS DOUBLE) AS value FROM f1
  UNION ALL SELECT side, 'deviation_from_avg', CAST(deviation_from_avg AS DOUBLE) FROM f1
  UNION ALL SELECT side, 'account_tx_count', CAST(account_tx_count AS DOUBLE) FROM f1
  UNION ALL SELECT side, 'hour', CAST(hour AS DOUBLE) FROM f1)"""


@query("feature_drift_ks", LONG_SQL + """,
g AS (SELECT feature, value, count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE side = 'cur') AS n_cur
      FROM lng WHERE value IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(n_ref) OVER w AS cr, sum(n_cur) OVER w AS cc,
             sum(n_ref) OVER (PARTITION BY feature) AS nr, sum(n_cur) OVER (PARTITION BY feature) AS nc
      FROM g WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT feature, max(abs(cr / nr - cc / nc)) AS ks, max(1.358 * sqrt((nr + nc) / (nr * nc))) AS crit
      FROM c GROUP BY feature)
SELECT feature, round(ks, 6) AS ks_statistic, round(crit, 6) AS critical_value, ks > crit AS drifted FROM k""")
def q_feature_drift_ks(spark, d):
    ref, cur = _drift_sides(spark, d)
    return drift.feature_drift_ks(ref, cur, DRIFT_FEATS)


PSI_SQL = LONG_SQL + """,
l AS (SELECT * FROM lng WHERE value IS NOT NULL),
r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l WHERE side = 'ref' GROUP BY 1),
b AS (SELECT l.feature, l.side,
             CAST(CASE WHEN hi - lo > 0 THEN least(greatest(floor((value - lo) / (hi - lo) * 10), 0), 9) ELSE 0 END
                  AS INTEGER) AS bin
      FROM l JOIN r USING (feature)),
cn AS (SELECT feature, bin, count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE side = 'cur') AS n_cur
       FROM b GROUP BY 1, 2),
t AS (SELECT *, sum(n_ref) OVER (PARTITION BY feature) AS nr, sum(n_cur) OVER (PARTITION BY feature) AS nc FROM cn),
p AS (SELECT feature, greatest(n_ref / nr, 0.0001) AS pr, greatest(n_cur / nc, 0.0001) AS pc FROM t),
s AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM p GROUP BY 1)"""


@query("feature_drift_psi", PSI_SQL + """
SELECT feature, round(psi, 6) AS psi, psi > 0.2 AS drifted FROM s""")
def q_feature_drift_psi(spark, d):
    ref, cur = _drift_sides(spark, d)
    return drift.feature_drift_psi(ref, cur, DRIFT_FEATS)


@query("dataset_drift", PSI_SQL + """
SELECT round(avg(CAST(psi > 0.2 AS INTEGER)), 6) AS drift_share, count(*) AS n_features FROM s""")
def q_dataset_drift(spark, d):
    ref, cur = _drift_sides(spark, d)
    return drift.dataset_drift(drift.feature_drift_psi(ref, cur, DRIFT_FEATS))


CATEGORY_FEATS = ["merchant_category", "location"]


@query("category_drift", f"""WITH {TX},
l AS (SELECT "timestamp" < TIMESTAMP '{SPLIT_TS}' AS old, 'merchant_category' AS feature, merchant_category AS value FROM tx
      UNION ALL SELECT "timestamp" < TIMESTAMP '{SPLIT_TS}', 'location', location FROM tx),
g AS (SELECT feature, value, count(*) FILTER (WHERE old) AS a, count(*) FILTER (WHERE NOT old) AS b FROM l WHERE old IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CAST(sum(a) OVER f AS DOUBLE) AS na, CAST(sum(b) OVER f AS DOUBLE) AS nb, count(*) OVER f AS k FROM g WINDOW f AS (PARTITION BY feature)),
e AS (SELECT *, na * (a + b) / (na + nb) AS ea, nb * (a + b) / (na + nb) AS eb, a / na AS pa, b / nb AS pb FROM t),
s AS (SELECT feature, any_value(k) AS k, any_value(na) AS na, sum((a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb) AS chi2,
             sqrt(greatest(sum(CASE WHEN pa > 0 THEN pa * log2(2 * pa / (pa + pb)) ELSE 0 END
                             + CASE WHEN pb > 0 THEN pb * log2(2 * pb / (pa + pb)) ELSE 0 END) / 2, 0)) AS js FROM e GROUP BY feature),
p AS (SELECT *, CASE WHEN chi2 <= 0 OR k = 1 THEN 1 WHEN chi2 > 2 * k + 500 THEN 0 ELSE greatest(1 - list_sum(list_transform(range(0, 2000),
        lambda n: exp(((k - 1) / 2.0 + n) * ln(chi2 / 2) - chi2 / 2 - lgamma((k - 1) / 2.0 + n + 1)))), 0) END AS p FROM s)
SELECT feature, k AS n_categories, round(chi2, 6) AS chi2, round(p, 6) AS p_value, round(js, 6) AS js_distance,
       CASE WHEN na <= 1000 THEN p < 0.05 ELSE js >= 0.1 END AS drifted FROM p""")
def q_category_drift(spark, d):
    t, cut = views.tx(spark, d), F.to_timestamp_ntz(F.lit(SPLIT_TS))
    return drift.category_drift(t.where(F.col("timestamp") < cut), t.where(F.col("timestamp") >= cut), CATEGORY_FEATS)


# ---------------------------------------------------------------- lifecycle

RUNS_SQL = STORE.replace("WITH", "WITH RECURSIVE", 1) + f""",
wk AS (SELECT date_trunc('week', "timestamp") AS week, {CONF_SQL} FROM pred GROUP BY 1),
wm AS ({metrics_sql('wk', 6, 'week, ')}),
runs AS (SELECT 'fraud-detection-model' AS model, CAST(dense_rank() OVER (ORDER BY week) AS INTEGER) AS version,
                week + INTERVAL 7 DAY AS logged_at, precision, recall, f1_score, sample_count FROM wm),
prod AS (SELECT * FROM runs WHERE version = 1),
cand AS (SELECT * FROM runs WHERE version > 1),
dec AS (
  SELECT c.*, (SELECT max(COALESCE(f1_score, 0.0)) FROM prod) AS prod_f1,
         round(COALESCE(c.f1_score, 0.0) - (SELECT max(COALESCE(f1_score, 0.0)) FROM prod), 6) AS improvement,
         COALESCE(c.f1_score, 0.0) - (SELECT max(COALESCE(f1_score, 0.0)) FROM prod) AS imp
  FROM cand c),
decision AS (
  SELECT * EXCLUDE (imp), imp >= 0.02 AS promote,
         CASE WHEN imp >= 0.02 THEN 'F1 improvement: ' || format('{{:.3f}}', imp) || ' (>0.02)'
              WHEN imp > 0 THEN 'F1 improvement: ' || format('{{:.3f}}', imp) || ' (<0.02 threshold)'
              ELSE 'F1 degradation: ' || format('{{:.3f}}', imp) END AS reason
  FROM dec),
fold AS (
  SELECT model, version, version AS prod_v, COALESCE(f1_score, 0.0) AS prod_f1, true AS up, CAST(NULL AS INTEGER) AS old, logged_at
  FROM runs WHERE version = 1
  UNION ALL
  SELECT model, version, CASE WHEN up THEN version ELSE prod_v END, CASE WHEN up THEN f1 ELSE prod_f1 END, up,
         CASE WHEN up THEN prod_v END, logged_at
  FROM (SELECT r.model, r.version, COALESCE(r.f1_score, 0.0) AS f1, f.prod_v, f.prod_f1, r.logged_at,
               COALESCE(r.f1_score, 0.0) - f.prod_f1 >= 0.02 AS up
        FROM fold f JOIN runs r ON r.model = f.model AND r.version = f.version + 1)),
events AS (
  SELECT model, version, 'None' AS stage, logged_at FROM runs
  UNION ALL SELECT model, version, CASE WHEN up THEN 'Production' ELSE 'Staging' END, logged_at FROM fold
  UNION ALL SELECT model, old, 'Archived', logged_at FROM fold WHERE old IS NOT NULL),
ranked AS (
  SELECT *, CASE stage WHEN 'None' THEN 0 WHEN 'Staging' THEN 1 WHEN 'Archived' THEN 2 ELSE 3 END AS srank
  FROM events),
state AS (
  SELECT model, version, arg_max(stage, (logged_at, srank)) AS stage, max(logged_at) AS since FROM ranked GROUP BY 1, 2)"""


def _registry(spark, d):
    # one row a week: stored once, as every registry query reads it several times
    runs = reliable(lifecycle.weekly_runs(views.predictions(spark, d)))
    dec = lifecycle.promotion(runs.where("version > 1"), runs.where("version = 1"))
    events = lifecycle.run_history(runs)
    return runs, dec, events, lifecycle.stage_state(events)


@query("model_runs", RUNS_SQL + "\nSELECT * FROM runs")
def q_model_runs(spark, d):
    return _registry(spark, d)[0]


@query("promotion", RUNS_SQL + "\nSELECT * FROM decision")
def q_promotion(spark, d):
    return _registry(spark, d)[1]


@query("stage_transition", RUNS_SQL + "\nSELECT * FROM state")
def q_stage_transition(spark, d):
    return _registry(spark, d)[3]


@query("latest_model", RUNS_SQL + """
SELECT model, 'latest' AS stage, max(version) AS version FROM state GROUP BY model
UNION ALL SELECT model, stage, max(version) AS version FROM state GROUP BY model, stage""")
def q_latest_model(spark, d):
    return lifecycle.latest_models(_registry(spark, d)[3])


@query("retrain_due", RUNS_SQL + f"""
SELECT model, version, datediff('day', logged_at, TIMESTAMP '{AS_OF}') AS age_days, precision,
       datediff('day', logged_at, TIMESTAMP '{AS_OF}') >= 7 OR precision < 0.75 AS retrain_due
FROM runs""")
def q_retrain_due(spark, d):
    return lifecycle.retrain_due(_registry(spark, d)[0], AS_OF)


@query("rollback", RUNS_SQL + """,
rb_at AS (SELECT max(logged_at) + INTERVAL 1 DAY AS logged_at FROM events),
back AS (SELECT model, max(version) AS version FROM state WHERE stage = 'Archived' GROUP BY model),
rb AS (
  SELECT b.model, b.version, 'Production' AS stage, (SELECT logged_at FROM rb_at) AS logged_at FROM back b
  UNION ALL
  SELECT s.model, s.version, 'Archived', (SELECT logged_at FROM rb_at) FROM state s
  WHERE s.stage = 'Production' AND s.model IN (SELECT model FROM back)),
ev2 AS (SELECT model, version, stage, logged_at,
               CASE stage WHEN 'None' THEN 0 WHEN 'Staging' THEN 1 WHEN 'Archived' THEN 2 ELSE 3 END AS srank
        FROM (SELECT model, version, stage, logged_at FROM events UNION ALL SELECT * FROM rb))
SELECT model, version, arg_max(stage, (logged_at, srank)) AS stage, max(logged_at) AS since FROM ev2 GROUP BY 1, 2""")
def q_rollback(spark, d):
    _, _, events, state = _registry(spark, d)
    at = events.agg(F.max("logged_at")).scalar() + F.make_dt_interval(days=F.lit(1))
    return lifecycle.stage_state(events.unionByName(lifecycle.rollback(state, at)))
