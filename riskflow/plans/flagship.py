"""The flagship query: stream of requests -> top anomalies with reasons.

requests -> validate (I2/I3) -> first-arrival dedupe (I5) -> history
before each row (W1) -> deviation (E1) -> score (E6) -> rules (R1-R7) ->
top 100 anomalies by score (T1).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.operators import monitor, review, score
from riskflow.plans.registry import query
from riskflow.plans.sqlparts import ARRIVAL_ORDER, DECISIONS, REQ, SCORED_COLS, VALIDATED, scored
from riskflow.schema import SCORED_COLUMNS
from riskflow.session import reliable, scratch_path
from riskflow.sources import adapters, messages
from riskflow.streaming import detector

FLAGSHIP_SQL = f"""WITH {REQ},
{VALIDATED},
{scored('accepted', order=ARRIVAL_ORDER)}
SELECT {SCORED_COLS} FROM scored WHERE is_anomaly = 1
ORDER BY ml_anomaly_score DESC NULLS LAST, transaction_id LIMIT 100"""


@query("flagship_detect", FLAGSHIP_SQL)
def flagship(spark, d):
    scored_rows, _ = score.detect(adapters.event_requests(spark, d))
    return review.top_anomalies(scored_rows, limit=100)


DETECT_SQL = f"""WITH {REQ},
{VALIDATED},
{scored('accepted', order=ARRIVAL_ORDER)}
SELECT {SCORED_COLS} FROM scored"""


@query("detect_all", DETECT_SQL)
def detect_all(spark, d):
    """Every accepted request, scored (the table the detector appends)."""
    scored_rows, _ = score.detect(adapters.event_requests(spark, d))
    return scored_rows


SLICES = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


def _streamed(spark, d) -> detector.Detector:
    """The streaming detector after the whole feed, which arrives in slices of message files,
    each one a micro-batch that continues the stored ids and account totals of those before."""
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex[:12]}")
    job = detector.Detector(spark, f"{root}/out")
    # a message's offset is its arrival; the detector settles those that arrive together, as the batch does
    offset = monitor.epoch_us("arrival_ts") * 2 + F.col("copy")
    for lo, hi in zip([None, *SLICES], [*SLICES, None]):
        part = adapters.event_requests(spark, d, lo, hi)
        messages.envelopes(part, offset, exclude=("arrival_ts", "copy")).write.mode("append").json(f"{root}/topic")
        detector.start(spark, messages.message_stream(spark, "files", f"{root}/topic"), job, f"{root}/checkpoint").awaitTermination()
    return job


@query("stream_detect", DETECT_SQL)
def stream_detect(spark, d):
    """What the streaming detector stores."""
    return _streamed(spark, d).table(detector.SCORED).select(*SCORED_COLUMNS)


@query("stream_totals", f"""WITH {REQ},
{VALIDATED},
{scored('accepted', order=ARRIVAL_ORDER)},
t AS (SELECT (SELECT count(*) FROM req) AS processed, (SELECT count(*) FROM scored WHERE is_anomaly = 1) AS anomalies,
             (SELECT count(*) FROM validated WHERE reject_reason IS NOT NULL) + (SELECT count(*) FROM ranked WHERE arrival_rank > 1) AS errors)
SELECT processed, anomalies, errors, round(anomalies / CAST(processed AS DOUBLE), 6) AS anomaly_ratio,
       round(errors / CAST(processed AS DOUBLE), 6) AS error_ratio FROM t""")
def stream_totals(spark, d):
    """The counters that the streaming detector observed while it wrote."""
    return _streamed(spark, d).totals()


@query("stream_accounts", f"""WITH {REQ},
{VALIDATED}
SELECT account_id, count(*) AS n,
       CAST(sum(CASE WHEN abs(amount) <= {C.MAX_MONEY!r} THEN CAST(round(amount * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS sum_cents
FROM accepted GROUP BY account_id""")
def stream_accounts(spark, d):
    """The account totals that the next batch of the stream would start from."""
    return _streamed(spark, d).state_before(len(SLICES) + 1)


REVIEWED_SQL = f"""WITH {REQ},
{VALIDATED},
{scored('accepted', order=ARRIVAL_ORDER)},
{DECISIONS},
shown AS (
  SELECT s.is_anomaly, s.merchant_category, COALESCE(upper(d.new_status), s.status, 'NEW') AS status
  FROM scored s LEFT JOIN (SELECT * FROM decisions WHERE new_status IS NOT NULL) d ON s.transaction_id = d.transaction_id)"""


def _reviewed_stream(spark, d):
    """The stream's dashboard after two rounds of status updates: travel anomalies are taken up first, then all are decided."""
    job = _streamed(spark, d)
    decided = reliable(score.review_decisions(job.table(detector.SCORED)))
    job.board.update(decided.where("new_status = 'investigated'").withColumn("new_status", F.lit("FRAUD")), 0)
    job.board.update(decided, 1)
    return job.board


@query("live_kpis", REVIEWED_SQL + """
SELECT count(*) AS total_transactions, count(*) FILTER (WHERE is_anomaly = 1) AS total_anomalies,
       round(count(*) FILTER (WHERE is_anomaly = 1) * 100.0 / count(*), 4) AS anomaly_rate_pct FROM shown""")
def live_kpis(spark, d):
    """A8 from the counts that the stream keeps."""
    return _reviewed_stream(spark, d).kpis()


@query("live_by_category", REVIEWED_SQL + """
SELECT merchant_category, count(*) AS count FROM shown WHERE is_anomaly = 1 AND status <> 'DISMISSED' GROUP BY 1""")
def live_by_category(spark, d):
    """A9 from the counts, as moved by the status updates."""
    return _reviewed_stream(spark, d).by_category()


@query("live_by_status", REVIEWED_SQL + """
SELECT status, count(*) AS count FROM shown WHERE is_anomaly = 1 GROUP BY 1""")
def live_by_status(spark, d):
    """A10 from the counts, as moved by the status updates."""
    return _reviewed_stream(spark, d).by_status()
