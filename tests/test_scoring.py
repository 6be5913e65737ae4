"""Scoring rules, alert reason and fallbacks (cases of FIXTURES §2)."""
import pytest
from pyspark.sql import functions as F

from riskflow.functions import exprs as X
from riskflow.operators import features, rules, score

COLS = "amount double, merchant_category string, location string, account_tx_count long, account_avg_amount double"


def _score(spark, rows, raw=None, lo=0.0, hi=1.0, fallback="rules"):
    df = spark.createDataFrame(rows, COLS).withColumn("deviation_from_avg", X.serving_deviation())
    raw = F.lit(None).cast("double") if raw is None else F.lit(raw)
    return [r.asDict() for r in rules.score_with(df, raw, lo, hi, fallback).collect()]


def test_reference_cases(spark):
    out = _score(spark, [(150.0, "Groceries", "Helsinki", 50, 150.0),
                         (8000.0, "Electronics", "Helsinki", 50, 150.0),
                         (100.0, "Gambling", "Turku", 50, 150.0),
                         (1500.0, "Groceries", "Helsinki", 20, 150.0)])
    assert [o["alert_reason"] for o in out] == [None, "High Deviation from Avg", "Suspicious Combo",
                                                "High Deviation from Avg"]
    assert out[1]["deviation_from_avg"] == pytest.approx(52.33, abs=0.01)
    assert out[3]["deviation_from_avg"] == pytest.approx(9.0, abs=1e-3)
    assert [o["is_anomaly"] for o in out] == [0, 1, 1, 1]
    assert [o["status"] for o in out] == [None, "NEW", "NEW", "NEW"]


def test_boundaries(spark):
    out = _score(spark, [(4999.99, "Groceries", "Helsinki", 0, 0.0),
                         (5000.0, "Groceries", "Helsinki", 0, 0.0),
                         (100.0, "gambling", "Turku", 0, 0.0),
                         (8000.0, "Gambling", "Turku", 3, 150.0)])
    assert [o["alert_reason"] for o in out] == [None, "High Value", None, "High Value & Suspicious Combo"]


def test_deviation_and_count_boundaries(spark):
    avg = 100.0
    at5 = avg * 6 + 6e-4      # deviation >= 5.0 given the 1e-6 epsilon
    out = _score(spark, [(at5, "Groceries", "Helsinki", 6, avg),
                         (at5, "Groceries", "Helsinki", 5, avg),
                         (590.0, "Groceries", "Helsinki", 6, avg)])
    assert out[0]["deviation_from_avg"] >= 5.0
    assert [o["alert_reason"] for o in out] == ["High Deviation from Avg", None, None]


def test_ml_threshold_and_priority(spark):
    assert _score(spark, [(10.0, "Groceries", "Helsinki", 0, 0.0)], raw=0.3)[0]["alert_reason"] == "ML Anomaly"
    assert _score(spark, [(10.0, "Groceries", "Helsinki", 0, 0.0)], raw=0.30001)[0]["alert_reason"] is None
    # ML wins over deviation and value
    assert _score(spark, [(8000.0, "Gambling", "Turku", 50, 150.0)], raw=0.0)[0]["alert_reason"] == "ML Anomaly"


def test_unclamped_and_degenerate_scaling(spark):
    assert _score(spark, [(1.0, "A", "B", 0, 0.0)], raw=2.0)[0]["ml_anomaly_score"] == pytest.approx(-1.0)
    assert _score(spark, [(1.0, "A", "B", 0, 0.0)], raw=-1.0)[0]["ml_anomaly_score"] == pytest.approx(2.0)
    assert _score(spark, [(1.0, "A", "B", 0, 0.0)], raw=0.5, lo=0.3, hi=0.3)[0]["ml_anomaly_score"] is None


def test_unknown_account_and_nonpositive_average(spark):
    out = _score(spark, [(100.0, "A", "B", 0, 0.0), (100.0, "A", "B", 4, -10.0)])
    assert [o["deviation_from_avg"] for o in out] == [0.0, 0.0]


def test_fallback_modes(spark):
    rows = [(8000.0, "Gambling", "Turku", 3, 150.0)]
    assert _score(spark, rows, fallback="rules")[0]["alert_reason"] == "High Value & Suspicious Combo"
    z = _score(spark, rows, fallback="zero")[0]
    assert z["alert_reason"] is None and z["ml_anomaly_score"] == 0.0 and z["is_anomaly"] == 0


def test_history_excludes_current_row_and_is_skew_split(spark):
    rows = [("t1", "a", "2024-01-01 00:00:00", 100.0), ("t2", "a", "2024-01-01 00:30:00", 300.0),
            ("t3", "a", "2024-01-01 05:00:00", 200.0), ("t4", "b", "2024-01-01 00:00:00", 50.0)]
    tx = (spark.createDataFrame(rows, "transaction_id string, account_id string, ts string, amount double")
          .withColumn("timestamp", F.to_timestamp_ntz("ts")).drop("ts"))
    h = {r.transaction_id: r for r in features.history_before_row(tx).collect()}
    assert (h["t1"].account_tx_count, h["t1"].account_avg_amount) == (0, 0.0)
    assert (h["t2"].account_tx_count, h["t2"].account_avg_amount) == (1, 100.0)
    assert (h["t3"].account_tx_count, h["t3"].account_avg_amount) == (2, 200.0)   # across hour buckets
    assert h["t4"].account_tx_count == 0


def test_detect_returns_scored_schema(spark):
    from riskflow.schema import SCORED_COLUMNS
    from riskflow.sources import adapters
    s, rej = score.detect(adapters.event_requests(spark, "/root/testdata/sf0.001"))
    assert s.columns == SCORED_COLUMNS
    assert s.count() > 0 and rej.count() > 0
