"""Payload golden JSON, entry contract, seed load, display helpers, oracle subset."""
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskflow.operators import alerts, review
from riskflow.schema import SCORED_COLUMNS
from tools.oracle_check import canon

SF = "/root/testdata/sf0.001"


def test_slack_payload_golden(spark):
    row = [("TRX_1", "ACC_1", "2024-01-01 10:00:00", 9500.0, "Gambling", "Turku", 0, 0.95, "ML Anomaly", 1, "NEW")]
    df = spark.createDataFrame(row, "transaction_id string, account_id string, ts string, amount double, "
                                    "merchant_category string, location string, is_fraud int, ml_anomaly_score double, "
                                    "alert_reason string, is_anomaly int, status string") \
        .withColumn("timestamp", F.to_timestamp_ntz("ts")).drop("ts")
    box = {r.channel: r for r in alerts.outbox(df, enabled=["slack", "teams", "email", "webhook", "discord"],
                                                sent_at=F.to_timestamp_ntz(F.lit("2024-01-01 10:00:05"))).collect()}
    assert set(box) == {"slack", "discord", "teams", "email", "webhook"}
    slack = json.loads(box["slack"].payload)
    assert slack["text"] == "\U0001F6A8 *Fraud Alert - CRITICAL*"
    att = slack["attachments"][0]
    assert att["color"] == "#FF0000" and att["footer"] == "Fraud Detection System"
    fields = {f["title"]: (f["value"], f["short"]) for f in att["fields"]}
    assert fields["Anomaly Score"] == ("95.00%", True)
    assert fields["Amount"] == ("€9500.00", True)
    assert fields["Timestamp"][1] is False
    assert att["ts"] == 1704103205
    email = json.loads(box["email"].payload)
    assert email["subject"] == "\U0001F6A8 Fraud Alert - CRITICAL: €9500.00"
    assert "Please investigate immediately." in email["body"]
    assert json.loads(box["teams"].payload)["themeColor"] == "attention"
    assert json.loads(box["discord"].payload)["embeds"][0]["color"] == 16711680
    hook = json.loads(box["webhook"].payload)
    assert hook["severity"] == "critical" and len(hook["transaction"]) == 11
    assert hook["transaction"]["timestamp"][10] == "T" and hook["timestamp"][10] == "T"


def test_outbox_skips_below_high(spark):
    df = spark.createDataFrame([("T", 0.7, 10.0, 1)], "transaction_id string, ml_anomaly_score double, amount double, "
                                                       "is_anomaly int") \
        .withColumn("timestamp", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    assert alerts.fan_out(alerts.with_severity(df), ["slack"]).count() == 0


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns == SCORED_COLUMNS
    assert 0 < df.count() <= 100
    assert set(E.oracle_sql()) <= set(E.queries())


def test_page_argument_checks():
    for bad in [dict(limit=0), dict(limit=1001), dict(offset=-1), dict(min_score=1.5), dict(status="fraud")]:
        with pytest.raises(ValueError):
            review.check_page_args(**bad)
    review.check_page_args(limit=1000, offset=0, min_score=0.0, status="FRAUD")
    assert review.display_columns(["alert_reason", "ml_anomaly_score"]) == ["Alert Reason", "Ml Anomaly Score"]


def test_seed_load_is_idempotent(spark, tmp_dir):
    from riskflow.plans import views
    from riskflow.sources.tables import seed_load
    csv = os.path.join(tmp_dir, "seed.csv")
    views.tx(spark, SF).toPandas().to_csv(csv, index=False)
    table = os.path.join(tmp_dir, "transactions")
    assert seed_load(spark, csv, table) == "created"
    assert seed_load(spark, csv, table) == "skipped"
    assert spark.read.parquet(table).count() == views.tx(spark, SF).count()


ORACLE_SUBSET = ["flagship_detect", "rejects", "history_before_row", "class_metrics", "roc_auc", "tier_stats",
                 "rate_5m", "alert_intervals", "charge_category", "mini_forest", "promotion", "feature_drift_ks"]


@pytest.mark.parametrize("name", ORACLE_SUBSET)
def test_oracle_subset(spark, name):
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "orders", "events", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = canon(E.queries()[name](spark, SF).toPandas())
    want = canon(con.execute(E.oracle_sql()[name]).df())
    assert got == want
