"""Validation, dedupe, corrupt records, charges (FIXTURES §3, §4)."""
import json

from pyspark.sql import functions as F

from riskflow.operators import ingest
from riskflow.schema import CHARGE, REQUEST
from riskflow.sources import charges

BASE = {"transaction_id": "T1", "account_id": "A1", "amount": "10", "merchant_category": "Groceries",
        "location": "Helsinki", "timestamp": "2024-01-01 00:00:00", "is_fraud": 0}


def _reasons(spark, reqs):
    df = spark.createDataFrame([tuple(r.get(f.name) for f in REQUEST.fields) for r in reqs], REQUEST)
    return [r.reject_reason for r in ingest.validate(df).collect()]


def test_missing_fields_in_order(spark):
    reqs = []
    for f in ["transaction_id", "account_id", "amount", "merchant_category", "location", "timestamp"]:
        r = dict(BASE)
        r[f] = None
        reqs.append(r)
    both = dict(BASE, account_id=None, location=None)
    out = _reasons(spark, reqs + [both])
    assert out[:6] == [f"Missing required field: {f}" for f in
                       ["transaction_id", "account_id", "amount", "merchant_category", "location", "timestamp"]]
    assert out[6] == "Missing required field: account_id"


def test_amount_checks(spark):
    out = _reasons(spark, [dict(BASE, amount="0"), dict(BASE, amount="-5"), dict(BASE, amount="abc"),
                           dict(BASE, amount="12.5"), dict(BASE, amount="NaN"), dict(BASE, amount="Infinity"),
                           dict(BASE, is_fraud=None)])
    assert out == ["Invalid amount: 0.0 (must be positive)", "Invalid amount: -5.0 (must be positive)",
                   "Invalid amount format: abc", None, None, None, "Missing required field: is_fraud"]


def test_first_arrival_wins(spark):
    rows = [("T1", 1, "10"), ("T1", 2, "20"), ("T2", 3, "30")]
    df = (spark.createDataFrame(rows, "transaction_id string, offset long, amount string")
          .withColumn("account_id", F.lit("A")).withColumn("merchant_category", F.lit("X"))
          .withColumn("location", F.lit("Y")).withColumn("timestamp", F.lit("2024-01-01 00:00:00"))
          .withColumn("is_fraud", F.lit(0)))
    acc, rej = ingest.split_requests(df, order=("offset",), keep=("offset",))
    got = {r.transaction_id: r.amount for r in acc.collect()}
    assert got == {"T1": 10.0, "T2": 30.0}
    assert [(r.transaction_id, r.reject_reason, r.offset) for r in rej.collect()] == [
        ("T1", "Duplicate transaction_id", 2)]


def test_corrupt_record_is_rejected_not_fatal(spark):
    from riskflow.streaming.detector import _parse_messages
    msgs = spark.createDataFrame([(1, json.dumps(BASE)), (2, "{bad")], "offset long, value string")
    out = {r.offset: (r._corrupt, r.raw) for r in _parse_messages(msgs, ("offset",)).collect()}
    assert out == {1: (False, json.dumps(BASE)), 2: (True, "{bad")}


def test_no_input_ends_the_job(spark):
    """Numbers and times that a cast would read or choke on."""
    cases = [("12d", "2024-01-01 00:00:00"), ("0x10p0", "2024-01-01 00:00:00"), ("1e300", "2024-01-01 00:00:00"), ("NaN", "2024-01-01 00:00:00"),
             ("Infinity", "2024-01-01 00:00:00"), ("7", "12:30:00"), ("8", "2024-01-01T10:00:00+02:00"), ("9", "2024-01-01"), (" 1.5e1 ", "2024-01-01 00:00:00")]
    df = spark.createDataFrame([(f"T{i}", "A", a, "X", "Y", t, 0, i) for i, (a, t) in enumerate(cases)],
                               "transaction_id string, account_id string, amount string, merchant_category string, location string, timestamp string, is_fraud int, offset long")
    from riskflow.operators import score
    scored, rej = score.detect(df.withColumnRenamed("offset", "copy").withColumn("arrival_ts", F.lit(1)))
    got = {r.transaction_id: str(r.timestamp) for r in scored.collect()}
    assert got == {"T2": "2024-01-01 00:00:00", "T3": "2024-01-01 00:00:00", "T4": "2024-01-01 00:00:00", "T6": "2024-01-01 08:00:00", "T7": "2024-01-01 00:00:00", "T8": "2024-01-01 00:00:00"}
    assert {r.transaction_id: r.reject_reason for r in rej.collect()} == {
        "T0": "Invalid amount format: 12d", "T1": "Invalid amount format: 0x10p0", "T5": "Invalid timestamp format: 12:30:00"}


def test_tied_duplicates_are_all_rejected(spark):
    df = spark.createDataFrame([("T1", 1, "10")] * 3 + [("T1", 1, "11"), ("T2", 5, "1")], "transaction_id string, offset long, amount string")
    assert sorted((r.transaction_id, r.amount) for r in ingest.duplicates(df, order=("offset",)).collect()) == [("T1", "10"), ("T1", "10"), ("T1", "11")]
    assert sorted((r.transaction_id, r.amount) for r in ingest.dedupe_first(df, order=("offset",)).collect()) == [("T1", "10"), ("T2", "1")]


def test_clean_location_and_schema_evolve(spark):
    df = spark.createDataFrame([(" Oulu\n ",)], "location string")
    assert ingest.clean_location(df).first().location == "Oulu"
    from riskflow.schema import SCORED_COLUMNS
    ev = ingest.schema_evolve(spark.createDataFrame([("T", "A")], "transaction_id string, account_id string"))
    assert ev.columns[:len(SCORED_COLUMNS)] == SCORED_COLUMNS


def test_charge_cases(spark):
    raw = [
        {"id": "ch_city0001", "customer": "cus_1", "created": 1704067200, "amount": 2000,
         "billing_details": {"address": {"city": "Oulu", "country": "FI"}},
         "metadata": {"category": "gas_station"}, "outcome": {"risk_score": 12, "risk_level": "normal"},
         "payment_method_details": {"type": "card"}},
        {"id": "ch_ctry0002", "customer": None, "created": 1704067200, "amount": 150,
         "billing_details": {"address": {"city": "", "country": "FI"}}, "metadata": {"category": "toys"}},
        {"id": "ch_none0003", "customer": "", "created": 1704067200, "amount": 100,
         "description": "Hotel and Restaurant"},
        {"id": "ch_desc0004", "customer": "cus_4", "created": 1704067200, "amount": 100,
         "billing_details": {"address": {}}, "description": "nothing matches"},
    ]
    df = spark.read.schema(CHARGE).json(spark.sparkContext.parallelize([json.dumps(r) for r in raw]))
    out = [r.asDict() for r in charges.flatten_charges(df).orderBy("transaction_id").collect()]
    by = {o["transaction_id"]: o for o in out}
    a = by["STRIPE_ch_city0001"]
    assert (a["location"], a["merchant_category"], a["amount"], a["account_id"]) == ("Oulu", "Gas", 20.0, "cus_1")
    assert a["stripe_risk_score"] == 12 and a["payment_method"] == "card"
    b = by["STRIPE_ch_ctry0002"]
    assert (b["location"], b["merchant_category"], b["account_id"]) == ("FI", "toys", "GUEST_ch_ctry0")
    c = by["STRIPE_ch_none0003"]
    assert (c["location"], c["merchant_category"], c["account_id"]) == ("Unknown", "Food", "GUEST_ch_none0")
    assert c["stripe_risk_score"] is None and c["stripe_risk_level"] is None
    d = by["STRIPE_ch_desc0004"]
    assert (d["location"], d["merchant_category"]) == ("Unknown", "Unknown")
    assert str(a["timestamp"]) == "2024-01-01 00:00:00"
