"""Canonical schemas (Spark DDL) of the transaction-risk data model."""

from pyspark.sql import types as T

TRANSACTION = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("account_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("is_fraud", T.IntegerType()),
])

SCORED_EXTRA = [
    T.StructField("ml_anomaly_score", T.DoubleType()),
    T.StructField("alert_reason", T.StringType()),
    T.StructField("is_anomaly", T.IntegerType()),
    T.StructField("status", T.StringType()),
]
SCORED = T.StructType(TRANSACTION.fields + SCORED_EXTRA)
SCORED_COLUMNS = [f.name for f in SCORED.fields]
TRANSACTION_COLUMNS = [f.name for f in TRANSACTION.fields]

ARCHIVE = T.StructType(SCORED.fields + [T.StructField("archived_at", T.TimestampNTZType())])

# A request as it arrives on the message stream: every field is text
# (or absent); validation decides what survives.
REQUEST = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("is_fraud", T.IntegerType()),
])

REJECT = T.StructType([
    T.StructField("raw", T.StringType()),
    T.StructField("reject_reason", T.StringType()),
    T.StructField("rejected_at", T.TimestampNTZType()),
])

CHARGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("customer", T.StringType()),
    T.StructField("created", T.LongType()),
    T.StructField("amount", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("billing_details", T.StructType([
        T.StructField("address", T.StructType([
            T.StructField("city", T.StringType()),
            T.StructField("country", T.StringType()),
        ])),
    ])),
    T.StructField("outcome", T.StructType([
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("risk_level", T.StringType()),
    ])),
    T.StructField("payment_method_details", T.StructType([
        T.StructField("type", T.StringType()),
    ])),
])

OUTBOX = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("payload", T.StringType()),
])

MODEL_EVENT = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("stage", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("at", T.TimestampNTZType()),
])

ALERT_RULE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("window_s", T.IntegerType()),
    T.StructField("op", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("for_s", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("interval_s", T.IntegerType()),
])
