"""Adapters: driver tables -> the transaction-risk data model.

The driver provides a TPC-H-like star schema plus an ``events`` stream;
these functions derive the transaction, request, and request-log views
every operator works on. All derivations are column expressions (one
narrow stage, no shuffle) except the orders view, which joins the
customer and nation dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.constants import LOCATIONS, MERCHANT_CATEGORIES
from riskflow.session import ts_lit
from riskflow.sources.tables import read_table

EVENTS_FROM = "2024-01-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"


def _pick(values: list[str], index: Column) -> Column:
    """values[index] for a non-negative integer index (NULL stays NULL)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def props_k(col: str = "props") -> Column:
    return F.get_json_object(F.col(col), "$.k").cast("bigint")


def events_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> TRANSACTION (one row per event)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return ev.select(
        F.format_string("TRX_%07d", "event_id").alias("transaction_id"),
        F.format_string("ACC_%04d", "user_id").alias("account_id"),
        F.col("ts").alias("timestamp"),
        F.round(F.col("value") * 20, 2).alias("amount"),
        _pick(MERCHANT_CATEGORIES, F.pmod(F.col("event_id"), F.lit(11))).alias("merchant_category"),
        _pick(LOCATIONS, F.pmod(props_k(), F.lit(6))).alias("location"),
        F.when((F.col("event_type") == "error") & (F.col("value") >= 100), 1)
         .otherwise(0).cast("int").alias("is_fraud"),
    )


def event_requests(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """events -> raw request stream (text fields, as received from a topic).

    Defects are injected from the ``props.k`` value carried by each event:
    k=0 drops the account, k=1 negates the amount, k=2 sends a non-numeric
    amount, k=3 drops the category, k=4 sends a zero amount, k=6 a suffixed
    number, k=7 a time without a date, k=8 a local time with its offset (which
    makes event order differ from arrival order), k=9 a number beyond any money,
    k=10 NaN. Events with k=5 are re-sent an hour later with a doubled amount (a
    replay, which dedupe must reject: first arrival wins); those with k=11 arrive
    twice at once, alike in everything. ``arrival_ts``/``copy`` give the arrival order.
    With ``since`` (included) and ``until`` only what arrives between them.
    """
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    # a request arrives at its event's time or an hour later: other events are not derived at all
    if since:
        ev = ev.where(F.col("ts") >= ts_lit(since) - F.make_dt_interval(hours=F.lit(1)))
    if until:
        ev = ev.where(F.col("ts") < ts_lit(until))
    # read from the text once a row, as every defect asks for it
    ev = ev.withColumn("k", props_k()).drop("props")
    k = F.col("k")
    # one scan: a replayed event explodes into its two copies
    ev = ev.withColumn("copy", F.explode(F.when(k == 5, F.array(F.lit(0), F.lit(1)))
                                         .when(k == 11, F.array(F.lit(0), F.lit(0)))
                                         .otherwise(F.array(F.lit(0)))))
    arrival = F.col("ts") + F.make_dt_interval(hours=F.col("copy"))
    if since:
        ev = ev.where(arrival >= ts_lit(since))
    if until:
        ev = ev.where(arrival < ts_lit(until))
    amount = F.round(F.col("value") * 20, 2) * (F.col("copy") + 1)
    return ev.select(
        F.format_string("TRX_%07d", "event_id").alias("transaction_id"),
        F.when(k == 0, F.lit(None).cast("string"))
         .otherwise(F.format_string("ACC_%04d", "user_id")).alias("account_id"),
        F.when(k == 2, F.lit("n/a"))
         .when(k == 1, F.concat(F.lit("-"), amount.cast("string")))
         .when(k == 4, F.lit("0"))
         .when(k == 6, F.lit("12d"))
         .when(k == 9, F.lit("1e300"))
         .when(k == 10, F.lit("NaN"))
         .otherwise(amount.cast("string")).alias("amount"),
        F.when(k == 3, F.lit(None).cast("string"))
         .otherwise(_pick(MERCHANT_CATEGORIES, F.pmod(F.col("event_id"), F.lit(11)))).alias("merchant_category"),
        _pick(LOCATIONS, F.pmod(k, F.lit(6))).alias("location"),
        F.when(k == 7, F.lit("12:30:00"))
         .when(k == 8, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:00")))
         .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.when((F.col("event_type") == "error") & (F.col("value") >= 100), 1)
         .otherwise(0).cast("int").alias("is_fraud"),
        arrival.alias("arrival_ts"),
        F.col("copy"),
    )


def orders_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation -> TRANSACTION (the long, multi-year history).

    nation is a fixed 25-row dimension, so broadcasting it is size-safe;
    the customer join is left to AQE (broadcast only if measured small).
    """
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                         "o_orderdate", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    j = (orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
               .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    return j.select(
        F.format_string("ORD_%08d", "o_orderkey").alias("transaction_id"),
        F.format_string("ACC_%06d", "o_custkey").alias("account_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.round("o_totalprice", 2).alias("amount"),
        _pick(MERCHANT_CATEGORIES, F.pmod(F.col("o_orderkey"), F.lit(11))).alias("merchant_category"),
        F.coalesce(F.col("n_name"), F.lit("Unknown")).alias("location"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), 1)
         .otherwise(0).cast("int").alias("is_fraud"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> HTTP-style request log for the API monitoring queries.

    endpoint = event type, status 500 for error events else 200,
    duration in seconds = value / 100.
    """
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type", "value"])
    return ev.select(
        F.col("ts"),
        F.concat(F.lit("/api/v1/"), F.col("event_type")).alias("endpoint"),
        F.when(F.col("event_type") == "purchase", F.lit("PUT")).otherwise(F.lit("GET")).alias("method"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"),
        (F.col("value") / 100.0).alias("duration_s"),
    )


def cache_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> cache counters as a cache reports them: per read one hit or one miss
    (k < 75 is a read that the cache answered)."""
    ev = read_table(spark, sf_dir, "events", ["event_type", "props"])
    hit = props_k() < 75
    return ev.select(F.concat(F.lit("/api/v1/"), F.col("event_type")).alias("endpoint"),
                     hit.cast("long").alias("hits"), (~hit).cast("long").alias("misses"))
