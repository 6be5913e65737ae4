"""Physical-plan properties: shuffles, top-k, pushdown, pruning, broadcasts."""
import pytest
from pyspark.sql import functions as F

from riskflow.operators import features, retention, review
from riskflow.plans import views
from riskflow.sources import adapters

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_shuffles_big_side_on_account_and_bucket(spark):
    p = plan(features.history_before_row(views.tx(spark, SF)))
    assert "hashpartitioning(account_id" in p and "_b#" in p
    assert "Window" in p


def test_top_anomalies_is_take_ordered(spark):
    p = spark.sparkContext  # noqa: F841
    df = review.top_anomalies(views.scored(spark, SF), limit=100)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().sparkPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    df = views.tx(spark, SF).where(F.col("timestamp") >= F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")))
    p = plan(df.select("transaction_id", "amount"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p
    agg = plan(features.account_aggregates(views.tx(spark, SF)))
    assert "ReadSchema: struct<user_id:bigint,value:double>" in agg


def test_fixed_dimension_is_broadcast(spark):
    p = plan(adapters.orders_transactions(spark, SF))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_whole_account_features_use_aggregate_not_unbounded_window(spark):
    p = plan(features.account_features(views.tx(spark, SF)))
    assert "ExistingRDD" in p and "Window" not in p      # the aggregate is stored, then joined


@pytest.mark.parametrize("name", ["account_features", "legal_hold", "erasure"])
def test_joins_on_a_hot_account_are_split(spark, name):
    """Half of the rows on one account, broadcasts off: AQE splits the join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        tx = spark.range(0, 40000, 1, 8).select(
            F.concat(F.lit("T"), "id").alias("transaction_id"), F.when(F.col("id") % 2 == 0, F.lit("A")).otherwise(F.concat(F.lit("B"), F.col("id") % 977)).alias("account_id"),
            F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")).alias("timestamp"), (F.col("id") % 97 + 0.5).alias("amount"))
        ids = tx.select("account_id").where("account_id = 'A' OR account_id < 'B3'")
        df = {"account_features": lambda: features.account_features(tx),
              "legal_hold": lambda: retention.purge_keep(tx, "2024-01-01 00:00:00", 10, ids), "erasure": lambda: retention.erase(tx, ids)}[name]()
        df.write.format("noop").mode("overwrite").save()
        rows = df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
        assert rows
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_partitioned_layout_prunes(spark, tmp_dir):
    from riskflow.sources.tables import write_partitioned
    write_partitioned(adapters.orders_transactions(spark, SF), tmp_dir + "/tx")
    df = spark.read.parquet(tmp_dir + "/tx").where("year = 1998 AND month = 3")
    p = plan(df)
    assert "PartitionFilters: [isnotnull(year" in p
    assert df.count() == adapters.orders_transactions(spark, SF).where(
        (F.year("timestamp") == 1998) & (F.month("timestamp") == 3)).count()
