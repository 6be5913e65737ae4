"""Per-account behavioural features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.functions import exprs as X
from riskflow.session import reliable, stored


def account_aggregates(tx: DataFrame, key: str = "account_id") -> DataFrame:
    """A1: per-account (count, average amount); partial aggregation map-side."""
    return (tx.groupBy(key)
              .agg(F.count(F.lit(1)).alias("account_tx_count"),
                   F.sum(X.cents()).alias("_s"))
              .select(key, "account_tx_count",
                      (F.col("_s") / (F.col("account_tx_count") * 100.0)).alias("account_avg_amount")))


def batch_history(batch: DataFrame, history: DataFrame, key: str = "account_id") -> DataFrame:
    """Aggregates for only the accounts present in the batch. The history is
    pre-aggregated before its shuffle, so that a hot account is one row a task; the semi
    join then sees one row an account."""
    return account_aggregates(history, key).join(batch.select(key).distinct(), key, "left_semi")


def history_before_row(tx: DataFrame, key: str = "account_id",
                       order: tuple[str, ...] = ("timestamp", "transaction_id"),
                       with_deviation: bool = True,
                       base: DataFrame | None = None) -> DataFrame:
    """Count and average of the account's *earlier* rows (current excluded).

    ``order`` says which rows are earlier: the arrival columns where rows arrive
    out of event order. Equivalent to ``count/avg OVER (PARTITION BY key ORDER BY
    order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)``, but no account lands
    whole in one task:

    1. the rows are range-partitioned on (key, order) and written to the shared
       folder, so a hot account lies in as many partitions as its rows fill;
    2. totals per (key, partition) -- one row a partition at most -- get exclusive
       prefix sums per key;
    3. a running window inside each (key, partition) adds the prefix.

    Sums are integer cents, so the result does not depend on plan order.
    ``base`` (key, base_n, base_sum_cents) is history stored before these
    rows (the streaming account state); it is added to every prefix.
    """
    t = stored(tx.withColumn("_c", X.cents()).repartitionByRange(key, *order)
                 .withColumn("_b", F.spark_partition_id()), "history")
    chunks = t.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_cc"), F.sum("_c").alias("_cs"))
    wk = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = chunks.select(key, "_b",
                           F.coalesce(F.sum("_cc").over(wk), F.lit(0)).alias("_pc"),
                           F.coalesce(F.sum("_cs").over(wk), F.lit(0)).alias("_ps"))
    if base is not None:
        prefix = (prefix.join(base, key, "left")
                        .withColumn("_pc", F.col("_pc") + F.coalesce(F.col("base_n"), F.lit(0)))
                        .withColumn("_ps", F.col("_ps") + F.coalesce(F.col("base_sum_cents"), F.lit(0)))
                        .drop("base_n", "base_sum_cents"))

    wl = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = (t.join(prefix, [key, "_b"], "left")
            .withColumn("account_tx_count",
                        (F.count(F.lit(1)).over(wl) + F.col("_pc")).cast("long"))
            .withColumn("_sum", F.coalesce(F.sum("_c").over(wl), F.lit(0)) + F.col("_ps"))
            .withColumn("account_avg_amount",
                        F.when(F.col("account_tx_count") > 0,
                               F.col("_sum") / (F.col("account_tx_count") * 100.0))
                         .otherwise(F.lit(0.0)))
            .drop("_b", "_c", "_pc", "_ps", "_sum"))
    if with_deviation:
        out = out.withColumn("deviation_from_avg", X.serving_deviation())
    return out


def account_features(tx: DataFrame, key: str = "account_id") -> DataFrame:
    """W2 + E2 + E3: whole-account mean / count / max broadcast back to rows
    (current row included), training deviation and amount-to-max ratio.

    Written as grouped aggregate + join-back instead of an unbounded window
    so that a hot account is pre-aggregated, never buffered in one task. The
    aggregate is checkpointed: a join side that is an aggregate right above its
    exchange cannot be split, a stored one is shuffled anew and AQE splits the join.
    """
    aggs = reliable(tx.groupBy(key)
              .agg(F.sum(X.cents()).alias("_s"),
                   F.count("amount").alias("account_tx_count"),
                   F.max("amount").alias("account_max_amount"))
              .withColumn("account_avg_amount",
                          F.try_divide(F.col("_s"), F.col("account_tx_count") * 100.0))
              .drop("_s"))
    return (tx.join(aggs, key, "left")
              .withColumn("deviation_from_avg", X.training_deviation())
              .withColumn("amount_to_max_ratio", X.amount_to_max_ratio()))


def time_features(tx: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour, day_of_week (Mon=0), is_weekend, is_night (>=22 or <=6)."""
    h = F.hour(ts)
    d = X.weekday_mon0(ts)
    return (tx.withColumn("hour", h)
              .withColumn("day_of_week", d)
              .withColumn("is_weekend", (d >= 5).cast("int"))
              .withColumn("is_night", ((h >= 22) | (h <= 6)).cast("int")))


def feature_matrix(tx: DataFrame, features: list[str] = C.TRAIN_FEATURES_9,
                   keep: tuple[str, ...] = ("transaction_id", "is_fraud")) -> DataFrame:
    """E5: the 9 training features, NULL -> 0."""
    df = time_features(account_features(tx))
    out = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    return out.na.fill(0.0, subset=list(features))


def stratified_split(df: DataFrame, label: str = "is_fraud", key: str = "transaction_id",
                     test_fraction: float = 0.2, seed: int = C.FOREST_SEED,
                     bucket_digits: int = 4) -> DataFrame:
    """M3: deterministic stratified split, exact per-class test share.

    Each row's rank in hash order *within its class* decides: the first
    round(n_class * test_fraction) rows of a class go to test. The rank is
    computed with a two-level count (per class and hash bucket, then within
    the bucket), so a large class is never sorted in a single task.
    """
    # md5 hex text orders like the 128-bit number; its first two digits
    # hex digits give 16**bucket_digits buckets (portable: any SQL engine
    # computes the same md5)
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    t = df.withColumn("_h", h).withColumn("_hb", F.substring(F.col("_h"), 1, bucket_digits))
    per_bucket = t.groupBy(label, "_hb").agg(F.count(F.lit(1)).alias("_nb"))
    wb = Window.partitionBy(label).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(label)
    per_bucket = per_bucket.select(label, "_hb",
                                   F.coalesce(F.sum("_nb").over(wb), F.lit(0)).alias("_before"),
                                   F.sum("_nb").over(wt).alias("_n"))
    wr = Window.partitionBy(label, "_hb").orderBy("_h", key)
    out = (t.join(per_bucket, [label, "_hb"], "left")
            .withColumn("_rank", F.row_number().over(wr) + F.col("_before"))
            .withColumn("split", F.when(F.col("_rank") <= F.round(F.col("_n") * test_fraction), F.lit("test"))
                                  .otherwise(F.lit("train")))
            .drop("_h", "_hb", "_before", "_n", "_rank"))
    return out
