"""Property tests: tiers are total and disjoint, confusion cells sum to n,
history follows arrival order."""
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskflow.operators import evaluate, features
from riskflow.operators import retention as R

AS_OF = "2024-06-30 00:00:00"
BASE = datetime(2024, 6, 30)

offsets = st.lists(st.integers(min_value=0, max_value=3000 * 86400), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(offsets)
def test_tiers_total_and_disjoint(spark, secs):
    rows = [(f"T{i}", BASE - timedelta(seconds=s)) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp_ntz")
    s = R.tier_stats(df, AS_OF).first()
    assert s.hot_storage_count + s.warm_storage_count + s.cold_storage_count + s.purge_eligible_count == len(rows)
    tiers = df.select(R.tier_of(AS_OF).alias("t")).collect()
    assert all(t.t in ("hot", "warm", "cold", "purge") for t in tiers)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), max_size=60))
def test_confusion_cells_sum_to_n(spark, pairs):
    df = spark.createDataFrame(pairs or [(0, 0)], "actual_label int, predicted_label int")
    if not pairs:
        df = df.where("false")
    m = evaluate.class_metrics(df).first()
    assert m.tp + m.fp + m.fn + m.tn == m.sample_count == len(pairs)
    assert 0.0 <= m.precision <= 1.0 and 0.0 <= m.recall <= 1.0 and 0.0 <= m.f1_score <= 1.0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5 * 86400), st.integers(1, 100000)),
                min_size=1, max_size=50), st.randoms(use_true_random=False), st.integers(1, 7))
def test_history_in_arrival_order(spark, rows, rnd, parts):
    """Arrival order decides, whatever the event times and the number of partitions are;
    stored history of an earlier batch continues it."""
    arrival = list(range(len(rows)))
    rnd.shuffle(arrival)
    data = [(f"T{i:04d}", f"A{a}", BASE + timedelta(seconds=s), c / 100.0, k) for i, ((a, s, c), k) in enumerate(zip(rows, arrival))]
    schema = "transaction_id string, account_id string, timestamp timestamp_ntz, amount double, offset long"
    tx = spark.createDataFrame(data, schema)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r[0]: r for r in features.history_before_row(tx, order=("offset",)).select("transaction_id", "account_tx_count", "account_avg_amount").collect()}
        cut = rnd.randint(0, len(rows))
        first, second = tx.where(F.col("offset") < cut), tx.where(F.col("offset") >= cut)
        base = first.groupBy("account_id").agg(F.count("*").alias("base_n"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("base_sum_cents"))
        split = {r[0]: r for df, b in ((first, None), (second, base)) for r in
                 features.history_before_row(df, order=("offset",), base=b).select("transaction_id", "account_tx_count", "account_avg_amount").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == split
    for tid, acc, _, _, k in data:
        prev = [x for x in data if x[1] == acc and x[4] < k]
        assert got[tid][1] == len(prev)
        if prev:
            cents = sum(round(x[3] * 100) for x in prev)
            assert abs(got[tid][2] - cents / (len(prev) * 100.0)) < 1e-9
