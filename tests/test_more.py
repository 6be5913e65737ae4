"""Model loading, dead letters, live metrics, CSV replay."""
import json
import os

import pytest
from pyspark.sql import functions as F

from riskflow.operators import ingest, lifecycle
from riskflow.schema import TRANSACTION
from riskflow.sources import messages
from riskflow.streaming import detector as S


def test_load_model(spark):
    state = spark.createDataFrame([("m", 1, "Archived"), ("m", 2, "Production"), ("m", 3, "Staging")],
                                  "model string, version int, stage string")
    runs = spark.createDataFrame([("m", 1, -0.2, 0.1), ("m", 2, -0.3, 0.2), ("m", 3, None, None), ("other", 2, -9.0, 9.0)],
                                 "model string, version int, min_decision_score double, max_decision_score double")
    assert lifecycle.load_model(state, runs, "m") == {"version": 2, "min_score": -0.3, "max_score": 0.2}
    with pytest.raises(lifecycle.ModelNotReady):
        lifecycle.load_model(state, runs, "m", stage=None)          # latest (v3) has no bounds
    with pytest.raises(lifecycle.ModelNotReady):
        lifecycle.load_model(state.where("stage <> 'Production'"), runs, "m")


def test_dead_letter(spark):
    rej = spark.createDataFrame([("T1", "Invalid amount format: x")], "transaction_id string, reject_reason string")
    out = ingest.dead_letter(rej, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).first().value
    d = json.loads(out)
    assert d["error"] == "Invalid amount format: x" and json.loads(d["transaction"]) == {"transaction_id": "T1"}
    assert d["timestamp"].startswith("2024-01-01T00:00:00")


def test_live_metrics_stream(spark, tmp_dir):
    src = os.path.join(tmp_dir, "ev")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as fh:
        for i in range(20):
            fh.write(json.dumps({"ts": f"2024-01-01 00:0{i // 10}:{(i % 10) * 5:02d}", "processed": 1,
                                 "anomaly": int(i % 5 == 0), "error": 0}) + "\n")
    ev = (spark.readStream.schema("ts timestamp, processed int, anomaly int, error int").json(src))
    q = (S.live_metrics(ev).writeStream.outputMode("update").format("memory").queryName("live_m")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM live_m").collect()
    assert rows and max(r.processed for r in rows) == 20 and max(r.anomalies for r in rows) == 4


def test_csv_replay_to_topic(spark, tmp_dir):
    csv_dir = os.path.join(tmp_dir, "csv")
    os.makedirs(csv_dir)
    with open(os.path.join(csv_dir, "t.csv"), "w") as fh:
        fh.write("transaction_id,account_id,timestamp,amount,merchant_category,location,is_fraud\n")
        fh.write("TRX_1,ACC_1,2024-01-01 00:00:00,10.5,Groceries,Oulu,0\n")
    q = messages.replay_csv_to_topic(spark, csv_dir, TRANSACTION, os.path.join(tmp_dir, "topic"),
                                     os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    line = spark.read.text(os.path.join(tmp_dir, "topic")).first().value
    assert json.loads(line)["transaction_id"] == "TRX_1" and json.loads(line)["amount"] == 10.5


def test_stored_model_is_served(spark, tmp_dir):
    from riskflow.operators import forest
    from riskflow.streaming.detector import Detector
    nodes = spark.createDataFrame(forest.mini_forest_nodes(), forest.NODE_SCHEMA)
    feats = ["amount", "account_avg_amount", "deviation_from_avg"]
    forest.save(nodes, tmp_dir, "m", 2, feats, 256, (-0.25, 0.125))
    model, lo, hi = forest.load(spark, tmp_dir, "m", 2)
    assert (lo, hi, model.features, model.psi) == (-0.25, 0.125, feats, 256)
    state = spark.createDataFrame([("m", 1, "Archived"), ("m", 2, "Production")], "model string, version int, stage string")
    runs = spark.createDataFrame([("m", 2, -0.25, 0.125)], "model string, version int, min_decision_score double, max_decision_score double")
    det = Detector.serving(spark, tmp_dir + "/out", tmp_dir, state, runs, "m")
    assert det.bounds == (-0.25, 0.125) and det.raw is not None
    rows = spark.createDataFrame([(100.0, 50.0, 1.0), (9000.0, 900.0, 9.0)], "amount double, account_avg_amount double, deviation_from_avg double")
    got = [r[0] for r in rows.select(det.raw).collect()]
    want = forest.Forest(forest.mini_forest_nodes(), feats, 256).decision(__import__("numpy").array([[100.0, 50.0, 1.0], [9000.0, 900.0, 9.0]]))
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_every_run_ends_in_a_stage(spark):
    rows = [("m", v, f1, v) for v, f1 in enumerate([0.5, 0.51, 0.6, None, 0.61, 0.62, 0.7], 1)]
    runs = spark.createDataFrame(rows, "model string, version int, f1_score double, day int").selectExpr(
        "model", "version", "f1_score", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(day) AS logged_at")
    state = {r.version: r.stage for r in lifecycle.stage_state(lifecycle.run_history(runs, 0.02)).collect()}
    assert state == {1: "Archived", 2: "Staging", 3: "Archived", 4: "Staging", 5: "Staging", 6: "Archived", 7: "Production"}


def test_last_valid_status_update_counts(spark):
    from riskflow.operators import review
    base = spark.createDataFrame([("a", "NEW"), ("b", "NEW"), ("c", None)], "transaction_id string, status string")
    upd = spark.createDataFrame([("a", "fraud", 1), ("a", "dismissed", 2), ("b", "bogus", 3), ("z", "FRAUD", 4), ("c", None, 5)],
                                "transaction_id string, new_status string, n int")
    updated, matched, unmatched, invalid = review.status_update(base, upd, order="n")
    assert {r[0]: r[1] for r in updated.collect()} == {"a": "DISMISSED", "b": "NEW", "c": None}
    assert [r.transaction_id for r in matched.collect()] == ["a"] and [r.transaction_id for r in unmatched.collect()] == ["z"]
    assert sorted(r.transaction_id for r in invalid.collect()) == ["b", "c"]


def test_windows_must_fit_the_interval():
    from riskflow.operators import monitor
    assert monitor.steps(300, 30) == 10
    with pytest.raises(ValueError):
        monitor.steps(100, 30)


def test_every_tree_draws_from_all_rows(spark):
    from riskflow.operators import forest
    df = spark.range(200_000).select(F.concat(F.lit("T"), "id").alias("transaction_id"), F.rand(1).alias("x"), F.col("id").cast("double").alias("y"))
    got = forest.tree_samples(df, ["x", "y"], n_trees=40, psi=256).groupBy("tree").agg(F.count("*").alias("n"), F.max("y").alias("hi")).collect()
    assert len(got) == 40 and all(r.n == 256 and r.hi > 190_000 for r in got)
    drawn = forest.tree_samples(df, ["x", "y"], n_trees=40, psi=256).select("y").distinct().count()
    assert drawn > 9500          # no pool: 40 * 256 draws hit hardly any row twice


def test_trailing_max_against_brute_force(spark):
    import random
    from riskflow.operators import monitor
    r = random.Random(4)
    for start in (0, 7, 10):
        vals = [r.randrange(100) for _ in range(47)]
        rows = [((start + i) * 30, v) for i, v in enumerate(vals)]
        s = spark.createDataFrame(rows, "t long, rate int").select(F.timestamp_seconds("t").cast("timestamp_ntz").alias("tick"), "rate")
        got = [x.max_rate for x in monitor.trailing_max(s, "rate", over_s=300, interval_s=30).orderBy("tick").collect()]
        assert got == [max(vals[max(0, i - 9):i + 1]) for i in range(len(vals))]


def test_the_grid_does_not_follow_wild_dates(spark):
    from riskflow.operators import monitor
    ev = spark.createDataFrame([("1970-01-01 00:00:00", 1), ("2024-01-01 00:10:00", 2), ("9999-01-01 00:00:00", 1)], "t string, processed int").select(
        F.to_timestamp_ntz("t").alias("ts"), "processed")
    got = monitor.rate_series(spark, ev, ("2024-01-01 00:00:00", "2024-01-01 01:00:00"), 300, 30, ("processed",)).collect()
    assert len(got) == 120 and sum(x.processed_rate > 0 for x in got) == 10


def test_charges_without_an_id_are_split_off(spark):
    from riskflow.sources import charges
    raw = charges.order_charges(spark, "/root/testdata/sf0.001")
    bad = raw.limit(3).withColumn("id", F.lit(None).cast("string"))
    ok, rejects = charges.split_charges(raw.unionByName(bad))
    assert rejects.count() == 3 and ok.count() == raw.count() and "reject_reason" not in ok.columns
