"""Isolation forest: exact path-length maths, bounded training, outlier ordering."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import forest
from riskflow.operators.forest import Forest, c_factor, mini_forest_nodes


def test_c_factor_values():
    assert c_factor([1])[0] == 0.0 and c_factor([2])[0] == 1.0
    assert c_factor([256])[0] == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_mini_forest_exact_value():
    f = Forest(mini_forest_nodes(), ["amount", "account_avg_amount", "deviation_from_avg"], 256)
    x = np.array([[100.0, 500.0, 1.0]])      # leaves: t0 node2, t1 node2, t2 node3
    depth = ((2 + c_factor([150])[0]) + (2 + c_factor([100])[0]) + (2 + c_factor([180])[0])) / 3
    assert f.decision(x)[0] == pytest.approx(0.5 - 2 ** (-depth / c_factor([256])[0]))


def test_training_is_bounded_and_outliers_score_lower(spark):
    rng = np.random.default_rng(0)
    pts = [(f"r{i}", float(v), float(w)) for i, (v, w) in enumerate(rng.normal(0, 1, size=(3000, 2)))]
    pts += [("out1", 9.0, 9.0), ("out2", -8.0, 7.5)]
    df = spark.createDataFrame(pts, "transaction_id string, a double, b double")
    nodes = forest.train(df, ["a", "b"], n_trees=30, psi=128)
    pdf = nodes.toPandas()
    assert pdf["tree"].nunique() == 30
    assert pdf.groupby("tree").size().max() <= 2 * 128 - 1
    assert pdf["depth"].max() <= 7
    model = Forest(pdf, ["a", "b"], 128)
    s = {r.transaction_id: r.s for r in df.select("transaction_id", model.score_column(spark).alias("s")).collect()}
    inliers = sorted(v for k, v in s.items() if k.startswith("r"))
    assert s["out1"] < inliers[len(inliers) // 100] and s["out2"] < inliers[len(inliers) // 100]


def test_training_is_deterministic(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("transaction_id"),
                                  (F.col("id") % 97).cast("double").alias("a"))
    a = forest.train(df, ["a"], n_trees=5, psi=64).orderBy("tree", "node").toPandas()
    b = forest.train(df, ["a"], n_trees=5, psi=64).orderBy("tree", "node").toPandas()
    assert a.equals(b)


def test_missing_features_score_null(spark):
    f = Forest(mini_forest_nodes(), ["amount", "account_avg_amount", "deviation_from_avg"], 256)
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 2.0, 3.0)],
                               "amount double, account_avg_amount double, deviation_from_avg double")
    out = [r.s for r in df.select(f.score_column(spark).alias("s")).collect()]
    assert out[0] is None and out[1] is not None


def test_retraining_leaves_out_amounts_that_the_detector_rejects(spark, tmp_dir):
    from riskflow.operators import evaluate, ingest
    from riskflow.plans import views
    from riskflow.plans.catalog import QUERIES
    ev = spark.range(1500).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-02 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 20)).alias("ts"),
        (F.col("id") % 9).alias("user_id"), F.when(F.col("id") % 6 == 0, "error").otherwise("view").alias("event_type"),
        F.when(F.col("id") == 700, 0.0).otherwise((F.col("id") * 37 % 500 + 1).cast("double")).alias("value"),
        F.format_string('{"k": %d}', F.col("id") % 100).alias("props"))
    ev.write.parquet(f"{tmp_dir}/events.parquet")
    store = views.store(spark, tmp_dir)
    assert store.count() == 1500 and ingest.positive_amounts(store).count() == 1499
    with pytest.raises(evaluate.DataQualityError, match="amount_positive"):
        evaluate.raise_on_gate(evaluate.quality_gate(store))
    assert QUERIES["retrain_pipeline"](spark, tmp_dir).count() == 1


def test_trees_draw_rows_in_generated_code(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("transaction_id"), F.col("id").cast("double").alias("a"))
    p = forest.tree_samples(df, ["a"], n_trees=5, psi=64)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in p and "explode(" in p


def test_scores_do_not_depend_on_the_rows_that_walk_together(monkeypatch):
    f = Forest(mini_forest_nodes(), ["amount", "account_avg_amount", "deviation_from_avg"], 256)
    x = np.random.default_rng(3).uniform([0, 0, -1], [8000, 1200, 9], size=(41, 3))
    got = []
    for rows in (256, 7):
        monkeypatch.setattr(forest, "SCORE_ROWS", rows)
        got.append(f.decision(x))

    def walk(t, row):
        n = 0
        while f.feature[t, n] >= 0:
            n = (f.left if row[f.feature[t, n]] <= f.threshold[t, n] else f.right)[t, n]
        return f.leaf_len[t, n]
    brute = [0.5 - 2 ** (-np.mean([walk(t, r) for t in range(3)]) / c_factor([256])[0]) for r in x]
    assert np.allclose(got[0], brute, atol=1e-12) and np.allclose(got[1], brute, atol=1e-12)
