"""Registered queries: isolation forest training / scoring and the
retraining composition (M1, M2, M4, A14)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.operators import features, forest, ingest, lifecycle, retrain, score
from riskflow.operators.forest import Forest, c_factor, mini_forest_nodes
from riskflow.plans import views
from riskflow.plans.registry import query
from riskflow.plans.sqlparts import TX, hist
from riskflow.session import reliable, scratch_path

F3 = C.TRAIN_FEATURES_3


def _case_sql(nodes, tree: int, names: list[str]) -> str:
    """Nested CASE for one tree, returning depth + c(size) at the leaf."""
    g = nodes[nodes["tree"] == tree].set_index("node")

    def walk(n: int) -> str:
        r = g.loc[n]
        if int(r["feature"]) < 0:
            return repr(float(r["depth"] + c_factor([r["size"]])[0]))
        col = names[int(r["feature"])]
        return (f"CASE WHEN {col} <= {float(r['threshold'])!r} THEN {walk(int(r['left']))} "
                f"ELSE {walk(int(r['right']))} END")
    return walk(0)


def _mini_sql() -> str:
    nodes = mini_forest_nodes()
    trees = sorted(nodes["tree"].unique())
    parts = " + ".join(f"({_case_sql(nodes, t, F3)})" for t in trees)
    cpsi = float(c_factor([256])[0])
    return f"""WITH {TX},
{hist('tx')}
SELECT transaction_id,
       round(0.5 - pow(2.0, -(({parts}) / {len(trees)}.0) / {cpsi!r}), 9) AS raw_score
FROM hist"""


@query("mini_forest", _mini_sql())
def q_mini_forest(spark, d):
    """M2 on a fixed three-tree forest: the numpy scorer vs SQL CASE trees."""
    f = Forest(mini_forest_nodes(), F3, 256)
    h = features.history_before_row(views.tx(spark, d))
    return h.select("transaction_id", F.round(f.score_column(spark), 9).alias("raw_score"))


@query("scored_by_stored_model", _mini_sql())
def q_scored_by_stored_model(spark, d):
    """M7: the three-tree forest stored under (model, version), loaded again and served."""
    root = scratch_path(spark, f"models-{uuid.uuid4().hex[:12]}")
    nodes = spark.createDataFrame(mini_forest_nodes(), forest.NODE_SCHEMA)
    forest.save(nodes, root, "mini", 3, F3, 256, (-0.2, 0.1))
    model, _, _ = forest.load(spark, root, "mini", 3)
    h = features.history_before_row(views.tx(spark, d))
    return h.select("transaction_id", F.round(model.score_column(spark), 9).alias("raw_score"))


def _trained(spark, d):
    t = views.tx(spark, d)
    # training features (W2 / E2), stored once: counted, sampled and scored for the bounds
    train_set = reliable(features.account_features(t).select("transaction_id", *F3))
    n = train_set.count()
    nodes = reliable(forest.train(train_set, F3, n=n))  # bounded: trees * (2ψ - 1) rows
    return t, train_set, nodes, Forest.from_nodes(nodes, F3, min(C.MAX_SAMPLES, n))


@query("forest_train")
def q_forest_train(spark, d):
    """M1: the node table (rows-only check + property tests)."""
    return _trained(spark, d)[2]


@query("forest_score")
def q_forest_score(spark, d):
    """M2 + A14 + R1-R7: serve-time features (history before the row),
    bounds from the training scores, rules on top -> SCORED rows."""
    t, train_set, _, model = _trained(spark, d)
    lo, hi = forest.score_bounds(train_set.withColumn("raw_score", model.score_column(spark)))
    return score.score_transactions(t, raw=model.score_column(spark), min_score=lo, max_score=hi)


@query("retrain_pipeline")
def q_retrain_pipeline(spark, d):
    """M4 as one summary row; the model is stored in the shared folder. The events hold amounts
    of zero, which the detector rejects and so never stores: they are left out before the gate."""
    runs = lifecycle.weekly_runs(views.predictions(spark, d))
    root = scratch_path(spark, f"models-{uuid.uuid4().hex[:12]}")
    return retrain.retrain_pipeline(ingest.positive_amounts(views.store(spark, d)), "2024-01-31 00:00:00", min_samples=10, lookback_days=90,
                                    production=runs.where("version = 1"), version=2, root=root)
