"""M4: the training pipeline, from the stored transactions to a stored model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.operators import evaluate, features, forest, lifecycle
from riskflow.session import reliable


class TooFewSamples(RuntimeError):
    pass


def retrain_pipeline(store: DataFrame, as_of: str, min_samples: int = 1000, lookback_days: int = 90,
                     force_promotion: bool = False, production: DataFrame | None = None,
                     model: str = lifecycle.MODEL_NAME, version: int = 1, root: str | None = None,
                     feats: list[str] = C.TRAIN_FEATURES_9) -> DataFrame:
    """Lookback -> quality gate -> features -> split -> train -> evaluate -> store -> decide.

    ``production`` holds the run that serves now (None: there is none). With ``root`` the
    node table, features and bounds are stored under (model, version). Returns one row:
    the evaluation, the bounds, the decision and the stage the version goes to.
    """
    store = evaluate.lookback(store, as_of, lookback_days)
    evaluate.raise_on_gate(evaluate.quality_gate(store))
    fm = reliable(features.stratified_split(features.feature_matrix(store)))       # read by training, bounds and test
    train_set, test_set = fm.where("split = 'train'"), fm.where("split = 'test'")
    n = train_set.count()
    if n < min_samples:
        raise TooFewSamples(f"{n} training rows, {min_samples} needed")
    nodes = reliable(forest.train(train_set, feats, n=n))
    psi = min(C.MAX_SAMPLES, n)
    trained = forest.Forest.from_nodes(nodes, feats, psi)
    spark = store.sparkSession
    bounds = forest.score_bounds(train_set.withColumn("raw_score", trained.score_column(spark)))
    if root is not None:
        forest.save(nodes, root, model, version, feats, psi, bounds)
    scored = reliable(test_set.withColumn("raw_score", trained.score_column(spark)))
    auc = evaluate.roc_auc(scored, "is_fraud", -F.col("raw_score"))
    cand = evaluate.eval_stats(scored).select(F.lit(model).alias("model"), F.lit(version).alias("version"), "*")
    dec = lifecycle.promotion(cand, production, force=force_promotion)
    return dec.select("*", auc.select("roc_auc").scalar().alias("roc_auc"),
                      F.lit(bounds[0]).alias("min_decision_score"), F.lit(bounds[1]).alias("max_decision_score"),
                      F.when(F.col("promote"), F.lit("Production")).otherwise(F.lit("Staging")).alias("stage"))
