"""Shared Spark views over the driver tables (mirrors of plans.sqlparts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskflow.operators import review, score
from riskflow.sources import adapters


def tx(spark: SparkSession, d: str) -> DataFrame:
    return adapters.events_transactions(spark, d)


def scored(spark: SparkSession, d: str, keep_features: bool = False) -> DataFrame:
    """events -> transactions -> SCORED (stand-in scorer, rules fallback)."""
    return score.score_transactions(tx(spark, d), keep_features=keep_features)


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    """SCORED after the analysts' status updates (J5) and the legacy rows."""
    s = scored(spark, d)
    updated = review.status_update(s, score.review_decisions(s))[0]
    return score.legacy_rows_without_status(updated)


def anomalies(spark: SparkSession, d: str) -> DataFrame:
    return reviewed(spark, d).where("is_anomaly = 1")


SEED_END = "2024-01-04 00:00:00"


def store(spark: SparkSession, d: str) -> DataFrame:
    """The transactions table as the detector leaves it (U1): rows seeded
    before the detector started carry no derived columns; later rows are
    scored and reviewed."""
    from pyspark.sql import functions as F

    from riskflow.operators import evaluate
    cut = F.to_timestamp_ntz(F.lit(SEED_END))
    seeded = tx(spark, d).where(F.col("timestamp") < cut)
    return evaluate.union_append(seeded, reviewed(spark, d).where(F.col("timestamp") >= cut))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    from riskflow.operators import evaluate
    return evaluate.scored_only(store(spark, d))
