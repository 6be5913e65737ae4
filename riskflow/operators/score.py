"""Batch detection: transactions -> SCORED rows (the flagship composition)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.operators import features, ingest, rules
from riskflow.schema import SCORED_COLUMNS


def score_transactions(tx: DataFrame, raw: Column | None = None,
                       min_score: float = rules.REFERENCE_MIN_SCORE,
                       max_score: float = rules.REFERENCE_MAX_SCORE,
                       fallback: str = "rules", keep_features: bool = False,
                       base: DataFrame | None = None,
                       order: tuple[str, ...] = ("timestamp", "transaction_id")) -> DataFrame:
    """history-before-row (W1) -> deviation (E1) -> score (E6) -> rules.

    ``raw`` is the model's raw decision score as a column over
    (amount, account_avg_amount, deviation_from_avg); default is the
    deterministic stand-in scorer. Pass ``F.lit(None)`` for "model down".
    ``order`` is the order in which the rows came.
    """
    h = features.history_before_row(tx, base=base, order=order)
    raw = rules.reference_raw_score() if raw is None else raw
    out = rules.score_with(h, raw, min_score, max_score, fallback=fallback)
    if keep_features:
        return out
    return out.select(*SCORED_COLUMNS)


def detect(requests: DataFrame, arrival: tuple[str, ...] = ("arrival_ts", "copy"), **kw):
    """Requests -> (scored rows, rejects): validation, dedupe, scoring in arrival order."""
    accepted, rejects = ingest.split_requests(requests, order=arrival)
    return score_transactions(accepted, order=(*arrival, "transaction_id"), **kw), rejects


def review_decisions(scored: DataFrame) -> DataFrame:
    """Analyst decisions derived from the labels, as a keyed update set
    (transaction_id, new_status).

    Labelled frauds become FRAUD; other anomalies in low-risk categories are
    DISMISSED; Travel anomalies are INVESTIGATED (sent in lower case: the
    update upper-cases it). Everything else stays as detected.
    """
    new_status = (F.when(F.col("is_fraud") == 1, F.lit("FRAUD"))
                   .when(F.col("merchant_category").isin("Groceries", "Utility Bill"), F.lit("DISMISSED"))
                   .when(F.col("merchant_category") == "Travel", F.lit("investigated")))
    return (scored.where(F.col("is_anomaly") == 1)
                  .select("transaction_id", new_status.alias("new_status"))
                  .where(F.col("new_status").isNotNull()))


def legacy_rows_without_status(scored: DataFrame, location: str = "Espoo") -> DataFrame:
    """Rows of one site were migrated from a table without a status column:
    their status is NULL (exercises the NULL -> NEW normalisation)."""
    return scored.withColumn("status", F.when(F.col("location") == location, F.lit(None).cast("string"))
                                        .otherwise(F.col("status")))
