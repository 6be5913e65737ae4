"""Scoring rules, alert reason and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.functions import exprs as X


def high_value(amount="amount", threshold=C.HIGH_VALUE_THRESHOLD) -> Column:
    """R1."""
    return X.col(amount) >= threshold


def suspicious_combo(category="merchant_category", location="location") -> Column:
    """R2: case-sensitive category match, any location but the standard one
    (a missing location counts as 'not the standard one')."""
    return (X.col(category) == C.SUSPICIOUS_MERCHANT) & ~X.col(location).eqNullSafe(C.STANDARD_LOCATION)


def high_deviation(dev="deviation_from_avg", count="account_tx_count") -> Column:
    """R3."""
    return (X.col(dev) >= C.DEVIATION_THRESHOLD) & (X.col(count) > C.MIN_HISTORY_COUNT)


def ml_risk(score="ml_anomaly_score") -> Column:
    """R4 (a NULL score never fires)."""
    return F.coalesce(X.col(score) >= C.ML_RISK_THRESHOLD, F.lit(False))


def rule_hits(df: DataFrame, score="ml_anomaly_score") -> DataFrame:
    """Boolean per rule plus the fired list in rule order."""
    df = (df.withColumn("r_high_value", F.coalesce(high_value(), F.lit(False)))
            .withColumn("r_combo", F.coalesce(suspicious_combo(), F.lit(False)))
            .withColumn("r_deviation", F.coalesce(high_deviation(), F.lit(False)))
            .withColumn("r_ml", ml_risk(score)))
    fired = F.array_compact(F.array(
        F.when(F.col("r_high_value"), F.lit(C.REASON_HIGH_VALUE)),
        F.when(F.col("r_combo"), F.lit(C.REASON_COMBO)),
        F.when(F.col("r_deviation"), F.lit(C.REASON_DEVIATION)),
        F.when(F.col("r_ml"), F.lit(C.REASON_ML))))
    return df.withColumn("fired_rules", fired)


def alert_reason_expr() -> Column:
    """ML first, then deviation, else the value/combo reasons joined."""
    joined = F.concat_ws(C.REASON_JOINER,
                         F.when(F.col("r_high_value"), F.lit(C.REASON_HIGH_VALUE)),
                         F.when(F.col("r_combo"), F.lit(C.REASON_COMBO)))
    return (F.when(F.col("r_ml"), F.lit(C.ALERT_ML))
             .when(F.col("r_deviation"), F.lit(C.ALERT_DEVIATION))
             .otherwise(F.nullif(joined, F.lit(""))))


def apply_rules(df: DataFrame, score="ml_anomaly_score", keep_flags: bool = False) -> DataFrame:
    """alert_reason, is_anomaly, status (NEW for anomalies)."""
    out = rule_hits(df, score)
    out = (out.withColumn("alert_reason", alert_reason_expr())
              .withColumn("is_anomaly", F.col("alert_reason").isNotNull().cast("int"))
              .withColumn("status", F.when(F.col("alert_reason").isNotNull(), F.lit("NEW"))))
    if not keep_flags:
        out = out.drop("r_high_value", "r_combo", "r_deviation", "r_ml", "fired_rules")
    return out


def reference_raw_score(amount="amount", dev="deviation_from_avg") -> Column:
    """A deterministic stand-in for the forest's decision function.

    Lower = more anomalous, like ``decision_function``: falls with the
    log-amount and with the absolute deviation (capped at 10). Rounded to
    9 decimals so that every engine computes the same value. It is what
    the SQL-checked scoring queries use; production scoring uses the
    isolation forest (operators.forest).
    """
    return F.round(F.lit(0.1) - F.lit(0.03) * F.ln(F.lit(1.0) + X.col(amount) / 100.0)
                   - F.lit(0.01) * F.least(F.abs(X.col(dev)), F.lit(10.0)), 9)


# Bounds of the stand-in scorer, kept as model metadata like real bounds.
REFERENCE_MIN_SCORE = -0.15
REFERENCE_MAX_SCORE = 0.1


def score_with(df: DataFrame, raw: Column, min_score, max_score,
               fallback: str = "rules") -> DataFrame:
    """E6 + R1-R9: scale a raw score and apply the rules.

    A NULL raw score means the model could not score the row. ``fallback``
    decides what happens then: ``rules`` (default) keeps R1-R3 with R4 off
    and a NULL score; ``zero`` stores score 0.0 and no reason at all (the
    rules are skipped too).
    """
    df = df.withColumn("_raw", raw)
    df = df.withColumn("ml_anomaly_score", X.scale_score("_raw", min_score, max_score))
    out = apply_rules(df)
    if fallback == "zero":
        failed = F.col("_raw").isNull()
        out = (out.withColumn("ml_anomaly_score", F.when(failed, F.lit(0.0)).otherwise(F.col("ml_anomaly_score")))
                  .withColumn("alert_reason", F.when(failed, F.lit(None).cast("string")).otherwise(F.col("alert_reason")))
                  .withColumn("is_anomaly", F.col("alert_reason").isNotNull().cast("int"))
                  .withColumn("status", F.when(F.col("alert_reason").isNotNull(), F.lit("NEW"))))
    elif fallback != "rules":
        raise ValueError(f"unknown fallback {fallback!r}")
    return out.drop("_raw")
