"""Model evaluation: confusion matrix, class metrics, AUC, quality gate
(A3-A7, F1, F8, Q1, U1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.functions import exprs as X
from riskflow.operators.common import distributed_prefix
from riskflow.session import ts_lit


def lookback(df: DataFrame, as_of: str, days: int, ts: str = "timestamp") -> DataFrame:
    """rows with ts >= as_of - days (as_of is always a parameter)."""
    return df.where(F.col(ts) >= ts_lit(as_of) - F.make_dt_interval(days=F.lit(days)))


def scored_only(df: DataFrame) -> DataFrame:
    """F8: rows that were scored, renamed to the prediction schema."""
    return df.where(F.col("is_anomaly").isNotNull()).select(
        "transaction_id", "timestamp",
        F.col("is_fraud").alias("actual_label"),
        F.col("is_anomaly").alias("predicted_label"),
        "ml_anomaly_score", "status")


def confusion(pred: DataFrame, actual: str = "actual_label", predicted: str = "predicted_label") -> DataFrame:
    """A3: tn, fp, fn, tp in one pass (labels 0/1)."""
    a, p = F.col(actual), F.col(predicted)
    return pred.agg(
        F.count_if((a == 0) & (p == 0)).alias("tn"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.count_if((a == 1) & (p == 1)).alias("tp"),
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(a.cast("double")).alias("fraud_rate"),
        F.avg(p.cast("double")).alias("prediction_rate"))


def metrics_from_confusion(cm: DataFrame, digits: int | None = 6) -> DataFrame:
    """A4: precision, recall, F1 (zero_division = 0), accuracy, FPR, FNR.

    Works per row, so it also serves grouped confusion tables (per day,
    per model version). Empty input -> all zeros.
    """
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "sample_count"))
    prec = X.safe_ratio(tp, tp + fp)
    rec = X.safe_ratio(tp, tp + fn)
    f1 = X.safe_ratio(2 * tp, 2 * tp + fp + fn)
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return cm.select(
        *[c for c in cm.columns if c not in ("fraud_rate", "prediction_rate")],
        r(prec).alias("precision"), r(rec).alias("recall"), r(f1).alias("f1_score"),
        r(X.safe_ratio(tp + tn, n)).alias("accuracy"),
        r(X.safe_ratio(fp, tn + fp)).alias("false_positive_rate"),
        r(X.safe_ratio(fn, fn + tp)).alias("false_negative_rate"),
        r(F.coalesce(F.col("fraud_rate"), F.lit(0.0))).alias("fraud_rate"),
        r(F.coalesce(F.col("prediction_rate"), F.lit(0.0))).alias("prediction_rate"))


def class_metrics(pred: DataFrame) -> DataFrame:
    return metrics_from_confusion(confusion(pred))


def roc_auc(df: DataFrame, label: str, score: Column, digits: int = 6) -> DataFrame:
    """Exact ROC AUC (Mann-Whitney with ties counted half); 0.0 when a
    class is missing.

    Rows are first collapsed to one row per distinct score (pos / neg
    counts), then the negatives ranked below each score come from a
    two-level prefix sum, so neither ties nor a big class land in one task.
    """
    g = (df.select(score.alias("_s"), F.col(label).alias("_y"))
           .groupBy("_s").agg(F.count_if(F.col("_y") == 1).alias("pos"),
                              F.count_if(F.col("_y") == 0).alias("neg")))
    g = distributed_prefix(g, ["_s"], ["neg"])
    num = F.sum(F.col("pos") * (F.col("cum_neg") + 0.5 * F.col("neg")))
    P, N = F.sum("pos"), F.sum("neg")
    return g.agg(
        F.round(F.when((P > 0) & (N > 0), num / (P * N)).otherwise(F.lit(0.0)), digits).alias("roc_auc"),
        P.alias("positives"), N.alias("negatives"))


def eval_stats(test: DataFrame, raw: str = "raw_score", label: str = "is_fraud", digits: int = 6) -> DataFrame:
    """A5: precision / recall / F1 of (raw < 0) predictions, predicted rate,
    min / max / mean / population std of the decision score."""
    pred = test.select(F.col(label).alias("actual_label"),
                       (F.col(raw) < 0).cast("int").alias("predicted_label"), F.col(raw))
    a, p = F.col("actual_label"), F.col("predicted_label")
    agg = pred.agg(
        F.count_if((a == 1) & (p == 1)).alias("tp"), F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.avg(p.cast("double")).alias("fraud_detection_rate"),
        F.min(raw).alias("min_anomaly_score"), F.max(raw).alias("max_anomaly_score"),
        F.avg(raw).alias("mean_anomaly_score"), F.stddev_pop(raw).alias("std_anomaly_score"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r = lambda c: F.round(c, digits)
    return agg.select(
        r(X.safe_ratio(tp, tp + fp)).alias("precision"), r(X.safe_ratio(tp, tp + fn)).alias("recall"),
        r(X.safe_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1_score"),
        r(F.col("fraud_detection_rate")).alias("fraud_detection_rate"),
        r(F.col("min_anomaly_score")).alias("min_anomaly_score"),
        r(F.col("max_anomaly_score")).alias("max_anomaly_score"),
        r(F.col("mean_anomaly_score")).alias("mean_anomaly_score"),
        r(F.col("std_anomaly_score")).alias("std_anomaly_score"))


def null_profile(df: DataFrame, required: list[str] = C.QUALITY_REQUIRED_COLUMNS,
                 digits: int = 6) -> DataFrame:
    """One pass: row count, null fraction per required column, any
    amount <= 0, label mean."""
    n = F.count(F.lit(1))
    cols = [n.alias("row_count")]
    cols += [F.round(F.coalesce(F.try_divide(F.count_if(F.col(c).isNull()).cast("double"), n), F.lit(0.0)),
                     digits).alias(f"null_frac_{c}") for c in required]
    have = set(df.columns)
    amount_bad = (F.coalesce(F.max((F.col("amount") <= 0).cast("int")), F.lit(0)) if "amount" in have
                  else F.lit(0))
    label_mean = (F.round(F.avg(F.col("is_fraud").cast("double")), digits) if "is_fraud" in have
                  else F.lit(None).cast("double"))
    cols += [amount_bad.alias("any_nonpositive_amount"), label_mean.alias("fraud_rate")]
    return df.agg(*cols)


def quality_gate(df: DataFrame, min_samples: int = C.MIN_TRAIN_SAMPLES,
                 required: list[str] = C.QUALITY_REQUIRED_COLUMNS) -> DataFrame:
    """Q1: ordered checks -> (check_order, check, severity, failed).

    Errors, in order: sample count, required columns, >10% nulls, amount
    <= 0. Warnings: no fraud labels, fraud rate > 0.5. The first failed
    error is what ``raise_on_gate`` raises.
    """
    missing = [c for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    prof = null_profile(df, present)
    high_null = F.array_compact(F.array(*[F.when(F.col(f"null_frac_{c}") > C.MAX_NULL_FRACTION, F.lit(c))
                                          for c in present]))
    def check(order, name, sev, failed):
        return F.struct(F.lit(order).alias("check_order"), F.lit(name).alias("check"),
                        F.lit(sev).alias("severity"), F.coalesce(failed, F.lit(False)).alias("failed"))
    checks = F.array(
        check(1, "min_samples", "error", F.col("row_count") < min_samples),
        check(2, "required_columns", "error", F.lit(bool(missing))),
        check(3, "excessive_nulls", "error", F.size(high_null) > 0),
        check(4, "amount_positive", "error", F.col("any_nonpositive_amount") == 1),
        check(5, "no_fraud_labels", "warning", F.col("fraud_rate") == 0),
        check(6, "high_fraud_rate", "warning", F.col("fraud_rate") > 0.5),
    )
    return prof.select(F.inline(checks))


class DataQualityError(Exception):
    pass


def raise_on_gate(gate: DataFrame) -> None:
    """Raise on the first failed error check (a 6-row result; safe to collect)."""
    for r in gate.where("failed AND severity = 'error'").orderBy("check_order").limit(1).collect():
        raise DataQualityError(f"data quality check failed: {r['check']}")


def union_append(seeded: DataFrame, scored: DataFrame) -> DataFrame:
    """Seeded rows (no derived columns) UNION ALL scored rows."""
    return seeded.unionByName(scored, allowMissingColumns=True)
