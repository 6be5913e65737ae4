"""Metrics, drift verdict, promotion, quality gate, AUC (FIXTURES §6), severity (§5)."""
import pytest
from pyspark.sql import functions as F

from riskflow.functions import exprs as X
from riskflow.operators import drift, evaluate, lifecycle


def _pred(spark, tp, fp, fn, tn):
    rows = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn
    return spark.createDataFrame(rows, "actual_label int, predicted_label int")


def test_confusion_metrics(spark):
    m = evaluate.class_metrics(_pred(spark, 30, 10, 20, 40)).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.sample_count) == (30, 10, 20, 40, 100)
    assert (m.precision, m.recall, m.accuracy) == (0.75, 0.6, 0.7)
    assert m.f1_score == pytest.approx(0.666667)
    assert (m.false_positive_rate, m.false_negative_rate) == (0.2, 0.4)


def test_empty_and_no_positive_metrics(spark):
    e = evaluate.class_metrics(_pred(spark, 0, 0, 0, 0).where("false")).first()
    assert (e.precision, e.recall, e.f1_score, e.accuracy, e.sample_count) == (0.0, 0.0, 0.0, 0.0, 0)
    n = evaluate.class_metrics(_pred(spark, 0, 0, 0, 10)).first()
    assert (n.precision, n.recall, n.f1_score, n.false_negative_rate) == (0.0, 0.0, 0.0, 0.0)


def _verdict(spark, **m):
    base = dict(sample_count=1000, f1_score=0.7, prediction_rate=0.1, false_positive_rate=0.1,
                false_negative_rate=0.1)
    base.update(m)
    df = spark.createDataFrame([tuple(base.values())], ", ".join(
        f"{k} {'long' if k == 'sample_count' else 'double'}" for k in base))
    r = df.select(*drift.drift_verdict_cols()).first()
    return r.drift_detected, r.drift_reason


def test_drift_verdicts(spark):
    assert _verdict(spark, sample_count=99) == (False, "Insufficient samples (99) for drift detection")
    assert _verdict(spark, f1_score=0.59) == (True, "F1 degradation: 0.110 (threshold: 0.1)")
    assert _verdict(spark, f1_score=0.65, prediction_rate=0.81) == (
        True, "Excessive fraud predictions: 81.0% (possible model malfunction)")
    assert _verdict(spark, prediction_rate=0.0005)[0] is True
    assert _verdict(spark, false_positive_rate=0.31) == (True, "High false positive rate: 31.0%")
    assert _verdict(spark, false_negative_rate=0.51) == (True, "High false negative rate: 51.0%")
    assert _verdict(spark) == (False, "Model performance within acceptable range")


def _promote(spark, new, prod, force=False):
    cand = spark.createDataFrame([("m", 2, new)], "model string, version int, f1_score double")
    p = None if prod is None else spark.createDataFrame([("m", 1, prod)], "model string, version int, f1_score double")
    r = lifecycle.promotion(cand, p, force=force).first()
    return r.promote, r.reason


def test_promotion(spark):
    assert _promote(spark, 0.6, None) == (True, "No existing production model")
    assert _promote(spark, 0.63, 0.6) == (True, "F1 improvement: 0.030 (>0.02)")
    assert _promote(spark, 0.61, 0.6) == (False, "F1 improvement: 0.010 (<0.02 threshold)")
    assert _promote(spark, 0.55, 0.6) == (False, "F1 degradation: -0.050")
    assert _promote(spark, 0.55, 0.6, force=True) == (True, "Force promotion flag enabled")


def _gate(spark, n, amount_zero=False, null_frac=0.0, drop_label=False):
    rows = []
    for i in range(n):
        acc = None if i < int(n * null_frac) else "A"
        rows.append((f"T{i}", acc, 0.0 if (amount_zero and i == 0) else 10.0, i % 2))
    df = (spark.createDataFrame(rows, "transaction_id string, account_id string, amount double, is_fraud int")
          .withColumn("timestamp", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))))
    if drop_label:
        df = df.drop("is_fraud")
    return {r.check: r.failed for r in evaluate.quality_gate(df).collect()}


def test_quality_gate(spark):
    assert _gate(spark, 999)["min_samples"] is True
    assert _gate(spark, 1000, drop_label=True)["required_columns"] is True
    assert _gate(spark, 1000, null_frac=0.11)["excessive_nulls"] is True
    assert _gate(spark, 1000, amount_zero=True)["amount_positive"] is True
    ok = _gate(spark, 1000)
    assert not any(v for k, v in ok.items() if k in ("min_samples", "required_columns", "excessive_nulls",
                                                      "amount_positive"))
    with pytest.raises(evaluate.DataQualityError):
        evaluate.raise_on_gate(evaluate.quality_gate(spark.range(5).selectExpr(
            "cast(id as string) transaction_id", "'a' account_id", "10.0 amount", "0 is_fraud",
            "timestamp_ntz'2024-01-01 00:00:00' timestamp")))


def _auc(spark, pairs):
    df = spark.createDataFrame(pairs, "y int, s double")
    return evaluate.roc_auc(df, "y", F.col("s")).first().roc_auc


def test_auc_cases(spark):
    assert _auc(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]) == 1.0
    assert _auc(spark, [(1, 0.1), (1, 0.2), (0, 0.8), (0, 0.9)]) == 0.0
    assert _auc(spark, [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)]) == 0.5
    assert _auc(spark, [(1, 0.5), (1, 0.7)]) == 0.0


def test_auc_invariant_under_monotone_map(spark):
    import random
    rnd = random.Random(7)
    pairs = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(300)]
    a = _auc(spark, pairs)
    b = _auc(spark, [(y, s ** 3 * 10 - 4) for y, s in pairs])
    assert 0.0 <= a <= 1.0 and a == pytest.approx(b)


def test_severity(spark):
    df = spark.createDataFrame([(0.95, 10.0), (0.9, 10.0), (0.8, 10.0), (0.1, 5000.0), (0.6, 10.0), (0.59, 10.0)],
                               "ml_anomaly_score double, amount double")
    assert [r.s for r in df.select(X.severity().alias("s")).collect()] == [
        "critical", "critical", "high", "high", "warning", "info"]


def test_python_style_fixed_format(spark):
    df = spark.createDataFrame([(0.7 - 0.0625,), (0.125,), (2.675,)], "x double")
    assert [r.t for r in df.select(X.fixed("x", 3).alias("t")).collect()] == [
        f"{0.7 - 0.0625:.3f}", "0.125", "2.675"]
    assert [r.t for r in df.select(X.fixed("x", 2).alias("t")).collect()] == [
        f"{0.7 - 0.0625:.2f}", f"{0.125:.2f}", f"{2.675:.2f}"]


def test_chi_square_tail_against_known_values(spark):
    known = [(3.841458820694124, 1, 0.05), (6.634896601021213, 1, 0.01), (5.991464547107979, 2, 0.05), (9.487729036781154, 4, 0.05),
             (16.918977604620448, 9, 0.05), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05), (135.80672317102676, 100, 0.01),
             (0.0, 3, 1.0), (1.0, 0, 1.0), (1e9, 10, 0.0)]
    df = spark.createDataFrame(known, "x double, df int, p double")
    for r in df.select("*", X.chi_square_p(F.col("x"), F.col("df")).alias("got")).collect():
        assert abs(r.got - r.p) < 1e-9, r


def test_category_drift_by_hand(spark):
    from math import log2, sqrt
    ref = spark.createDataFrame([("a", "x")] * 30 + [("b", "x")] * 10, "c string, d string")
    cur = spark.createDataFrame([("a", "x")] * 10 + [(None, "x")] * 10, "c string, d string")
    got = {r.feature: r for r in drift.category_drift(ref, cur, ["c", "d"]).collect()}
    a, b = [30, 10, 0], [10, 0, 10]
    chi = sum((n - t * (x + y) / 60) ** 2 / (t * (x + y) / 60) for x, y in zip(a, b) for n, t in ((x, 40), (y, 20)))
    half = lambda p, q: sum(x * log2(2 * x / (x + y)) for x, y in zip(p, q) if x)
    p, q = [x / 40 for x in a], [y / 20 for y in b]
    assert abs(got["c"].chi2 - chi) < 1e-6 and abs(got["c"].js_distance - sqrt((half(p, q) + half(q, p)) / 2)) < 1e-6
    assert got["c"].n_categories == 3 and got["c"].drifted
    assert (got["d"].p_value, got["d"].js_distance, got["d"].drifted) == (1.0, 0.0, False)
    none = drift.category_drift(ref, cur.limit(0), ["c"]).first()
    assert none.chi2 is None and none.drifted is None and drift.category_drift(ref.limit(0), cur.limit(0), ["c"]).count() == 0
