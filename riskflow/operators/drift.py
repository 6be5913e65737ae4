"""Model drift: verdict over class metrics, daily drift, feature drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.functions.exprs import chi_square_p, fixed
from riskflow.operators import evaluate
from riskflow.operators.common import distributed_prefix


def _pct1(c: Column) -> Column:
    return F.concat(fixed(c * 100, 1), F.lit("%"))


def drift_verdict_cols(baseline_f1: float = C.BASELINE_F1,
                       threshold: float = C.DEGRADATION_THRESHOLD) -> list[Column]:
    """First matching condition wins -> (drift_detected, drift_reason)."""
    n = F.col("sample_count")
    deg = F.lit(float(baseline_f1)) - F.col("f1_score")
    pr, fpr, fnr = F.col("prediction_rate"), F.col("false_positive_rate"), F.col("false_negative_rate")
    cases = [
        (n < C.DRIFT_MIN_SAMPLES, False,
         F.concat(F.lit("Insufficient samples ("), n.cast("string"), F.lit(") for drift detection"))),
        (deg > threshold, True,
         F.concat(F.lit("F1 degradation: "), fixed(deg, 3), F.lit(f" (threshold: {threshold})"))),
        (pr > C.MAX_PREDICTION_RATE, True,
         F.concat(F.lit("Excessive fraud predictions: "), _pct1(pr), F.lit(" (possible model malfunction)"))),
        (pr < C.MIN_PREDICTION_RATE, True,
         F.concat(F.lit("Too few fraud predictions: "), _pct1(pr), F.lit(" (model may not be detecting fraud)"))),
        (fpr > C.MAX_FPR, True, F.concat(F.lit("High false positive rate: "), _pct1(fpr))),
        (fnr > C.MAX_FNR, True, F.concat(F.lit("High false negative rate: "), _pct1(fnr))),
    ]
    flag, reason = None, None
    for cond, d, msg in cases:
        flag = F.when(cond, F.lit(d)) if flag is None else flag.when(cond, F.lit(d))
        reason = F.when(cond, msg) if reason is None else reason.when(cond, msg)
    return [flag.otherwise(F.lit(False)).alias("drift_detected"),
            reason.otherwise(F.lit("Model performance within acceptable range")).alias("drift_reason")]


def drift_verdict(pred: DataFrame, **kw) -> DataFrame:
    """Metrics of the prediction window + verdict, one row."""
    m = evaluate.metrics_from_confusion(evaluate.confusion(pred), digits=None)
    return m.select("*", *drift_verdict_cols(**kw))


def drift_daily(pred: DataFrame, **kw) -> DataFrame:
    """D2 per day: grouped confusion -> metrics -> verdict (one row per day)."""
    a, p = F.col("actual_label"), F.col("predicted_label")
    cm = pred.groupBy(F.date_trunc("day", "timestamp").alias("day")).agg(
        F.count_if((a == 0) & (p == 0)).alias("tn"), F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"), F.count_if((a == 1) & (p == 1)).alias("tp"),
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(a.cast("double")).alias("fraud_rate"), F.avg(p.cast("double")).alias("prediction_rate"))
    m = evaluate.metrics_from_confusion(cm, digits=None)
    return m.select("*", *drift_verdict_cols(**kw))


def drift_alerts(daily: DataFrame, f1_floor: float = C.F1_FLOOR) -> DataFrame:
    """D3: firing intervals of the drift rules over the daily history.

    A day's value holds until the next day. Consecutive days that meet a rule's condition
    are one active interval, which fires once it has lasted for the rule's ``for:``
    (one row a day and rule, so the ranking is small).
    """
    held = None
    for (alert, severity, service, for_s), cond in ((C.DRIFT_ALERT, F.col("drift_detected")), (C.F1_ALERT, F.col("f1_score") < f1_floor)):
        rows = daily.where(cond).select("day", F.lit(alert).alias("alert"), F.lit(severity).alias("severity"), F.lit(service).alias("service"), F.lit(for_s).alias("for_s"))
        held = rows if held is None else held.unionByName(rows)
    run = F.datediff("day", F.lit("2000-01-01")) - F.row_number().over(Window.partitionBy("alert").orderBy("day"))
    span = held.withColumn("run", run).groupBy("alert", "severity", "service", "for_s", "run").agg(
        F.min("day").alias("active_start"), (F.max("day") + F.make_dt_interval(days=F.lit(1))).alias("firing_end"))
    start = F.col("active_start") + F.make_dt_interval(secs=F.col("for_s"))
    return span.where(start < F.col("firing_end")).select("alert", "severity", "service", "active_start", start.alias("firing_start"), "firing_end")


def _long(df: DataFrame, features: list[str], side: Column) -> DataFrame:
    kv = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                             for f in features]))
    return df.select(side.alias("side"), kv.alias("_kv")).select("side", "_kv.feature", "_kv.value")


def feature_drift_ks(ref: DataFrame, cur: DataFrame, features: list[str],
                     alpha_c: float = 1.358, digits: int = 6) -> DataFrame:
    """M9: two-sample Kolmogorov-Smirnov statistic per feature.

    Long format (feature, value, side) -> counts per distinct value ->
    inclusive prefix sums per feature (two-level, skew-safe) -> max |ΔCDF|.
    drifted when D > c(α)·sqrt((n+m)/(n·m)) (α = 0.05).
    """
    long = _long(ref, features, F.lit("ref")).unionByName(_long(cur, features, F.lit("cur")))
    g = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count_if(F.col("side") == "ref").alias("n_ref"), F.count_if(F.col("side") == "cur").alias("n_cur"))
    tot = g.groupBy("feature").agg(F.sum("n_ref").alias("tot_ref"), F.sum("n_cur").alias("tot_cur"))
    c = distributed_prefix(g, ["value"], ["n_ref", "n_cur"], ["feature"], inclusive=True)
    c = c.join(tot, "feature")
    d = F.abs(F.col("cum_n_ref") / F.col("tot_ref") - F.col("cum_n_cur") / F.col("tot_cur"))
    out = c.groupBy("feature", "tot_ref", "tot_cur").agg(F.max(d).alias("ks_statistic"))
    crit = F.lit(alpha_c) * F.sqrt((F.col("tot_ref") + F.col("tot_cur")) / (F.col("tot_ref") * F.col("tot_cur")))
    return out.select("feature", F.round("ks_statistic", digits).alias("ks_statistic"),
                      F.round(crit, digits).alias("critical_value"),
                      (F.col("ks_statistic") > crit).alias("drifted"))


def feature_drift_psi(ref: DataFrame, cur: DataFrame, features: list[str], bins: int = 10,
                      floor: float = 1e-4, digits: int = 6) -> DataFrame:
    """M9: population stability index per feature over equal-width bins of
    the reference range (values outside clamp to the end bins)."""
    long = _long(ref, features, F.lit("ref")).unionByName(_long(cur, features, F.lit("cur")))
    long = long.where(F.col("value").isNotNull())
    rng = long.where(F.col("side") == "ref").groupBy("feature").agg(F.min("value").alias("lo"),
                                                                     F.max("value").alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.greatest(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(0)),
                                  F.lit(bins - 1))).otherwise(F.lit(0))
    binned = long.join(rng, "feature").withColumn("bin", b.cast("int"))
    cnt = binned.groupBy("feature", "bin").agg(F.count_if(F.col("side") == "ref").alias("n_ref"),
                                               F.count_if(F.col("side") == "cur").alias("n_cur"))
    tot = cnt.groupBy("feature").agg(F.sum("n_ref").alias("tot_ref"), F.sum("n_cur").alias("tot_cur"))
    j = cnt.join(tot, "feature")
    pr = F.greatest(F.col("n_ref") / F.col("tot_ref"), F.lit(floor))
    pc = F.greatest(F.col("n_cur") / F.col("tot_cur"), F.lit(floor))
    return (j.groupBy("feature").agg(F.sum((pc - pr) * F.ln(pc / pr)).alias("psi"))
             .select("feature", F.round("psi", digits).alias("psi"), (F.col("psi") > 0.2).alias("drifted")))


def category_drift(ref: DataFrame, cur: DataFrame, features: list[str], small: int = 1000, alpha: float = 0.05,
                   distance: float = 0.1, digits: int = 6) -> DataFrame:
    """M9 for text columns: chi-square test of the two samples' counts per category, and the Jensen-Shannon distance
    (base 2) of their shares. A feature has drifted when p < ``alpha`` for references of at most ``small`` rows, and
    when the distance reaches ``distance`` above that, where the test calls any difference significant. Null is a
    category; a side without rows gives null figures. One grouped count with map-side partial sums; the rest sees a
    row per category."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        kv = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]))
        return df.select(kv.alias("_kv")).select("_kv.*", *[F.lit(int(name == s)).alias(s) for s in ("n_ref", "n_cur")])
    g = counts(ref, "n_ref").unionByName(counts(cur, "n_cur")).groupBy("feature", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    tot = g.groupBy("feature").agg(F.sum("n_ref").alias("tot_ref"), F.sum("n_cur").alias("tot_cur"), F.count(F.lit(1)).alias("n_categories"))
    j = g.join(tot, "feature").where("tot_ref > 0 AND tot_cur > 0")

    def cell(n: str, t: str) -> Column:
        expected = F.col(t) * (F.col("n_ref") + F.col("n_cur")) / (F.col("tot_ref") + F.col("tot_cur"))
        return (F.col(n) - expected) * (F.col(n) - expected) / expected

    def part(n: str, t: str) -> Column:
        p, mid = F.col(n) / F.col(t), (F.col("n_ref") / F.col("tot_ref") + F.col("n_cur") / F.col("tot_cur")) / 2
        return F.when(p > 0, p * F.log2(p / mid)).otherwise(F.lit(0.0))
    sums = j.groupBy("feature").agg(F.sum(cell("n_ref", "tot_ref") + cell("n_cur", "tot_cur")).alias("chi2"),
                                    F.sqrt(F.greatest(F.sum(part("n_ref", "tot_ref") + part("n_cur", "tot_cur")) / 2, F.lit(0.0))).alias("js"))
    p = chi_square_p(F.col("chi2"), F.col("n_categories") - 1)
    out = tot.join(sums, "feature", "left").withColumn("p", F.when(F.col("chi2").isNotNull(), p))
    return out.select("feature", "n_categories", F.round("chi2", digits).alias("chi2"), F.round("p", digits).alias("p_value"),
                      F.round("js", digits).alias("js_distance"),
                      F.when(F.col("tot_ref") <= small, F.col("p") < alpha).otherwise(F.col("js") >= distance).alias("drifted"))


def dataset_drift(per_feature: DataFrame) -> DataFrame:
    """M9: share of drifted features."""
    return per_feature.agg(F.round(F.avg(F.col("drifted").cast("double")), 6).alias("drift_share"),
                           F.count(F.lit(1)).alias("n_features"))
