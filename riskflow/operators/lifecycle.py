"""Model registry as append-only tables: runs, promotion, stages
(W3, M5, M6, M8, M10).

The registry is small (one row per model version / stage event), but
the metrics that feed it are grouped aggregates over the full data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.functions.exprs import fixed
from riskflow.operators import evaluate
from riskflow.session import ts_lit

MODEL_NAME = "fraud-detection-model"


def weekly_runs(pred: DataFrame, model: str = MODEL_NAME) -> DataFrame:
    """One training run per calendar week: version = week rank, metrics of
    that week's predictions, logged at the week's end."""
    a, p = F.col("actual_label"), F.col("predicted_label")
    cm = pred.groupBy(F.date_trunc("week", "timestamp").alias("week")).agg(
        F.count_if((a == 0) & (p == 0)).alias("tn"), F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"), F.count_if((a == 1) & (p == 1)).alias("tp"),
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(a.cast("double")).alias("fraud_rate"), F.avg(p.cast("double")).alias("prediction_rate"))
    m = evaluate.metrics_from_confusion(cm)
    # the run table has one row per week: a global rank over it is tiny
    return m.select(F.lit(model).alias("model"),
                    F.dense_rank().over(Window.orderBy("week")).cast("int").alias("version"),
                    (F.col("week") + F.make_dt_interval(days=F.lit(7))).alias("logged_at"),
                    "precision", "recall", "f1_score", "sample_count")


def promotion(candidates: DataFrame, production: DataFrame | None,
              min_improvement: float = C.PROMOTION_MIN_IMPROVEMENT, force: bool = False) -> DataFrame:
    """M5: should each candidate replace the production model?

    Production's F1 enters as a scalar subquery (a one-row aggregate), so
    no join is needed. Missing F1 counts as 0.
    """
    if force:
        return candidates.select("*", F.lit(True).alias("promote"),
                                 F.lit("Force promotion flag enabled").alias("reason"))
    if production is None:
        return candidates.select("*", F.lit(True).alias("promote"),
                                 F.lit("No existing production model").alias("reason"))
    prod_f1 = production.agg(F.max(F.coalesce("f1_score", F.lit(0.0)))).scalar()
    imp = F.coalesce(F.col("f1_score"), F.lit(0.0)) - prod_f1
    txt = fixed(imp, 3)
    return candidates.select(
        "*", prod_f1.alias("prod_f1"), F.round(imp, 6).alias("improvement"),
        (imp >= min_improvement).alias("promote"),
        F.when(imp >= min_improvement, F.concat(F.lit("F1 improvement: "), txt, F.lit(f" (>{min_improvement})")))
         .when(imp > 0, F.concat(F.lit("F1 improvement: "), txt, F.lit(f" (<{min_improvement} threshold)")))
         .otherwise(F.concat(F.lit("F1 degradation: "), txt)).alias("reason"))


def registration_events(runs: DataFrame) -> DataFrame:
    """Every logged version starts in stage 'None'."""
    return runs.select("model", "version", F.lit("None").alias("stage"), "logged_at")


def transition_events(decision: DataFrame, current_production: DataFrame) -> DataFrame:
    """M6: promoted -> Production and the old Production -> Archived;
    otherwise -> Staging. ``decision`` holds the run(s) decided now."""
    up = decision.select("model", "version",
                         F.when(F.col("promote"), F.lit("Production")).otherwise(F.lit("Staging")).alias("stage"),
                         "logged_at")
    promoted = decision.where("promote").select("model", F.col("logged_at").alias("_at"))
    old = (current_production.join(promoted, "model")
           .select("model", "version", F.lit("Archived").alias("stage"), F.col("_at").alias("logged_at")))
    return up.unionByName(old)


def run_history(runs: DataFrame, min_improvement: float = C.PROMOTION_MIN_IMPROVEMENT) -> DataFrame:
    """M6 for every run in turn: each version is compared with the production of that
    moment and ends in Production (the old one in Archived) or in Staging.

    Decisions depend on one another, so the runs of a model -- one row a version -- are
    folded in version order inside one row.
    """
    event = "struct<version:int,stage:string,logged_at:timestamp_ntz>"
    state = f"struct<p:int,f:double,e:array<{event}>>"
    one = "named_struct('version', {0}, 'stage', '{1}', 'logged_at', x.logged_at)".format
    folded = runs.groupBy("model").agg(F.expr("array_sort(collect_list(struct(version, coalesce(f1_score, 0D) AS f1, logged_at)))").alias("r")).select(
        "model", F.expr(f"""aggregate(r, CAST(named_struct('p', NULL, 'f', 0D, 'e', array()) AS {state}),
            (s, x) -> CAST(
              CASE WHEN s.p IS NULL THEN named_struct('p', x.version, 'f', x.f1, 'e', concat(s.e, array({one("x.version", "Production")})))
                   WHEN x.f1 - s.f >= {min_improvement}
                   THEN named_struct('p', x.version, 'f', x.f1, 'e', concat(s.e, array({one("x.version", "Production")}, {one("s.p", "Archived")})))
                   ELSE named_struct('p', s.p, 'f', s.f, 'e', concat(s.e, array({one("x.version", "Staging")}))) END AS {state})).e""").alias("e"))
    return (registration_events(runs)
            .unionByName(folded.select("model", F.explode("e").alias("x")).select("model", "x.*")))


def stage_state(events: DataFrame) -> DataFrame:
    """W3 over events: the latest stage of every version (last event wins;
    among events at the same instant the later-ranked stage wins)."""
    rank = (F.when(F.col("stage") == "None", 0).when(F.col("stage") == "Staging", 1)
             .when(F.col("stage") == "Archived", 2).otherwise(3))
    return (events.groupBy("model", "version")
                  .agg(F.max_by(F.col("stage"), F.struct(F.col("logged_at"), rank)).alias("stage"),
                       F.max("logged_at").alias("since")))


def latest_models(state: DataFrame) -> DataFrame:
    """Latest version per model, and the latest version in each stage."""
    overall = state.groupBy("model").agg(F.max("version").alias("version")).withColumn("stage", F.lit("latest"))
    per_stage = state.groupBy("model", "stage").agg(F.max("version").alias("version"))
    return overall.select("model", "stage", "version").unionByName(per_stage.select("model", "stage", "version"))


def retrain_due(runs: DataFrame, as_of: str, max_age_days: int = 7, min_precision: float = 0.75) -> DataFrame:
    """M8: retrain when the model is >= 7 days old or precision < 0.75."""
    age = F.datediff(ts_lit(as_of), F.col("logged_at"))
    return runs.select("model", "version", age.alias("age_days"), "precision",
                       ((age >= max_age_days) | (F.col("precision") < min_precision)).alias("retrain_due"))


def rollback(state: DataFrame, at: Column) -> DataFrame:
    """The newest Archived version returns to Production; the current
    Production version is archived. Returns the stage events to append."""
    back = (state.where(F.col("stage") == "Archived").groupBy("model").agg(F.max("version").alias("version"))
                 .select("model", "version", F.lit("Production").alias("stage"), at.alias("logged_at")))
    cur = (state.where(F.col("stage") == "Production").join(back.select("model"), "model", "left_semi")
                .select("model", "version", F.lit("Archived").alias("stage"), at.alias("logged_at")))
    return back.unionByName(cur)


class ModelNotReady(RuntimeError):
    pass


def load_model(state: DataFrame, runs: DataFrame, model: str = MODEL_NAME, stage: str | None = "Production") -> dict:
    """M7: pick the model version to serve and its score bounds.

    ``stage=None`` takes the latest version whatever its stage; the default
    serves the latest Production version. ``runs`` carries the bounds
    (min_decision_score, max_decision_score). Raises when no version or no
    bounds exist. One row reaches the driver.
    """
    cand = state.where(F.col("model") == model)
    if stage is not None:
        cand = cand.where(F.col("stage") == stage)
    best = cand.agg(F.max("version").alias("version"))
    row = (best.join(runs.where(F.col("model") == model), ["version"], "left")
               .select("version", "min_decision_score", "max_decision_score").first())
    if row is None or row["version"] is None:
        raise ModelNotReady(f"no {stage or 'registered'} version of {model}")
    if row["min_decision_score"] is None or row["max_decision_score"] is None:
        raise ModelNotReady(f"score bounds missing for {model} v{row['version']}")
    return {"version": int(row["version"]), "min_score": float(row["min_decision_score"]),
            "max_score": float(row["max_decision_score"])}
