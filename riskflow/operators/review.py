"""Review queue, status updates and dashboard KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.functions import exprs as X
from riskflow.session import reliable
from riskflow.sources.tables import replace_folders


def check_page_args(limit: int = 100, offset: int = 0, min_score: float | None = None,
                    status: str | None = None) -> None:
    """argument checks before any plan is built."""
    if not (1 <= int(limit) <= 1000):
        raise ValueError("limit must be within 1..1000")
    if int(offset) < 0:
        raise ValueError("offset must be >= 0")
    if min_score is not None and not (0.0 <= float(min_score) <= 1.0):
        raise ValueError("min_score must be within 0..1")
    if status is not None and status not in C.STATUSES:
        raise ValueError(f"status must be one of {C.STATUSES}")


def anomalies_filtered(scored: DataFrame, min_score: float | None = None,
                       status: str | None = None) -> DataFrame:
    """F2: is_anomaly = 1 [and score >= min] [and status = X].

    Runs before the NULL -> NEW fill, so a NULL status never matches NEW.
    """
    df = scored.where(F.col("is_anomaly") == 1)
    if min_score is not None:
        df = df.where(F.col("ml_anomaly_score") >= F.lit(float(min_score)))
    if status is not None:
        df = df.where(F.col("status") == F.lit(status.upper()))
    return df


def normalise_status(df: DataFrame) -> DataFrame:
    """status NULL -> NEW and upper-cased; timestamp rendered as text; a score that
    is no number becomes NULL."""
    if "ml_anomaly_score" in df.columns:
        df = df.withColumn("ml_anomaly_score", F.col("ml_anomaly_score").try_cast("double"))
    return (df.withColumn("status", F.upper(F.coalesce(F.col("status"), F.lit("NEW"))))
              .withColumn("timestamp", F.date_format(F.col("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def top_anomalies(scored: DataFrame, limit: int = 100, offset: int = 0,
                  min_score: float | None = None, status: str | None = None) -> DataFrame:
    """Score DESC NULLS LAST, tie-break on id, OFFSET/LIMIT.

    Plans as TakeOrderedAndProject: every task keeps only its top
    (offset + limit) rows, so nothing unbounded reaches a single task.
    """
    check_page_args(limit, offset, min_score, status)
    df = anomalies_filtered(scored, min_score, status)
    ordered = df.orderBy(F.col("ml_anomaly_score").desc_nulls_last(), F.col("transaction_id"))
    if offset:
        ordered = ordered.offset(int(offset))
    return ordered.limit(int(limit))


def latest_transactions(df: DataFrame, n: int = 10) -> DataFrame:
    """Newest first, top n."""
    return df.orderBy(F.col("timestamp").desc(), F.col("transaction_id").desc()).limit(int(n))


def winning_updates(updates: DataFrame, key: str = "transaction_id", order: str | None = None) -> DataFrame:
    """One (key, new_status) an id: the last by ``order`` among the known statuses (without an
    order column the greatest status)."""
    new = F.upper(F.col("new_status"))
    rank = F.struct(*([F.col(order)] if order else []), new.alias("_s"))
    return updates.where(new.isin(list(C.STATUSES))).groupBy(key).agg(F.max_by("new_status", rank).alias("new_status"))


def status_update(base: DataFrame, updates: DataFrame, key: str = "transaction_id", order: str | None = None):
    """Keyed update of ``status`` (upper-cased) for any matching row.

    Of several updates for one id the last by ``order`` counts (without an order
    column the greatest status, so that the result is always the same). Statuses
    outside the domain change nothing and come back as the last frame.
    Returns (updated table, matched updates, unmatched ids, invalid updates).
    The update set is joined by key: AQE broadcasts it when its measured
    size is small, else both sides shuffle on the key.
    """
    new = F.upper(F.col("new_status"))
    known = F.coalesce(new.isin(list(C.STATUSES)), F.lit(False))
    invalid = updates.where(~known)
    updates = winning_updates(updates, key, order)
    u = updates.select(F.col(key), F.upper(F.col("new_status")).alias("_new"))
    updated = (base.join(u, key, "left")
                   .withColumn("status", F.coalesce(F.col("_new"), F.col("status")))
                   .drop("_new"))
    matched = updates.join(base.select(key), key, "left_semi")
    unmatched = updates.join(base.select(key), key, "left_anti")
    return updated, matched, unmatched, invalid


def update_months(spark: SparkSession, path: str, updates: DataFrame, key: str = "transaction_id", order: str | None = None) -> list[str]:
    """J5 on a table stored by month (S10): the ids' months are found by a scan of the key alone, and only those are
    read and rewritten. Returns the months touched."""
    ids = reliable(updates.where(F.upper("new_status").isin(list(C.STATUSES))).select(key).distinct())
    months = spark.read.parquet(path).select(key, "year", "month").join(ids, key, "left_semi")
    return replace_folders(spark, path, ["year", "month"], months, lambda rows: status_update(rows, updates, key, order)[0],
                           ["timestamp", key])


def review_queue(anoms: DataFrame, amount_range: tuple[float, float] | None = None,
                 reason: str = "All", statuses: list[str] | None = None) -> DataFrame:
    """amount in [lo, hi]; reason unless 'All'; status in list unless 'All'.

    Defaults follow the dashboard: the range is [min, max] of the queue
    itself, statuses NEW + INVESTIGATED.
    """
    df = normalise_status(anoms)
    if amount_range is None:                      # [min, max] of the queue: every row that has an amount
        df = df.where(F.col("amount").isNotNull())
    else:
        df = df.where(F.col("amount").between(float(amount_range[0]), float(amount_range[1])))
    if reason != "All":
        df = df.where(F.col("alert_reason") == reason)
    statuses = ["NEW", "INVESTIGATED"] if statuses is None else statuses
    if "All" not in statuses:
        df = df.where(F.col("status").isin([s.upper() for s in statuses]))
    return df


def high_risk_open(anoms: DataFrame) -> DataFrame:
    """open high-risk alerts: score >= 0.8 and status NEW (after fill)."""
    df = normalise_status(anoms)
    return df.where((F.coalesce(F.col("ml_anomaly_score"), F.lit(0.0)) >= C.RISK_HIGH)
                    & (F.col("status") == "NEW"))


def kpis(scored: DataFrame) -> DataFrame:
    """Total transactions, total anomalies, anomaly rate % (0 if empty),
    in one aggregate pass."""
    total = F.count(F.lit(1))
    n_anom = F.count_if(F.col("is_anomaly") == 1)
    return scored.agg(
        total.alias("total_transactions"),
        n_anom.alias("total_anomalies"),
        F.round(F.coalesce(F.try_divide(n_anom * 100.0, total), F.lit(0.0)), 4).alias("anomaly_rate_pct"))


def by_category(anoms: DataFrame) -> DataFrame:
    """Active (not DISMISSED) anomalies per category, count desc."""
    df = normalise_status(anoms).where(F.col("status") != "DISMISSED")
    return (df.groupBy("merchant_category").agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), "merchant_category"))


def by_status(anoms: DataFrame) -> DataFrame:
    """A10: anomalies per status, count desc."""
    return (normalise_status(anoms).groupBy("status").agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), "status"))


def filter_values(anoms: DataFrame) -> DataFrame:
    """The sidebar's option lists and the amount range, one row."""
    df = normalise_status(anoms)
    return df.agg(F.array_sort(F.collect_set("alert_reason")).alias("reasons"),
                  F.array_sort(F.collect_set("status")).alias("statuses"),
                  F.min("amount").alias("min_amount"),
                  F.max("amount").alias("max_amount"))


def anomaly_count(scored: DataFrame) -> DataFrame:
    """A12."""
    return scored.where(F.col("is_anomaly") == 1).agg(F.count(F.lit(1)).alias("count"))


def display_row(df: DataFrame) -> DataFrame:
    """Risk band, score text, money text, minute-resolution time."""
    s = F.coalesce(F.col("ml_anomaly_score"), F.lit(0.0))
    return df.select(
        "transaction_id",
        X.risk_band().alias("risk_band"),
        F.concat(X.fixed(s, 3), F.lit(" ("), X.risk_band(), F.lit(")")).alias("score_text"),
        X.money_text().alias("amount_text"),
        X.minute_text().alias("time_text"),
    )


def display_columns(columns: list[str]) -> list[str]:
    """Column names in title case for display ('alert_reason' -> 'Alert Reason')."""
    return [c.replace("_", " ").title() for c in columns]
