"""Alerting: severity, channel fan-out, payloads, delivery log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.functions import exprs as X
from riskflow.schema import SCORED_COLUMNS


def with_severity(scored: DataFrame, **thresholds) -> DataFrame:
    """R10 + R11: severity per anomaly and whether it is sent out."""
    sev = X.severity("ml_anomaly_score", "amount", **thresholds)
    return (scored.withColumn("severity", F.coalesce(sev, F.lit("info")))
                  .withColumn("notify", F.col("severity").isin(C.NOTIFY_SEVERITIES)))


def fan_out(alerts: DataFrame, enabled: list[str], requested: list[str] | None = None) -> DataFrame:
    """One outbox row per (alert, channel) for high/critical alerts.

    Target channels = requested ∩ enabled (default: all enabled), in the
    fixed channel order. The channel list is a literal array, so the
    explode is a narrow per-row expansion (no join, no shuffle).
    """
    targets = [c for c in (requested or enabled) if c in enabled]
    targets = [c for c in C.CHANNELS if c in targets]
    if not targets:
        return alerts.where(F.lit(False)).withColumn("channel", F.lit(None).cast("string"))
    return (alerts.where(F.col("notify"))
                  .withColumn("channel", F.explode(F.array(*[F.lit(c) for c in targets]))))


def _fields(pairs: list[tuple[str, Column]], flag: str | None = None, flags=None,
            key: str = "title") -> Column:
    out = []
    for i, (name, value) in enumerate(pairs):
        items = [F.lit(name).alias(key), value.alias("value")]
        if flag is not None:
            items.append(F.lit(flags[i]).alias(flag))
        out.append(F.struct(*items))
    return F.array(*out)


def iso(ts: Column) -> Column:
    """ISO 8601 text of a zone-less timestamp; microseconds only where there are some."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def payload(channel: Column, sent_at: Column) -> Column:
    """JSON payload text per channel (Slack / Discord / Teams / email /
    generic webhook). ``sent_at`` (timestamp) replaces the wall clock."""
    sev = F.col("severity")
    sev_up = F.upper(sev)
    na = F.lit("N/A")
    tid = F.coalesce(F.col("transaction_id"), na)
    acc = F.coalesce(F.col("account_id"), na)
    cat = F.coalesce(F.col("merchant_category"), na)
    loc = F.coalesce(F.col("location"), na)
    ts_txt = F.coalesce(iso(F.col("timestamp")), na)
    keep = {"ignoreNullFields": "false"}
    reason = F.coalesce(F.col("alert_reason"), na)
    score_txt = X.percent_text(F.col("ml_anomaly_score"))
    amount_txt = X.money_plain(F.coalesce(F.col("amount"), F.lit(0.0)))

    def by_sev(mapping: dict) -> Column:
        e = None
        for k, v in mapping.items():
            e = F.when(sev == k, F.lit(v)) if e is None else e.when(sev == k, F.lit(v))
        return e

    title = F.concat(F.lit("\U0001F6A8 Fraud Alert - "), sev_up)
    slack = F.to_json(F.struct(
        F.concat(by_sev(C.SLACK_EMOJI), F.lit(" *Fraud Alert - "), sev_up, F.lit("*")).alias("text"),
        F.array(F.struct(
            by_sev(C.SLACK_COLORS).alias("color"),
            _fields([("Transaction ID", tid), ("Anomaly Score", score_txt), ("Amount", amount_txt),
                     ("Account ID", acc), ("Merchant Category", cat), ("Location", loc),
                     ("Timestamp", ts_txt), ("Alert Reason", reason)],
                    "short", [True, True, True, True, True, True, False, False]).alias("fields"),
            F.lit(C.ALERT_FOOTER).alias("footer"),
            F.unix_seconds(sent_at.cast("timestamp")).alias("ts"))).alias("attachments")))
    discord = F.to_json(F.struct(F.array(F.struct(
        title.alias("title"),
        by_sev(C.DISCORD_COLORS).alias("color"),
        _fields([("Transaction ID", tid), ("Anomaly Score", score_txt), ("Amount", amount_txt),
                 ("Account ID", acc), ("Category", cat), ("Location", loc), ("Alert Reason", reason)],
                "inline", [True, True, True, True, True, True, False], key="name").alias("fields"),
        iso(sent_at).alias("timestamp"),
        F.struct(F.lit(C.ALERT_FOOTER).alias("text")).alias("footer"))).alias("embeds")))
    teams = F.to_json(F.struct(
        F.lit("MessageCard").alias("@type"),
        F.lit(C.TEAMS_CONTEXT).alias("@context"),
        F.concat(F.lit("Fraud Alert - "), sev_up).alias("summary"),
        by_sev(C.TEAMS_COLORS).alias("themeColor"),
        title.alias("title"),
        F.array(F.struct(_fields([("Transaction ID", tid), ("Anomaly Score", score_txt), ("Amount", amount_txt),
                                  ("Account ID", acc), ("Category", cat), ("Location", loc),
                                  ("Alert Reason", reason)], key="name").alias("facts"))).alias("sections")))
    body = F.concat_ws("\n",
                       F.lit("High-risk fraud transaction detected:"), F.lit(""),
                       F.concat(F.lit("Transaction ID: "), tid),
                       F.concat(F.lit("Anomaly Score: "), score_txt),
                       F.concat(F.lit("Amount: "), amount_txt),
                       F.concat(F.lit("Account ID: "), acc),
                       F.concat(F.lit("Merchant Category: "), cat),
                       F.concat(F.lit("Location: "), loc),
                       F.concat(F.lit("Timestamp: "), ts_txt),
                       F.concat(F.lit("Alert Reason: "), reason), F.lit(""),
                       F.concat(F.lit("Severity: "), sev_up), F.lit(""),
                       F.lit("Please investigate immediately."))
    email = F.to_json(F.struct(F.concat(title, F.lit(": "), amount_txt).alias("subject"), body.alias("body")))
    whole = [iso(F.col(c)).alias(c) if c == "timestamp" else F.col(c) for c in SCORED_COLUMNS]
    webhook = F.to_json(F.struct(
        F.lit("fraud_alert").alias("event"), sev.alias("severity"), F.struct(*whole).alias("transaction"),
        F.col("ml_anomaly_score").alias("anomaly_score"), iso(sent_at).alias("timestamp")), keep)
    return (F.when(channel == "slack", slack).when(channel == "discord", discord)
             .when(channel == "teams", teams).when(channel == "email", email)
             .when(channel == "webhook", webhook))


def outbox(scored: DataFrame, enabled: list[str] = C.CHANNELS, requested: list[str] | None = None,
           sent_at: Column | None = None) -> DataFrame:
    """Anomalies -> OUTBOX(transaction_id, channel, severity, payload).

    Keyed by (transaction_id, channel): a replayed batch rewrites the same
    keys instead of sending twice.
    """
    sent_at = sent_at if sent_at is not None else F.col("timestamp")
    a = fan_out(with_severity(scored.where(F.col("is_anomaly") == 1)), enabled, requested)
    return a.select("transaction_id", "channel", "severity", payload(F.col("channel"), sent_at).alias("payload"))


def delivery_log(box: DataFrame, scored: DataFrame) -> DataFrame:
    """One log row per alert: severity, score, channels, count."""
    g = box.groupBy("transaction_id", "severity").agg(
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"),
        F.count(F.lit(1)).alias("n_channels"))
    return g.join(scored.select("transaction_id", "ml_anomaly_score", "timestamp"), "transaction_id", "left")


def alert_counts(log: DataFrame, window: str = "1 day") -> DataFrame:
    """Alert counts per tumbling window and severity."""
    return (log.groupBy(F.window("timestamp", window).start.alias("window_start"), "severity")
               .agg(F.count(F.lit(1)).alias("alerts")))


def ab_route(df: DataFrame, split: float = 0.1, key: str = "transaction_id") -> DataFrame:
    """Deterministic A/B routing: bucket < split*100 -> challenger 'B'."""
    b = X.ab_bucket(key)
    return df.withColumn("ab_bucket", b).withColumn(
        "model_variant", F.when(b < F.lit(int(round(split * 100))), F.lit("B")).otherwise(F.lit("A")))
