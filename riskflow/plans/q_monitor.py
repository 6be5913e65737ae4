"""Registered queries: windowed monitoring and alert rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.operators import ingest, score
from riskflow.operators import monitor as M
from riskflow.plans import views
from riskflow.plans.registry import query
from riskflow.plans.sqlparts import ARRIVAL_ORDER, REQ, VALIDATED, scored, with_base
from riskflow.session import reliable, scratch_path, ts_lit
from riskflow.sources import adapters
from riskflow.streaming import alerting

# ---------------------------------------------------------------- SQL helpers

PEV = f"""WITH {REQ},
{VALIDATED},
{scored('accepted', order=ARRIVAL_ORDER)},
pev AS (
  SELECT arrival_ts AS ts, 1 AS processed, 0 AS anomaly, 0 AS error FROM req
  UNION ALL SELECT "timestamp", 0, 1, 0 FROM scored WHERE is_anomaly = 1
  UNION ALL SELECT arrival_ts, 0, 0, 1 FROM validated WHERE reject_reason IS NOT NULL
  UNION ALL SELECT arrival_ts, 0, 0, 1 FROM ranked WHERE arrival_rank > 1)"""

RL = """rl AS (
  SELECT ts, '/api/v1/' || event_type AS endpoint,
         CASE WHEN event_type = 'purchase' THEN 'PUT' ELSE 'GET' END AS method,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status,
         value / 100.0 AS duration_s
  FROM events)"""


SPAN = (adapters.EVENTS_FROM, adapters.EVENTS_AS_OF)
ALERT_SLICES = ["2024-01-08 07:13:00", "2024-01-20 00:00:00"]


def dense_sql(name: str, src: str, interval: int, window: int, sums: dict[str, str]) -> str:
    """CTE ``name(k, <sums>)``: dense ticks, sum of buckets k-n .. k-1."""
    n = window // interval
    agg = ", ".join(f"sum({e}) AS {c}" for c, e in sums.items())
    out = ", ".join(f"CAST(COALESCE(sum(c.{c}), 0) AS BIGINT) AS {c}" for c in sums)
    return f"""{name}_c AS (SELECT epoch_us(ts) // {interval * 1_000_000} AS b, {agg} FROM {src} GROUP BY 1),
{name} AS (
  SELECT t.k, {out}
  FROM (SELECT unnest(generate_series(epoch_us(TIMESTAMP '{SPAN[0]}') // {interval * 1_000_000} + 1,
                                      epoch_us(TIMESTAMP '{SPAN[1]}') // {interval * 1_000_000})) AS k) t
  LEFT JOIN {name}_c c ON c.b BETWEEN t.k - {n} AND t.k - 1
  GROUP BY t.k)"""


def tick_sql(interval: int, k: str = "k") -> str:
    return f"make_timestamp({k} * {interval * 1_000_000})"


def le_sql(value: str, bounds: list[float]) -> str:
    whens = " ".join(f"WHEN {value} <= {float(b)!r} THEN {i}" for i, b in enumerate(bounds))
    return f"CASE {whens} ELSE {len(bounds)} END"


def bounds_list(bounds: list[float]) -> str:
    return "[" + ", ".join(repr(float(b)) for b in bounds) + "]"


def hq_sql(name: str, q: float, bounds=C.LATENCY_BUCKETS, interval: int = 30, window: int = 300) -> str:
    """CTE ``name(k, quantile)``: histogram_quantile over the request log."""
    n = window // interval
    nb = len(bounds)
    return f"""{name}_c AS (
  SELECT epoch_us(ts) // {interval * 1_000_000} AS b, {le_sql('duration_s', bounds)} AS le, count(*) AS n
  FROM rl GROUP BY 1, 2),
{name}_s AS (SELECT b + o AS k, le, sum(n) AS n FROM {name}_c, range(1, {n + 1}) r(o) GROUP BY 1, 2),
{name}_w AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY le ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                    sum(n) OVER (PARTITION BY k) AS total FROM {name}_s),
{name}_h AS (SELECT k, min(le) AS le FROM {name}_w WHERE cum >= {q} * total GROUP BY k),
{name} AS (
  SELECT w.k,
         round(CASE WHEN w.le = {nb} THEN {float(bounds[-1])!r}
                    ELSE (CASE WHEN w.le = 0 THEN 0.0 ELSE {bounds_list(bounds)}[w.le] END)
                         + ({bounds_list(bounds)}[w.le + 1] - (CASE WHEN w.le = 0 THEN 0.0 ELSE {bounds_list(bounds)}[w.le] END))
                           * ({q} * w.total - (w.cum - w.n)) / w.n END, 6) AS quantile
  FROM {name}_w w JOIN {name}_h h ON h.k = w.k AND h.le = w.le)"""


# ---------------------------------------------------------------- Spark helpers

def _pipeline(spark, d):
    """Detector activity at 30 s, from one run of the detection: requests are checked and
    stored once, and every series is built on the stored counts."""
    checked = ingest.checked(adapters.event_requests(spark, d))
    scored_rows, rejects = score.detect(checked)
    return M.pipeline_events(checked, scored_rows, rejects)


# ---------------------------------------------------------------- queries


@query("pipeline_totals", PEV + """
SELECT CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(anomaly) AS BIGINT) AS anomalies,
       CAST(sum(error) AS BIGINT) AS errors,
       round(sum(anomaly) / CAST(sum(processed) AS DOUBLE), 6) AS anomaly_ratio,
       round(sum(error) / CAST(sum(processed) AS DOUBLE), 6) AS error_ratio
FROM pev""")
def q_pipeline_totals(spark, d):
    return M.pipeline_totals(_pipeline(spark, d))


@query("rate_5m", PEV + ",\n" + dense_sql("r", "pev", 30, 300, {"processed": "processed", "anomaly": "anomaly",
                                                                    "error": "error"}) + f"""
SELECT {tick_sql(30)} AS tick, round(processed / 300.0, 6) AS processed_rate,
       round(anomaly / 300.0, 6) AS anomaly_rate, round(error / 300.0, 6) AS error_rate
FROM r""")
def q_rate_5m(spark, d):
    return M.rate_series(spark, _pipeline(spark, d), SPAN, 300, 30)


@query("increase", PEV + ",\n" + dense_sql("r", "pev", 60, 600, {"processed": "processed"}) + f"""
SELECT {tick_sql(60)} AS tick, processed AS increase FROM r""")
def q_increase(spark, d):
    return M.increase_series(spark, _pipeline(spark, d), SPAN, "processed", 600, 60)


@query("ratios", PEV + ",\n" + dense_sql("r", "pev", 60, 1800, {"anomaly": "anomaly", "processed": "processed"}) + f"""
SELECT {tick_sql(60)} AS tick, round(anomaly / NULLIF(CAST(processed AS DOUBLE), 0), 6) AS ratio FROM r""")
def q_ratios(spark, d):
    return M.ratio_series(spark, _pipeline(spark, d), SPAN, "anomaly", "processed", 1800, 60)


@query("http_error_share", f"WITH {RL},\n" + dense_sql(
    "r", "rl", 30, 300, {"err": "CAST(http_status >= 500 AS INTEGER)", "total": "1"}) + f"""
SELECT {tick_sql(30)} AS tick, round(err / NULLIF(CAST(total AS DOUBLE), 0), 6) AS ratio FROM r""")
def q_http_error_share(spark, d):
    rl = adapters.request_log(spark, d).select(
        "ts", (F.col("http_status") >= 500).cast("int").alias("err"), F.lit(1).alias("total"))
    return M.ratio_series(spark, rl, SPAN, "err", "total", 300, 30)


@query("latency_quantile", f"WITH {RL},\n" + hq_sql("h", 0.95) + f"""
SELECT {tick_sql(30)} AS tick, quantile FROM h""")
def q_latency_quantile(spark, d):
    return M.histogram_quantile(spark, adapters.request_log(spark, d), 0.95)


@query("latency_quantile_p50", f"WITH {RL},\n" + hq_sql("h", 0.5) + f"""
SELECT {tick_sql(30)} AS tick, quantile FROM h""")
def q_latency_quantile_p50(spark, d):
    return M.histogram_quantile(spark, adapters.request_log(spark, d), 0.5)


@query("latency_exact", f"""WITH {RL}
SELECT make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS window_start,
       round(quantile_cont(duration_s, 0.95), 6) AS quantile
FROM rl GROUP BY 1""")
def q_latency_exact(spark, d):
    return M.exact_percentile(adapters.request_log(spark, d), 0.95)


@query("rate_by_label", f"""WITH {RL},
c AS (SELECT epoch_us(ts) // 30000000 AS b, endpoint, count(*) AS n FROM rl GROUP BY 1, 2),
s AS (SELECT b + o AS k, endpoint, sum(n) AS n FROM c, range(1, 11) r(o) GROUP BY 1, 2)
SELECT {tick_sql(30)} AS tick, endpoint, round(n / 300.0, 6) AS rate FROM s""")
def q_rate_by_label(spark, d):
    return M.rate_by_label(adapters.request_log(spark, d), "endpoint", 300, 30)


RULE_ROWS = " UNION ALL ".join(
    f"SELECT '{r[0]}' AS name, '{r[1]}' AS metric, {r[2]} AS window_s, '{r[3]}' AS op, {float(r[4])!r} AS threshold, "
    f"{r[5]} AS for_s, '{r[6]}' AS severity, '{r[7]}' AS service, {r[8]} AS interval_s" for r in C.ALERT_RULES)

METRICS_SQL = PEV + f""",
{RL},
{dense_sql('r30', 'pev', 30, 300, {'processed': 'processed', 'anomaly': 'anomaly', 'error': 'error'})},
{dense_sql('inc', 'pev', 60, 600, {'processed': 'processed'})},
{dense_sql('sh', 'pev', 60, 1800, {'anomaly': 'anomaly', 'processed': 'processed'})},
{dense_sql('he', 'rl', 30, 300, {'err': 'CAST(http_status >= 500 AS INTEGER)', 'total': '1'})},
{hq_sql('p95', 0.95)},
metrics AS (
  SELECT 'anomaly_rate' AS metric, 30 AS interval_s, {tick_sql(30)} AS tick, round(anomaly / 300.0, 6) AS value FROM r30
  UNION ALL SELECT 'processed_rate', 30, {tick_sql(30)}, round(processed / 300.0, 6) FROM r30
  UNION ALL SELECT 'error_rate', 30, {tick_sql(30)}, round(error / 300.0, 6) FROM r30
  UNION ALL SELECT 'http_error_share', 30, {tick_sql(30)}, round(err / NULLIF(CAST(total AS DOUBLE), 0), 6) FROM he
  UNION ALL SELECT 'latency_p95', 30, {tick_sql(30)}, quantile FROM p95
  UNION ALL SELECT 'processed_increase', 60, {tick_sql(60)}, CAST(processed AS DOUBLE) FROM inc
  UNION ALL SELECT 'anomaly_share', 60, {tick_sql(60)}, round(anomaly / NULLIF(CAST(processed AS DOUBLE), 0), 6) FROM sh),
rules AS ({RULE_ROWS}),
hits AS (
  SELECT r.*, m.tick, epoch_us(m.tick) // (r.interval_s * 1000000) AS k
  FROM metrics m JOIN rules r ON r.metric = m.metric AND r.interval_s = m.interval_s
  WHERE COALESCE(CASE r.op WHEN '>' THEN m.value > r.threshold WHEN '<' THEN m.value < r.threshold
                           WHEN '==' THEN m.value = r.threshold WHEN '>=' THEN m.value >= r.threshold
                           WHEN '<=' THEN m.value <= r.threshold ELSE false END, false)),
isl AS (
  SELECT name, severity, service, for_s, min(tick) AS active_start, max(tick) AS active_end
  FROM (SELECT *, k - row_number() OVER (PARTITION BY name ORDER BY k) AS grp FROM hits)
  GROUP BY name, severity, service, for_s, interval_s, grp),
intervals AS (
  SELECT name AS alertname, severity, service, active_start,
         active_start + to_seconds(for_s) AS firing_start, active_end AS firing_end
  FROM isl WHERE epoch_us(active_end) - epoch_us(active_start) >= for_s * 1000000)"""


def _metrics(spark, d):
    """All rule metrics from two small cached bucket tables (pipeline events
    at 30 s, request log at 30 s); 60 s series are re-bucketed from 30 s."""
    ev = _pipeline(spark, d)
    rl = adapters.request_log(spark, d)
    c30 = reliable(M.bucket_counts(ev, 30, {c: F.col(c) for c in ("processed", "anomaly", "error")}))
    c60 = M.rebucket(c30, 2, ["processed", "anomaly"])
    d30 = M.dense(spark, c30, 300, 30, ["processed", "anomaly", "error"], SPAN)
    inc = M.dense(spark, c60, 600, 60, ["processed"], SPAN)
    sh = M.dense(spark, c60, 1800, 60, ["anomaly", "processed"], SPAN)
    h30 = M.bucket_counts(rl.select("ts", (F.col("http_status") >= 500).cast("int").alias("err"),
                                    F.lit(1).alias("total")), 30, {"err": F.col("err"), "total": F.col("total")})
    he = M.dense(spark, h30, 300, 30, ["err", "total"], SPAN)
    p95 = M.histogram_quantile(spark, rl, 0.95)

    def series(df, name, interval, value):
        return df.select(F.lit(name).alias("metric"), F.lit(interval).alias("interval_s"),
                         M.tick_ts(F.col("k"), interval).alias("tick"), value.cast("double").alias("value"))
    rate = lambda c: F.round(F.col(c) / F.lit(300.0), 6)
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return (series(d30, "anomaly_rate", 30, rate("anomaly"))
            .unionByName(series(d30, "processed_rate", 30, rate("processed")))
            .unionByName(series(d30, "error_rate", 30, rate("error")))
            .unionByName(series(he, "http_error_share", 30, ratio("err", "total")))
            .unionByName(p95.select(F.lit("latency_p95").alias("metric"), F.lit(30).alias("interval_s"), "tick",
                                    F.col("quantile").cast("double").alias("value")))
            .unionByName(series(inc, "processed_increase", 60, F.col("processed")))
            .unionByName(series(sh, "anomaly_share", 60, ratio("anomaly", "processed"))))


@query("alert_intervals", METRICS_SQL + "\nSELECT * FROM intervals")
def q_alert_intervals(spark, d):
    return M.alert_intervals(_metrics(spark, d), M.rules_frame(spark))


@query("active_alerts", METRICS_SQL + """
SELECT alertname, severity, count(*) AS firing_intervals,
       CAST(sum((epoch_us(firing_end) - epoch_us(firing_start)) / 1000000) AS BIGINT) AS firing_seconds
FROM intervals GROUP BY 1, 2""")
def q_active_alerts(spark, d):
    return M.active_alerts(M.alert_intervals(_metrics(spark, d), M.rules_frame(spark)))


@query("stream_alerts", METRICS_SQL + "\nSELECT * FROM intervals")
def q_stream_alerts(spark, d):
    """W4 in the stream: the samples arrive in slices of time, each a run that continues the alert states of those before."""
    root = scratch_path(spark, f"alerts-{uuid.uuid4().hex[:12]}")
    samples, rules = reliable(_metrics(spark, d).withColumn("interval_s", F.col("interval_s").cast("int"))), M.rules_frame(spark)
    past = F.to_timestamp_ntz(F.lit(SPAN[1])) + F.expr("INTERVAL 1 DAY")
    end = spark.range(1).select(F.lit("processed_rate").alias("metric"), F.lit(30).alias("interval_s"), past.alias("tick"), F.lit(None).cast("double").alias("value"))
    at = F.col("tick")
    for lo, hi in zip([None, *ALERT_SLICES], [*ALERT_SLICES, None]):
        part = samples.where((at >= ts_lit(lo) if lo else F.lit(True)) & (at < ts_lit(hi) if hi else F.lit(True)))
        (part if hi else part.unionByName(end)).write.mode("append").parquet(f"{root}/samples")
        stream = spark.readStream.schema(alerting.SAMPLE).parquet(f"{root}/samples")
        alerting.start(stream, rules, f"{root}/states", f"{root}/checkpoint").awaitTermination()
    return alerting.resolved(spark.read.schema(alerting.STATES).parquet(f"{root}/states"))


@query("score_histogram", with_base("""SELECT CASE WHEN ml_anomaly_score < 0.0 THEN 0 WHEN ml_anomaly_score >= 1.0 THEN 11
            ELSE CAST(floor((ml_anomaly_score - 0.0) / 0.1) AS INTEGER) + 1 END AS bin, count(*) AS n
FROM scored WHERE ml_anomaly_score IS NOT NULL GROUP BY 1"""))
def q_score_histogram(spark, d):
    return M.width_histogram(views.scored(spark, d), "ml_anomaly_score", 0.0, 1.0, 10)


@query("duration_histogram", f"""WITH {RL}
SELECT CASE WHEN le_idx = {len(C.PROCESSING_BUCKETS)} THEN '+Inf'
            ELSE {"[" + ", ".join("'" + str(b) + "'" for b in C.PROCESSING_BUCKETS) + "]"}[le_idx + 1] END AS le,
       le_idx, n
FROM (SELECT {le_sql('duration_s', C.PROCESSING_BUCKETS)} AS le_idx, count(*) AS n FROM rl GROUP BY 1)""")
def q_duration_histogram(spark, d):
    return M.value_histogram(adapters.request_log(spark, d), "duration_s", C.PROCESSING_BUCKETS)


@query("hit_rate", """
SELECT '/api/v1/' || event_type AS endpoint, count(*) FILTER (WHERE k < 75) AS hits, count(*) FILTER (WHERE k >= 75) AS misses,
       round(count(*) FILTER (WHERE k < 75) * 100.0 / count(*), 4) AS hit_rate_pct
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def q_hit_rate(spark, d):
    return M.hit_rate(adapters.cache_counters(spark, d), by=("endpoint",))


@query("rolling_rate", PEV + ",\n" + dense_sql("r", "pev", 30, 300, {"processed": "processed"}) + f"""
SELECT {tick_sql(30)} AS tick, round(processed / 300.0, 6) AS rate,
       round(CAST(sum(processed) OVER (ORDER BY k ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS DOUBLE)
             / (least(k - (SELECT min(k) FROM r) + 1, 120) * 300.0), 6) AS rate_mean_1h
FROM r""")
def q_rolling_rate(spark, d):
    return M.rolling_mean_rate(spark, _pipeline(spark, d), SPAN, "processed", 300, 30, 3600)


@query("rate_max_24h", PEV + ",\n" + dense_sql("r", "pev", 30, 300, {"processed": "processed"}) + f"""
SELECT {tick_sql(30)} AS tick, max(round(processed / 300.0, 6)) OVER (ORDER BY k ROWS BETWEEN 2879 PRECEDING AND CURRENT ROW) AS max_rate
FROM r""")
def q_rate_max_24h(spark, d):
    s = M.rate_series(spark, _pipeline(spark, d), SPAN, 300, 30, ("processed",))
    return M.trailing_max(s.withColumnRenamed("processed_rate", "rate"), "rate")


@query("rate_daily_max", PEV + ",\n" + dense_sql("r", "pev", 30, 300, {"processed": "processed"}) + f"""
SELECT date_trunc('day', {tick_sql(30)}) AS day, max(round(processed / 300.0, 6)) AS max_rate FROM r GROUP BY 1""")
def q_rate_daily_max(spark, d):
    s = M.rate_series(spark, _pipeline(spark, d), SPAN, 300, 30, ("processed",))
    return M.daily_max(s.withColumnRenamed("processed_rate", "rate"), "rate")
