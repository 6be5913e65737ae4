"""Windowed monitoring over event tables.

Metric series are evaluated on a tick grid (every ``interval_s`` seconds,
as a rule group would). ``rate(x[w])`` = events in [t - w, t) / w.

Every series starts as a partial aggregate per (interval bucket[, label]):
its size is (time span / interval), independent of the data volume. A
sliding window is then built by exploding each *bucket row* into the
ticks it contributes to, and summing per tick (a distributed group-by,
no global sort). Dense ticks come from ``spark.range`` so empty windows
count as zero.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.operators.common import distributed_prefix, exclusive_prefix


def epoch_us(ts: str = "ts") -> Column:
    """Microseconds since the epoch of a zone-less timestamp (session TZ is UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def bucket_of(ts: str, interval_s: int) -> Column:
    return F.floor(epoch_us(ts) / F.lit(interval_s * 1_000_000)).cast("long")


def tick_ts(k: Column, interval_s: int) -> Column:
    return F.timestamp_seconds(k * F.lit(interval_s)).cast("timestamp_ntz")


def bucket_counts(events: DataFrame, interval_s: int, sums: dict[str, Column],
                  labels: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Partial aggregate per (bucket[, labels]) -- the only pass over the raw events."""
    return (events.groupBy(bucket_of(ts, interval_s).alias("b"), *(labels or []))
                  .agg(*[F.sum(v).alias(k) for k, v in sums.items()]))


def steps(window_s: int, interval_s: int) -> int:
    """Ticks of a window; a window that is no multiple of the interval is an error."""
    if window_s % interval_s:
        raise ValueError(f"a window of {window_s} s is no multiple of {interval_s} s")
    return window_s // interval_s


def sliding(counts: DataFrame, window_s: int, interval_s: int, cols: list[str],
            labels: list[str] | None = None) -> DataFrame:
    """Per tick k: sum of buckets k-n .. k-1 (n = window / interval)."""
    n = steps(window_s, interval_s)
    e = counts.withColumn("k", F.explode(F.sequence(F.col("b") + 1, F.col("b") + n)))
    return e.groupBy("k", *(labels or [])).agg(*[F.sum(c).alias(c) for c in cols])


def rebucket(counts: DataFrame, factor: int, cols: list[str]) -> DataFrame:
    """Coarser buckets from finer ones (e.g. 60 s from 30 s): no new pass
    over the events."""
    return (counts.groupBy(F.floor(F.col("b") / factor).cast("long").alias("b"))
                  .agg(*[F.sum(c).alias(c) for c in cols]))


def tick_range(spark: SparkSession, span: tuple[str, str], interval_s: int) -> DataFrame:
    """Dense ticks after ``span[0]`` up to ``span[1]`` (UTC). The grid is an argument, not
    taken from the data: one event with a wild date would make billions of ticks."""
    lo, hi = (int(datetime.fromisoformat(t).replace(tzinfo=timezone.utc).timestamp()) // interval_s for t in span)
    return spark.range(lo + 1, hi + 1).withColumnRenamed("id", "k")


def dense(spark: SparkSession, counts: DataFrame, window_s: int, interval_s: int, cols: list[str], span: tuple[str, str]) -> DataFrame:
    """Dense per-tick window sums over ``span``; 0 where nothing happened."""
    out = tick_range(spark, span, interval_s).join(sliding(counts, window_s, interval_s, cols), "k", "left")
    return out.select("k", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])


# ---------------------------------------------------------------- event tables

def pipeline_events(requests: DataFrame, scored: DataFrame, rejects: DataFrame) -> DataFrame:
    """Detector activity as events: every request is processed (at arrival),
    accepted anomalies and rejects (errors) are events too."""
    p = requests.select(F.col("arrival_ts").alias("ts"), F.lit(1).alias("processed"),
                        F.lit(0).alias("anomaly"), F.lit(0).alias("error"))
    a = scored.where(F.col("is_anomaly") == 1).select(F.col("timestamp").alias("ts"), F.lit(0).alias("processed"),
                                                      F.lit(1).alias("anomaly"), F.lit(0).alias("error"))
    e = rejects.select(F.col("arrival_ts").alias("ts"), F.lit(0).alias("processed"),
                       F.lit(0).alias("anomaly"), F.lit(1).alias("error"))
    return p.unionByName(a).unionByName(e)


def pipeline_totals(ev: DataFrame) -> DataFrame:
    """Processed / anomalies / errors and their ratios."""
    p, a, e = F.sum("processed"), F.sum("anomaly"), F.sum("error")
    return ev.agg(p.alias("processed"), a.alias("anomalies"), e.alias("errors"),
                  F.round(F.try_divide(a.cast("double"), p), 6).alias("anomaly_ratio"),
                  F.round(F.try_divide(e.cast("double"), p), 6).alias("error_ratio"))


# ---------------------------------------------------------------- series

def rate_series(spark, ev: DataFrame, span: tuple[str, str], window_s: int = 300, interval_s: int = 30,
                cols: tuple[str, ...] = ("processed", "anomaly", "error")) -> DataFrame:
    """Per-second rates over the window at every tick (dense)."""
    counts = bucket_counts(ev, interval_s, {c: F.col(c) for c in cols})
    d = dense(spark, counts, window_s, interval_s, list(cols), span)
    return d.select(tick_ts(F.col("k"), interval_s).alias("tick"),
                    *[F.round(F.col(c) / F.lit(float(window_s)), 6).alias(f"{c}_rate") for c in cols])


def increase_series(spark, ev: DataFrame, span: tuple[str, str], col: str = "processed", window_s: int = 600,
                    interval_s: int = 60) -> DataFrame:
    """Events in the window at every tick (no division)."""
    counts = bucket_counts(ev, interval_s, {col: F.col(col)})
    d = dense(spark, counts, window_s, interval_s, [col], span)
    return d.select(tick_ts(F.col("k"), interval_s).alias("tick"), F.col(col).cast("long").alias("increase"))


def ratio_series(spark, ev: DataFrame, span: tuple[str, str], num: str, den: str, window_s: int, interval_s: int) -> DataFrame:
    """sum(rate(num)) / sum(rate(den)); NULL where the denominator is 0."""
    counts = bucket_counts(ev, interval_s, {num: F.col(num), den: F.col(den)})
    d = dense(spark, counts, window_s, interval_s, [num, den], span)
    return d.select(tick_ts(F.col("k"), interval_s).alias("tick"),
                    F.round(F.try_divide(F.col(num).cast("double"), F.col(den)), 6).alias("ratio"))


def rate_by_label(ev: DataFrame, label: str, window_s: int = 300, interval_s: int = 30) -> DataFrame:
    """Sum by (label) (rate(x[w])): one series per label value (sparse:
    ticks where the label had events inside the window)."""
    counts = bucket_counts(ev.withColumn("_one", F.lit(1)), interval_s, {"n": F.col("_one")}, [label])
    s = sliding(counts, window_s, interval_s, ["n"], [label])
    return s.select(tick_ts(F.col("k"), interval_s).alias("tick"), label,
                    F.round(F.col("n") / F.lit(float(window_s)), 6).alias("rate"))


def le_index(value: Column, bounds: list[float]) -> Column:
    """Index of the first bucket with value <= bound (len(bounds) = +Inf)."""
    e = None
    for i, b in enumerate(bounds):
        e = F.when(value <= b, F.lit(i)) if e is None else e.when(value <= b, F.lit(i))
    return e.otherwise(F.lit(len(bounds)))


def histogram_quantile(spark, requests: DataFrame, q: float, value: str = "duration_s",
                       bounds: list[float] = C.LATENCY_BUCKETS, window_s: int = 300,
                       interval_s: int = 30) -> DataFrame:
    """histogram_quantile(q, rate(bucket[w])) per tick.

    Linear interpolation inside the bucket that holds rank q·total; when
    that bucket is +Inf the upper bound of the last finite bucket is
    returned. NULL (no value) where the window is empty.
    """
    r = requests.withColumn("le", le_index(F.col(value), bounds)).withColumn("_one", F.lit(1))
    counts = bucket_counts(r, interval_s, {"n": F.col("_one")}, ["le"])
    s = sliding(counts, window_s, interval_s, ["n"], ["le"])
    w = Window.partitionBy("k").orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    s = (s.withColumn("cum", F.sum("n").over(w))
          .withColumn("total", F.sum("n").over(Window.partitionBy("k"))))
    rank = F.lit(q) * F.col("total")
    hit = (s.where(F.col("cum") >= rank)
            .groupBy("k").agg(F.min_by(F.struct("le", "n", "cum", "total"), F.col("le")).alias("h"))
            .select("k", "h.*"))
    ub = F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.col("le") + 1)
    lb = F.when(F.col("le") == 0, F.lit(0.0)).otherwise(
        F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.col("le")))
    prev = F.col("cum") - F.col("n")
    val = F.when(F.col("le") == len(bounds), F.lit(float(bounds[-1]))).otherwise(
        lb + (ub - lb) * (rank - prev) / F.col("n"))
    return hit.select(tick_ts(F.col("k"), interval_s).alias("tick"), F.round(val, 6).alias("quantile"))


def exact_percentile(requests: DataFrame, q: float, value: str = "duration_s", window: str = "5 minutes") -> DataFrame:
    """N4 (exact variant): percentile per tumbling window (linear interpolation).

    From the counts of distinct values and their running sums, so that no task holds the
    values of a window: the percentile lies between the values at the ranks below and
    above q * (n - 1).
    """
    start = F.window(F.col("ts").cast("timestamp"), window).start.cast("timestamp_ntz").alias("window_start")
    counts = requests.where(F.col(value).isNotNull()).groupBy(start, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("window_start").agg(((F.sum("n") - 1) * F.lit(float(q))).alias("p"))
    c = distributed_prefix(counts, ["v"], ["n"], ["window_start"], inclusive=True).join(totals, "window_start")
    lo, hi = (F.min(F.when(F.col("cum_n") > f(F.col("p")), F.col("v"))) for f in (F.floor, F.ceil))
    return c.groupBy("window_start").agg(F.round(lo + (F.first("p") - F.floor(F.first("p"))) * (hi - lo), 6).alias("quantile"))


def hit_rate(counters: DataFrame, hits: str = "hits", misses: str = "misses", by: tuple[str, ...] = ()) -> DataFrame:
    """Hit rate % over given hit and miss counters; 0 when there were no reads."""
    h, m = F.coalesce(F.sum(hits), F.lit(0)), F.coalesce(F.sum(misses), F.lit(0))
    agg = counters.groupBy(*by).agg(h.alias("hits"), m.alias("misses"))
    total = F.col("hits") + F.col("misses")
    return agg.select(*by, "hits", "misses", F.round(F.coalesce(F.try_divide(F.col("hits") * 100.0, total), F.lit(0.0)), 4).alias("hit_rate_pct"))


def value_histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative-style histogram counts (le buckets incl. +Inf)."""
    g = df.where(F.col(value).isNotNull()).groupBy(le_index(F.col(value), bounds).alias("le_idx")).agg(
        F.count(F.lit(1)).alias("n"))
    le = F.when(F.col("le_idx") == len(bounds), F.lit("+Inf")).otherwise(
        F.element_at(F.array(*[F.lit(str(b)) for b in bounds]), F.col("le_idx") + 1))
    return g.select(le.alias("le"), "le_idx", "n")


def width_histogram(df: DataFrame, value: str, lo: float = 0.0, hi: float = 1.0, bins: int = 10) -> DataFrame:
    """Equal-width bins (values outside go to bins 0 / bins+1)."""
    v = F.col(value)
    b = (F.when(v < lo, F.lit(0)).when(v >= hi, F.lit(bins + 1))
          .otherwise(F.floor((v - lo) / F.lit((hi - lo) / bins)).cast("int") + 1))
    return df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- rules

def rules_frame(spark: SparkSession, rules=C.ALERT_RULES) -> DataFrame:
    from riskflow.schema import ALERT_RULE
    return spark.createDataFrame([tuple(r) for r in rules], ALERT_RULE)


def condition(value: Column, op: Column, threshold: Column) -> Column:
    return (F.when(op == ">", value > threshold).when(op == "<", value < threshold)
             .when(op == "==", value == threshold).when(op == ">=", value >= threshold)
             .when(op == "<=", value <= threshold).otherwise(F.lit(False)))


def alert_intervals(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """N6 + W4: rule firing intervals.

    ``metrics``: (metric, interval_s, tick, value). A rule's condition is
    evaluated at its ticks; consecutive true ticks form an island
    (tick index minus its rank among true ticks is constant on an island);
    an island whose span reaches the rule's ``for:`` duration fires from
    start + for until its last true tick. A rule's true ticks meet in one task: their
    number is bounded by the time span over the interval, not by the data.
    """
    j = metrics.join(rules, ["metric", "interval_s"])
    j = j.where(F.coalesce(condition(F.col("value"), F.col("op"), F.col("threshold")), F.lit(False)))
    k = F.floor(epoch_us("tick") / (F.col("interval_s") * F.lit(1_000_000))).cast("long")
    j = j.withColumn("k", k)
    w = Window.partitionBy("name").orderBy("k")
    j = j.withColumn("grp", F.col("k") - F.row_number().over(w))
    isl = j.groupBy("name", "severity", "service", "for_s", "interval_s", "grp").agg(
        F.min("tick").alias("active_start"), F.max("tick").alias("active_end"))
    span = (epoch_us("active_end") - epoch_us("active_start")) / 1_000_000
    return (isl.where(span >= F.col("for_s"))
               .select(F.col("name").alias("alertname"), "severity", "service", "active_start",
                       (F.col("active_start") + F.make_dt_interval(secs=F.col("for_s"))).alias("firing_start"),
                       F.col("active_end").alias("firing_end")))


def active_alerts(intervals: DataFrame) -> DataFrame:
    """Firing intervals and firing seconds per alert name."""
    dur = (epoch_us("firing_end") - epoch_us("firing_start")) / 1_000_000
    return intervals.groupBy("alertname", "severity").agg(
        F.count(F.lit(1)).alias("firing_intervals"), F.sum(dur).cast("long").alias("firing_seconds"))


def rolling_mean_rate(spark, ev: DataFrame, span: tuple[str, str], col: str = "processed", window_s: int = 300,
                      interval_s: int = 30, over_s: int = 3600) -> DataFrame:
    """avg_over_time(rate(x[5m])[1h:]) at every tick.

    mean of the last m tick rates = (S(t) - S(t-m)) / (window · n) with S the
    inclusive prefix sum of the (integer) window counts and n the ticks
    seen (m once a full hour exists). S is a two-level prefix (day
    buckets) and S(t-m) an equi-join on the tick index, so no task ever
    holds the whole series and the result is an exact integer quotient.
    """
    m = steps(over_s, interval_s)
    counts = bucket_counts(ev, interval_s, {col: F.col(col)})
    d = dense(spark, counts, window_s, interval_s, [col], span)
    ticks_per_day = steps(86400, interval_s)
    p = exclusive_prefix(d.select("k", F.col(col).alias("c")), "k", ["c"],
                         F.floor(F.col("k") / ticks_per_day), inclusive=True)
    p = p.select("k", "c", F.col("cum_c").alias("S"))
    back = p.select((F.col("k") + m).alias("k"), F.col("S").alias("S_back"))
    lo = d.agg(F.min("k")).scalar()
    j = p.join(back, "k", "left")
    n_seen = F.least(F.col("k") - lo + 1, F.lit(m))
    mean = (F.col("S") - F.coalesce(F.col("S_back"), F.lit(0))) / (n_seen * F.lit(float(window_s)))
    return j.select(tick_ts(F.col("k"), interval_s).alias("tick"),
                    F.round(F.col("c") / F.lit(float(window_s)), 6).alias("rate"),
                    F.round(mean, 6).alias("rate_mean_1h"))


def trailing_max(series: DataFrame, col: str = "rate", over_s: int = 86400, interval_s: int = 30) -> DataFrame:
    """max_over_time(series[24h]) at every tick of a dense series (tick, col).

    The ticks fall into blocks of one window. The last m ticks span the end of one block
    and the start of the next, so a running maximum from each block's start, one from
    its end, and a join m - 1 ticks back give the maximum; no task holds more than a block.
    """
    m = steps(over_s, interval_s)
    k = F.floor(epoch_us("tick") / F.lit(interval_s * 1_000_000)).cast("long")
    t = series.select("tick", F.col(col).alias("v"), k.alias("k")).withColumn("blk", F.floor(F.col("k") / m))
    up = Window.partitionBy("blk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("blk").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("tick", "k", F.max("v").over(up).alias("head"), F.max("v").over(down).alias("tail"))
    back = t.select((F.col("k") + m - 1).alias("k"), F.col("tail").alias("before"))
    # a tick in the first window has no tick m - 1 back: the block before, as far as it goes, counts whole
    first = t.agg(F.min("k")).scalar()
    from_start = t.agg(F.min_by("tail", "k")).scalar()
    later = F.floor(F.col("k") / m) > F.floor(first / m)
    return (t.join(back, "k", "left")
             .select("tick", F.greatest("head", F.coalesce("before", F.when(later, from_start))).alias(f"max_{col}")))


def daily_max(series: DataFrame, col: str = "rate") -> DataFrame:
    """Max of a series per 24 h (tumbling)."""
    return series.groupBy(F.date_trunc("day", "tick").alias("day")).agg(F.max(col).alias(f"max_{col}"))
