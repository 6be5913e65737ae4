"""Alert states in the stream: the batch intervals under any cut, open alerts, timers without samples."""
import os
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from riskflow.operators import monitor as M
from riskflow.schema import ALERT_RULE
from riskflow.streaming import alerting

RULES = [("High", "m", 300, ">", 1.0, 60, "critical", "svc", 30),
         ("Now", "m", 300, ">", 2.0, 0, "info", "svc", 30),
         ("Odd", "m", 300, "<", 0.5, 45, "warning", "svc", 30),
         ("Slow", "n", 600, "==", 0.0, 120, "warning", "svc", 60)]
T0 = datetime(2024, 3, 1)


def _samples(seed, n=240):
    rng = np.random.default_rng(seed)
    level = 0.0
    rows = []
    for i in range(n):
        if rng.random() < 0.2:
            level = float(rng.choice([0.0, 0.4, 1.0, 1.5, 3.0]))
        if rng.random() < 0.95:                                   # some samples never come
            rows.append(("m", 30, T0 + timedelta(seconds=30 * i), None if rng.random() < 0.03 else level))
        if i % 2 == 0:
            rows.append(("n", 60, T0 + timedelta(seconds=30 * i), float(rng.integers(0, 2) if level else 0)))
    return rows


def _run(spark, tmp, name, batches, rules):
    src, out = os.path.join(tmp, name), os.path.join(tmp, name + "-out")
    for b in batches:
        spark.createDataFrame(b, alerting.SAMPLE).coalesce(1).write.mode("append").parquet(src)
        alerting.start(spark.readStream.schema(alerting.SAMPLE).parquet(src), rules, out, out + "-ckpt", "5 minutes").awaitTermination()
    return spark.read.schema(alerting.STATES).parquet(out)


def _rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_intervals_under_any_cut(spark, tmp_dir):
    rules = spark.createDataFrame(RULES, ALERT_RULE)
    rows = _samples(1)
    end = [("m", 30, T0 + timedelta(days=1), None)]
    want = _rows(M.alert_intervals(spark.createDataFrame(rows, alerting.SAMPLE), rules))
    assert {r[1] for r in want} == {r[0] for r in RULES}           # every rule fires at some time
    rng = np.random.default_rng(7)
    for name, cuts in (("one", []), ("few", [50, 51, 200])):
        parts = []
        for part in np.split(np.arange(len(rows)), cuts):
            parts.append([rows[i] for i in part] + [rows[i] for i in part[:5]])        # repeated samples
        parts[-1] = sorted(parts[-1], key=lambda r: rng.random())                      # any order inside a batch
        states = _run(spark, tmp_dir, name, [*parts, end], rules)
        assert _rows(alerting.resolved(states)) == want
        assert alerting.firing(states).count() == 0
        assert states.where("state = 'firing'").count() == len(want)


def test_late_order_within_the_delay(spark, tmp_dir):
    rules = spark.createDataFrame(RULES, ALERT_RULE)
    rows = _samples(2, 120)
    rng = np.random.default_rng(3)
    mixed = sorted(rows, key=lambda r: r[2] + timedelta(seconds=float(rng.uniform(0, 290))))
    end = [("m", 30, T0 + timedelta(days=1), None)]
    states = _run(spark, tmp_dir, "mixed", [mixed[:70], mixed[70:110], mixed[110:], end], rules)
    assert _rows(alerting.resolved(states)) == _rows(M.alert_intervals(spark.createDataFrame(rows, alerting.SAMPLE), rules))


def test_alert_fires_once_then_ends_without_a_sample_of_its_own(spark, tmp_dir):
    rules = spark.createDataFrame(RULES[:1], ALERT_RULE)
    tick = lambda i: T0 + timedelta(seconds=30 * i)
    high = [("m", 30, tick(i), 5.0) for i in range(4)]
    other = ("m", 30, tick(14), 0.0)                               # 5 minutes later: ticks up to 4 are final
    states = _run(spark, tmp_dir, "open", [high, [("m", 30, tick(13), 0.0)]], rules)
    assert [tuple(r) for r in alerting.firing(states).collect()] == [("High", "critical", "svc", T0, tick(2))]
    assert alerting.resolved(states).count() == 0
    src, out = os.path.join(tmp_dir, "open"), os.path.join(tmp_dir, "open-out")
    for row in (other, ("m", 30, tick(40), 0.0)):
        spark.createDataFrame([row], alerting.SAMPLE).coalesce(1).write.mode("append").parquet(src)
        alerting.start(spark.readStream.schema(alerting.SAMPLE).parquet(src), rules, out, out + "-ckpt", "5 minutes").awaitTermination()
    states = spark.read.schema(alerting.STATES).parquet(out)
    assert alerting.firing(states).count() == 0
    assert [tuple(r)[3:] for r in alerting.resolved(states).collect()] == [(T0, tick(2), tick(3))]
    assert states.where(F.col("state") == "firing").count() == 1
