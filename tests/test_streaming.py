"""Streaming detector: stream == batch under a batch split, replay safety."""
import json
import os
import time

import numpy as np
from pyspark.sql import functions as F

from riskflow.operators import monitor, score
from riskflow.sources import adapters, messages
from riskflow.streaming import detector as S
from riskflow.streaming import runs

SF = "/root/testdata/sf0.001"


def _topic(spark, d, parts=3, corrupt=True):
    req = adapters.event_requests(spark, SF)
    msgs = messages.to_messages(req, ["arrival_ts", "copy", "transaction_id"], exclude=("arrival_ts", "copy"))
    pdf = msgs.toPandas().sort_values("offset")
    src = os.path.join(d, "topic")
    os.makedirs(src)
    for i, p in enumerate(np.array_split(pdf, parts)):
        path = os.path.join(src, f"part-{i}.json")
        with open(path, "w") as fh:
            for r in p.itertuples():
                fh.write(json.dumps({"offset": int(r.offset), "value": r.value}) + "\n")
            if corrupt and i == 1:
                fh.write(json.dumps({"offset": 10 ** 12, "value": "{bad"}) + "\n")
        os.utime(path, (1000 + i, 1000 + i))
    return req, src


def test_stream_equals_batch(spark, tmp_dir):
    req, src = _topic(spark, tmp_dir)
    det = S.Detector(spark, os.path.join(tmp_dir, "out"))
    q = S.start(spark, messages.message_stream(spark, "files", src, max_files_per_trigger=1), det,
                os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination()
    assert len(S.progress_rows(q)) == 3
    stream = det.table("scored").drop("batch_id")
    batch, rej = score.detect(req)
    cols = stream.columns
    assert stream.count() == batch.count()
    assert stream.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    sr = {r.reject_reason: r["count"] for r in det.table("rejects").groupBy("reject_reason").count().collect()}
    br = {r.reject_reason: r["count"] for r in rej.groupBy("reject_reason").count().collect()}
    assert sr.pop("Corrupt record") == 1
    assert sr == br
    # replaying a batch rewrites its outputs instead of adding to them
    n_before = det.table("scored").count()
    det.process_batch(messages.message_stream(spark, "files", src).sparkSession.read
                      .schema(messages.ENVELOPE).json(os.path.join(src, "part-2.json")), 2)
    assert det.table("scored").count() == n_before
    assert det.state_before(3).agg(F.sum("n")).first()[0] == batch.count()
    # counters were observed while the batches were written, and equal those of the tables
    totals = det.totals().first()
    want = monitor.pipeline_totals(monitor.pipeline_events(req, batch, rej)).first()
    assert (totals.processed, totals.anomalies, totals.errors) == (want.processed + 1, want.anomalies, want.errors + 1)
    m = det.metrics().orderBy("batch_id").collect()
    assert [r.batch_id for r in m] == [0, 1, 2] and sum(r.corrupt for r in m) == 1
    assert sum(r.duplicate for r in m) == br["Duplicate transaction_id"]
    stages = monitor.value_histogram(det.stage_seconds(), "seconds", [0.0, 1e6])
    assert {r.le: r.n for r in stages.collect()}["1000000.0"] == 3 * len(S.STAGES)
    # X6 is fed by the detector's own counters
    q = (S.live_metrics(det.activity(), window="365 days", slide="365 days").writeStream.outputMode("complete").format("memory").queryName("live_own")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck6")).trigger(availableNow=True).start())
    q.awaitTermination()
    live = spark.sql("SELECT sum(processed) p, sum(anomalies) a, sum(errors) e FROM live_own").first()
    assert (live.p, live.a, live.e) == (totals.processed, totals.anomalies, totals.errors)


def test_runs_of_a_batch_follow_from_its_number():
    for b in range(200):
        parts = list(runs.digits(b))
        covered = [x for level, first in parts for x in range(first, first + runs.BASE ** level)]
        assert covered == list(range(b))
        assert all(sum(lv == level for lv, _ in parts) < runs.BASE for level, _ in parts)


def test_account_totals_and_bytes_follow_the_batch(spark, tmp_dir):
    """50 batches of 20 accounts each: what is written a batch does not grow, merges aside, and
    a replayed batch leaves the same totals."""
    table = runs.Runs(spark, tmp_dir + "/state", {"account_id": "string"}, {"n": "long", "sum_cents": "long"})

    def delta(b):
        return spark.range(20).select(F.format_string("A%05d", F.col("id") + b * 20 % 300).alias("account_id"), F.lit(1).cast("long").alias("n"),
                                      (F.col("id") + b).alias("sum_cents"))

    def totals(b):
        return {r.account_id: (r.n, r.sum_cents) for r in table.before(b).collect()}

    want = {}
    for b in range(20):
        table.drop_merged(b)
        table.add(delta(b), b)
        if b in (7, 8, 13):                                    # replays, at a merge too
            table.add(delta(b), b)
        for i in range(20):
            k = f"A{i + b * 20 % 300:05d}"
            n, c = want.get(k, (0, 0))
            want[k] = (n + 1, c + i + b)
    assert totals(20) == want
    # merged runs are gone once no batch can read them
    left = {(lv, f) for lv in (0, 1) for f in runs.numbered(spark, f"{tmp_dir}/state/level={lv}", "first")}
    assert left >= set(runs.digits(20)) and len(left) <= 2 * runs.BASE + 2
    deltas = [sum(os.path.getsize(os.path.join(d, f)) for f in os.listdir(d) if f.endswith(".parquet"))
              for d in (f"{tmp_dir}/state/level=0/first={b}" for b in (17, 18, 19))]
    assert max(deltas) < 2 * min(deltas)


def test_only_batches_that_may_hold_an_id_are_read(spark, tmp_dir):
    rows = tmp_dir + "/scored"
    seen = runs.Seen(spark, tmp_dir + "/seen", rows)
    for b in range(12):
        ids = spark.range(b * 1000, b * 1000 + 300).select(F.format_string("T%07d", "id").alias("transaction_id"))
        ids.write.parquet(f"{rows}/batch_id={b}")
        seen.add(spark.read.parquet(f"{rows}/batch_id={b}"), b)
    new = spark.range(900_000, 900_050).select(F.format_string("T%07d", "id").alias("transaction_id"))
    assert len(seen.batches(new, 12)) <= 1                     # a filter's false answers are rare
    old = new.unionByName(spark.createDataFrame([("T0000005",), ("T0007010",), (None,)], "transaction_id string"))
    ids, at = seen.stored(old, 12)
    assert {0, 7} <= set(at) and len(at) <= 3
    assert {r[0] for r in old.join(ids, "transaction_id", "left_semi").collect()} == {"T0000005", "T0007010"}
    assert seen.batches(old, 0) == [] and 7 not in seen.batches(old, 7)


def test_replayed_id_of_the_first_batch_is_rejected_later(spark, tmp_dir):
    req, _ = _topic(spark, tmp_dir, corrupt=False)
    value = req.where("copy = 0").orderBy("transaction_id").limit(60)
    msgs = messages.to_messages(value, ["arrival_ts", "copy", "transaction_id"], exclude=("arrival_ts", "copy")).collect()
    det = S.Detector(spark, os.path.join(tmp_dir, "late"))
    frame = lambda rows: spark.createDataFrame(rows, "offset long, value string")
    pairs = [(r.offset, r.value) for r in msgs]
    for b in range(3):
        det.process_batch(frame(pairs[b * 20:(b + 1) * 20]), b)
    kept = det.table("scored").count()
    det.process_batch(frame([(10_000 + o, v) for o, v in pairs[:20]]), 3)
    assert det.table("scored").count() == kept
    m = {r.batch_id: r for r in det.metrics().collect()}
    assert m[3].batches_read >= 1 and m[3].duplicate >= m[0].processed - m[0].error and m[1].batches_read <= 1


def test_progress_table_and_backlog(spark, tmp_dir):
    src, ck = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "ck")
    os.makedirs(src)

    def put(names):
        for i in names:
            with open(os.path.join(src, f"f{i}.json"), "w") as fh:
                fh.write(json.dumps({"x": i}) + "\n")
    put(range(5))
    assert S.file_backlog(spark, src, ck) == 5                 # nothing taken yet
    watch = S.ProgressTable(spark, os.path.join(tmp_dir, "progress"), src, ck)
    spark.streams.addListener(watch)
    try:
        q = (spark.readStream.schema("x int").option("maxFilesPerTrigger", 2).json(src).writeStream.format("noop")
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
        for _ in range(100):
            if len(watch.rows) >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watch)
    table = watch.flush().orderBy("batch_id").collect()
    assert [r.batch_id for r in table][:3] == [0, 1, 2] and sum(r.input_rows for r in table) == 5
    assert table[-1].backlog == 0 and all(r.backlog >= 0 for r in table)
    assert all("triggerExecution" in r.durations for r in table)
    put(range(5, 9))
    assert S.file_backlog(spark, src, ck) == 4                 # it grows and drains


def test_a_slice_of_the_feed_is_one_narrow_pass(spark):
    """The feed was derived three times a slice, for a sort over ranges, and its property text read once a defect."""
    whole, lo, hi = adapters.event_requests(spark, SF), "2024-01-11 00:00:00", "2024-01-21 00:00:00"
    parts = [adapters.event_requests(spark, SF, a, b) for a, b in ((None, lo), (lo, hi), (hi, None))]
    assert sorted(map(str, whole.collect())) == sorted(str(r) for p in parts for r in p.collect())
    assert parts[1].where((F.col("arrival_ts") < F.lit(lo).cast("timestamp_ntz")) | (F.col("arrival_ts") >= F.lit(hi).cast("timestamp_ntz"))).count() == 0
    out = messages.envelopes(parts[1], monitor.epoch_us("arrival_ts") * 2 + F.col("copy"), exclude=("arrival_ts", "copy"))
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p and p.count("get_json_object") == 1
    assert out.columns == ["offset", "value"] and "arrival_ts" not in out.first()["value"]
