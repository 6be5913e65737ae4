"""The continuous detector on Structured Streaming.

    message stream -> foreachBatch(process_batch) -> scored / rejects /
    outbox tables + a new version of the account state

Per micro-batch ``b``:
  1. parse JSON (I1: unparsable text becomes a reject, the job keeps going);
  2. validate (I2/I3) and keep the first arrival of each id (I5, by offset);
  3. drop ids already stored by earlier batches (I5 across batches): their filters tell
     which batches may hold one, and only those are read;
  4. history before each row = account totals of the batches before + a running
     window inside the batch in arrival order (X2/X3), so the scores do not
     depend on how the stream is cut into batches;
  5. score + rules (E6, R1-R9), alert outbox keyed by (id, channel) (R12);
  6. write every output under ``batch_id=b`` with overwrite, the batch's id filter and
     its account totals (merged with older ones at times, see ``runs``), and its counts
     for the dashboard (``board``);
  7. write the batch's counters (observed while its rows were written) and the seconds
     of its stages (A13, N8, X6).

Step 6 makes a replayed batch (after an executor or driver loss, the
checkpoint re-runs it) rewrite the same files instead of adding twice
(X4). What reaches the driver: directory listings, counters, numbers of batches.
"""

from __future__ import annotations

import signal
import time
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.streaming import StreamingQueryListener

from riskflow.functions import exprs as X
from riskflow.operators import alerts, forest, ingest, lifecycle, monitor, rules, score
from riskflow.schema import REQUEST, SCORED_COLUMNS, TRANSACTION_COLUMNS
from riskflow.session import stored
from riskflow.streaming.board import Board
from riskflow.streaming.runs import Runs, Seen, fs_of

STATE = "state"
SCORED = "scored"
REJECTS = "rejects"
OUTBOX = "outbox"
DEAD = "dead_letter"
SEEN = "seen"
METRICS = "metrics"
BOARD = "board"
STAGES = ("parse", "check", "score", "reject", "alert", "state")
METRICS_SCHEMA = ("batch_id long, from_ts timestamp_ntz, to_ts timestamp_ntz, processed long, anomaly long, error long, corrupt long, duplicate long, "
                  "batches_read long, " + ", ".join(f"{x}_s double" for x in STAGES))
METRICS_SCHEMA_COLUMNS = [f.split()[0] for f in METRICS_SCHEMA.split(", ")]
ARRIVAL = ("broker_ts", "partition", "offset")


class Detector:
    """Stateful detector writing to ``out_dir`` (a shared file system path)."""

    def __init__(self, spark: SparkSession, out_dir: str, raw: Column | None = None,
                 min_score: float = rules.REFERENCE_MIN_SCORE, max_score: float = rules.REFERENCE_MAX_SCORE,
                 fallback: str = "rules", channels: list[str] | None = None):
        self.spark = spark
        self.out = out_dir.rstrip("/")
        self.raw = raw
        self.bounds = (min_score, max_score)
        self.fallback = fallback
        self.channels = channels or ["slack", "email", "webhook"]
        self.seen = Seen(spark, self.path(SEEN), self.path(SCORED))
        self.accounts = Runs(spark, self.path(STATE), {"account_id": "string"}, {"n": "long", "sum_cents": "long"})
        self.board = Board(spark, self.path(BOARD), self.seen)

    def path(self, table: str) -> str:
        return f"{self.out}/{table}"

    @classmethod
    def serving(cls, spark: SparkSession, out_dir: str, root: str, state: DataFrame, runs: DataFrame,
                model: str = lifecycle.MODEL_NAME, **kw) -> "Detector":
        """A detector that scores with the stored Production model (M7); raises
        ``ModelNotReady`` where there is none."""
        at = lifecycle.load_model(state, runs, model)
        trees, lo, hi = forest.load(spark, root, model, at["version"])
        return cls(spark, out_dir, raw=trees.score_column(spark), min_score=lo, max_score=hi, **kw)

    # ---- state -----------------------------------------------------------

    def state_before(self, batch_id: int) -> DataFrame | None:
        """(account_id, n, sum_cents) of everything the batches before ``batch_id`` stored."""
        return self.accounts.before(batch_id)

    # ---- one micro-batch --------------------------------------------------

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = self.spark
        spent: dict[str, float] = dict.fromkeys(STAGES, 0.0)

        @contextmanager
        def stage(name: str):
            begin = time.monotonic()
            yield
            spent[name] += time.monotonic() - begin

        self.accounts.drop_merged(batch_id)
        self.board.added.drop_merged(batch_id)
        order = tuple(c for c in ARRIVAL if c in batch.columns)
        with stage("parse"):
            # parsed and checked once per batch, its rows counted on the way
            came = Observation()
            checked = ingest.checked(_parse_messages(batch.select(*order, "value"), order).observe(
                came, F.count(F.lit(1)).alias("processed"), F.count_if("_corrupt").alias("corrupt")))
        corrupt = checked.where("_corrupt").select(
            F.lit(None).cast("string").alias("transaction_id"),
            F.lit("Corrupt record").alias("reject_reason"), *order, "raw")
        good = checked.where("not _corrupt").drop("_corrupt")

        with stage("check"):
            accepted, rejects = ingest.split_requests(good, order=order, keep=(*order, "raw"))
            before, batches = self.seen.stored(accepted.select("transaction_id"), batch_id)
            if before is not None:
                # the big ids meet once; what came again is few rows as a rule, and its size decides how it joins
                late = stored(accepted.select("transaction_id").join(before, "transaction_id", "left_semi"), "late")
                dup = accepted.join(late, "transaction_id", "left_semi")
                rejects = rejects.unionByName(dup.select("transaction_id", F.lit("Duplicate transaction_id").alias("reject_reason"),
                                                         *order, F.to_json(F.struct(*TRANSACTION_COLUMNS)).alias("raw")))
                accepted = accepted.join(late, "transaction_id", "left_anti")
            rejects = rejects.unionByName(corrupt).withColumn("batch_id", F.lit(batch_id))

        # write the batch outputs (overwrite = idempotent on replay)
        scored_path, rejects_path = (f"{self.path(t)}/batch_id={batch_id}" for t in (SCORED, REJECTS))
        with stage("score"):
            prev = self.state_before(batch_id)
            base = None if prev is None else prev.select("account_id", F.col("n").alias("base_n"), F.col("sum_cents").alias("base_sum_cents"))
            scored_rows = score.score_transactions(accepted, raw=self.raw, min_score=self.bounds[0],
                                                   max_score=self.bounds[1], fallback=self.fallback,
                                                   base=base, order=(*order, "transaction_id")).select(*SCORED_COLUMNS)
            kept = Observation()
            scored_rows.observe(kept, F.count_if(F.col("is_anomaly") == 1).alias("anomaly"), F.min("timestamp").alias("from_ts"),
                                F.max("timestamp").alias("to_ts")).write.mode("overwrite").parquet(scored_path)
            written = spark.read.parquet(scored_path)      # later steps reuse the written rows
        with stage("reject"):
            lost = Observation()
            rejects.observe(lost, F.count(F.lit(1)).alias("error"), F.count_if(F.col("reject_reason").startswith("Duplicate")).alias("duplicate")).write.mode(
                "overwrite").parquet(rejects_path)
            ingest.dead_letter(spark.read.parquet(rejects_path), F.current_timestamp(), raw="raw").write.mode(
                "overwrite").text(f"{self.path(DEAD)}/batch_id={batch_id}")
        with stage("alert"):
            alerts.outbox(written, enabled=self.channels, sent_at=F.col("timestamp")).write.mode(
                "overwrite").parquet(f"{self.path(OUTBOX)}/batch_id={batch_id}")
        with stage("state"):
            self.accounts.add(written.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.sum(X.cents()).alias("sum_cents")), batch_id)
            self.board.add(written, batch_id)
            self.seen.add(written, batch_id)
        row = {"batch_id": batch_id, **came.get, **kept.get, **lost.get, "batches_read": len(batches), **{f"{k}_s": v for k, v in spent.items()}}
        schema = T._parse_datatype_string(METRICS_SCHEMA)
        spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path(METRICS)}/batch={batch_id}")

    # ---- counters -------------------------------------------------------------

    def metrics(self) -> DataFrame:
        """One row a batch: its counters, the batches that the duplicate check read, and the
        seconds of its stages (``<stage>_s``)."""
        return self.spark.read.schema(METRICS_SCHEMA).parquet(self.path(METRICS)).select(*METRICS_SCHEMA_COLUMNS)

    def totals(self) -> DataFrame:
        """A13 from the counters alone: no pass over the stored rows."""
        return monitor.pipeline_totals(self.metrics())

    def activity(self) -> DataFrame:
        """The counters as a stream of (ts, processed, anomaly, error), one row a batch, for
        ``live_metrics`` (X6); ``ts`` is the latest event of the batch."""
        return (self.spark.readStream.schema(METRICS_SCHEMA).parquet(self.path(METRICS))
                .select(F.col("to_ts").cast("timestamp").alias("ts"), "processed", "anomaly", "error"))

    def stage_seconds(self) -> DataFrame:
        """(batch_id, stage, seconds) of every batch, as ``value_histogram`` takes it."""
        pairs = F.array(*[F.struct(F.lit(x).alias("stage"), F.col(f"{x}_s").alias("seconds")) for x in STAGES])
        return self.metrics().select("batch_id", F.explode(pairs).alias("x")).select("batch_id", "x.*")

    # ---- tables ---------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def _parse_messages(msgs: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """I1 on the envelope: payload fields, arrival columns, the text as ``raw`` and
    whether it could not be read."""
    schema = T.StructType(REQUEST.fields + [T.StructField("_corrupt_record", T.StringType())])
    p = F.from_json(F.col("value"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = F.col("raw").isNull() | F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull()
    return (msgs.select(*order, p.alias("_p"), F.col("value").alias("raw"))
                .select(*order, "_p.*", "raw", bad.alias("_corrupt")).drop("_corrupt_record"))


def start(spark: SparkSession, source: DataFrame, detector: Detector, checkpoint: str,
          available_now: bool = True, processing_time: str | None = None):
    """Run the detector on a message stream. ``available_now`` drains what
    is there and stops; otherwise micro-batches every ``processing_time``."""
    w = source.writeStream.foreachBatch(detector.process_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()


def stop_on_signal(query) -> None:
    """Stop the query cleanly on SIGTERM / SIGINT (the current batch
    finishes; its outputs are idempotent, so a hard stop is safe as well)."""
    def handler(signum, frame):  # noqa: ARG001
        query.stop()
    for s in (signal.SIGTERM, signal.SIGINT):
        signal.signal(s, handler)


def live_metrics(events: DataFrame, ts: str = "ts", window: str = "5 minutes", slide: str = "30 seconds",
                 watermark: str = "10 minutes") -> DataFrame:
    """Streaming counters as windowed rates; the watermark bounds state."""
    return (events.withWatermark(ts, watermark)
                  .groupBy(F.window(F.col(ts), window, slide))
                  .agg(F.sum("processed").alias("processed"), F.sum("anomaly").alias("anomalies"),
                       F.sum("error").alias("errors")))


def progress_rows(query) -> list[dict]:
    """Per-batch progress, with the backlog when the source reports it
    (Kafka: offsets behind latest; files: input rows of the batch)."""
    out = []
    for p in query.recentProgress:
        src = (p.get("sources") or [{}])[0]
        metrics = src.get("metrics") or {}
        out.append({
            "batch_id": p.get("batchId"),
            "input_rows": p.get("numInputRows"),
            "rows_per_second": p.get("processedRowsPerSecond"),
            "backlog": float(metrics["avgOffsetsBehindLatest"]) if "avgOffsetsBehindLatest" in metrics else None,
        })
    return out


class ProgressTable(StreamingQueryListener):
    """Stores each progress report of the session's streaming queries as a row under
    ``path``: the durations of the batch's steps and the backlog behind it.

    Register with ``spark.streams.addListener``. The backlog is what the source reports
    (Kafka: the offsets behind the latest), or for files the count of those that lie in the
    source's folder and that no batch has taken, by the offset log of ``checkpoint``.
    """

    SCHEMA = "query string, batch_id long, at timestamp, input_rows long, rows_per_second double, backlog double, durations map<string, long>"

    def __init__(self, spark: SparkSession, path: str, source: str | None = None, checkpoint: str | None = None):
        self.spark, self.path, self.source, self.checkpoint = spark, path.rstrip("/"), source, checkpoint
        self.rows: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        behind = [m.get("avgOffsetsBehindLatest") for m in (s.metrics or {} for s in p.sources) if m.get("avgOffsetsBehindLatest") is not None]
        backlog = sum(map(float, behind)) if behind else None
        if backlog is None and self.source and self.checkpoint:
            backlog = float(file_backlog(self.spark, self.source, self.checkpoint))
        self.rows.append({"query": str(p.id), "batch_id": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows,
                          "rows_per_second": p.processedRowsPerSecond, "backlog": backlog, "durations": dict(p.durationMs)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def flush(self) -> DataFrame:
        """Write the reports so far, a folder a batch (a repeated report replaces the one
        before), and return the table."""
        schema = T._parse_datatype_string(self.SCHEMA)
        for r in self.rows:
            at = datetime.fromisoformat(r["at"].replace("Z", "+00:00"))
            row = tuple({**r, "at": at}[f.name] for f in schema.fields)
            self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/report={r['query']}-{r['batch_id']}")
        self.rows = []
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/*")


def file_backlog(spark: SparkSession, source: str, checkpoint: str) -> int:
    """Files in the folder of a file source that no committed or running batch has taken."""
    fs, folder = fs_of(spark, source)
    there = {st.getPath().getName() for st in fs.listStatus(folder) if not st.getPath().getName().startswith(("_", "."))} if fs.exists(folder) else set()
    log_fs, log = fs_of(spark, f"{checkpoint}/sources/0")
    if not log_fs.exists(log):
        return len(there)
    lines = spark.read.text(f"{checkpoint}/sources/0").where(F.col("value").startswith("{"))
    taken = {r[0] for r in lines.select(F.regexp_extract(F.get_json_object("value", "$.path"), "[^/]+$", 0)).distinct().collect()}
    return len(there - taken)


__all__ = ["Detector", "ProgressTable", "file_backlog", "start", "stop_on_signal", "live_metrics", "progress_rows"]
