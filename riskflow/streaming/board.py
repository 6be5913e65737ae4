"""The dashboard's counts kept up to date (A8-A10): a batch adds what it wrote, a status update
moves what it changed, and reading costs a few runs of counts instead of a scan of the rows.

Counts are per (is_anomaly, merchant_category, status), with the status as the dashboard shows it
(upper case, NULL is NEW). Each micro-batch adds one run of them, each status update one run of
differences (-1 at the old status, +1 at the new one); both are merged as the account totals are
(``runs.Runs``), so a replayed batch or update rewrites its own folders.

Status updates are kept as a log beside the scored rows, which a replayed batch may rewrite at any
time; ``rows()`` joins the two. An update reads only the batches and the earlier updates whose
filters may hold one of its ids. Ids that no batch has stored change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators import review
from riskflow.session import reliable
from riskflow.streaming.runs import Runs, Seen, numbered

KEYS = {"is_anomaly": "int", "merchant_category": "string", "status": "string"}
LOG_SCHEMA = ("transaction_id string, is_anomaly int, merchant_category string, from_status string, to_status string, "
              "update_id long")
EVERY = 1 << 62


class Board:
    """Counts of the rows that ``seen`` filters, stored under ``path``."""

    def __init__(self, spark: SparkSession, path: str, seen: Seen):
        self.spark, self.path, self.seen = spark, path, seen
        self.added = Runs(spark, f"{path}/added", KEYS, {"n": "long"})
        self.moved = Runs(spark, f"{path}/moved", KEYS, {"n": "long"})
        self.log = Seen(spark, f"{path}/log_seen", f"{path}/log")

    # ---- writing -----------------------------------------------------------

    def add(self, written: DataFrame, batch_id: int) -> None:
        """Count the rows of a micro-batch."""
        rows = written.select("is_anomaly", "merchant_category", _shown(F.col("status")).alias("status"))
        self.added.add(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), batch_id)

    def update(self, updates: DataFrame, update_id: int, order: str | None = None) -> DataFrame:
        """J5 on the stored rows: (transaction_id, new_status) with ids numbered by ``update_id``
        (0, 1, 2, ...). Of several updates for one id the last by ``order`` counts, unknown statuses
        and unknown ids change nothing. Returns the changes as logged; running an update again
        writes the same log and the same differences."""
        self.moved.drop_merged(update_id)
        wanted = reliable(review.winning_updates(updates, "transaction_id", order))
        changes = self._changes(wanted, update_id)
        folder = f"{self.path}/log/batch_id={update_id}"
        changes.write.mode("overwrite").parquet(folder)
        logged = self.spark.read.schema(LOG_SCHEMA).parquet(folder)
        steps = F.array(F.struct(F.col("from_status").alias("status"), F.lit(-1).cast("long").alias("n")),
                        F.struct(F.col("to_status").alias("status"), F.lit(1).cast("long").alias("n")))
        moves = (logged.where(F.col("from_status") != F.col("to_status"))
                 .select("is_anomaly", "merchant_category", F.explode(steps).alias("x")).select("is_anomaly", "merchant_category", "x.*"))
        self.moved.add(moves.groupBy(*KEYS).agg(F.sum("n").alias("n")), update_id)
        self.log.add(logged, update_id)
        return logged

    def _changes(self, wanted: DataFrame, update_id: int) -> DataFrame:
        at = self.seen.batches(wanted, EVERY)
        if not at:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        rows = self.spark.read.parquet(*[f"{self.seen.rows}/batch_id={b}" for b in at])
        hit = rows.select("transaction_id", "is_anomaly", "merchant_category", "status").join(wanted, "transaction_id")
        before = self.log.batches(wanted, update_id)
        if before:
            hit = hit.join(self._latest(before), "transaction_id", "left")
        else:
            hit = hit.withColumn("to_status", F.lit(None).cast("string"))
        return hit.select("transaction_id", "is_anomaly", "merchant_category", _shown(F.coalesce("to_status", "status")).alias("from_status"),
                          F.upper("new_status").alias("to_status"), F.lit(update_id).cast("long").alias("update_id"))

    def _latest(self, at: list[int]) -> DataFrame:
        """The last status of each id that these updates changed."""
        log = self.spark.read.schema(LOG_SCHEMA).parquet(*[f"{self.path}/log/batch_id={u}" for u in at])
        return log.groupBy("transaction_id").agg(F.max_by("to_status", "update_id").alias("to_status"))

    # ---- reading -----------------------------------------------------------

    def counts(self) -> DataFrame:
        """(is_anomaly, merchant_category, status, n) of all batches and updates."""
        parts = [p for p in (self.added.current(), self.moved.current()) if p is not None]
        if not parts:
            return self.spark.createDataFrame([], ", ".join([*(f"{k} {t}" for k, t in KEYS.items()), "n long"]))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0")

    def kpis(self) -> DataFrame:
        """A8 from the counts; equal to ``review.kpis`` of the rows."""
        total = F.coalesce(F.sum("n"), F.lit(0))
        anomalies = F.coalesce(F.sum(F.when(F.col("is_anomaly") == 1, F.col("n"))), F.lit(0))
        return self.counts().agg(total.alias("total_transactions"), anomalies.alias("total_anomalies"),
                                 F.round(F.coalesce(F.try_divide(anomalies * 100.0, total), F.lit(0.0)), 4).alias("anomaly_rate_pct"))

    def by_category(self) -> DataFrame:
        """A9 from the counts."""
        active = self.counts().where((F.col("is_anomaly") == 1) & (F.col("status") != "DISMISSED"))
        return (active.groupBy("merchant_category").agg(F.sum("n").alias("count"))
                      .orderBy(F.col("count").desc(), "merchant_category"))

    def by_status(self) -> DataFrame:
        """A10 from the counts."""
        return (self.counts().where(F.col("is_anomaly") == 1).groupBy("status").agg(F.sum("n").alias("count"))
                    .orderBy(F.col("count").desc(), "status"))

    def rows(self) -> DataFrame:
        """The scored rows with the statuses that the updates gave them."""
        scored = self.spark.read.parquet(self.seen.rows)
        at = numbered(self.spark, f"{self.path}/log", "batch_id")
        if not at:
            return scored
        joined = scored.join(self._latest(at), "transaction_id", "left")
        return joined.withColumn("status", F.coalesce("to_status", "status")).select(*scored.columns)


def _shown(status: Column) -> Column:
    return F.upper(F.coalesce(status, F.lit("NEW")))
