"""Stored tables of the streaming detector whose cost follows the batch, not the history.

``Seen`` keeps, beside each batch's rows, a filter of the batch's ids: 64-bit words, each id
setting BITS bits of the one word that its hash names. Where the words of a batch hold all
bits of a new id, the batch may hold the id, and only such batches are read.

``Runs`` keeps per-account totals as runs: each batch adds one with the accounts it touched,
and BASE runs of a level are merged to one of the next. Which runs hold the batches before
``b`` follows from ``b`` alone (its digits to the base), so a replayed batch reads what it
read the first time, and rewrites the same folders.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS, BITS = 1 << 16, 5
BASE = 8


def fs_of(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, path: str) -> bool:
    fs, p = fs_of(spark, path + "/_SUCCESS")
    return fs.exists(p)


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Committed folders ``prefix=<n>`` under ``path``."""
    fs, p = fs_of(spark, path)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    out = [int(n.split("=", 1)[1]) for n in names if n.startswith(prefix + "=") and n.split("=", 1)[1].isdigit()]
    return sorted(n for n in out if committed(spark, f"{path}/{prefix}={n}"))


class Seen:
    """Filters of the ids of each batch under ``path``; the rows themselves lie in ``rows``."""

    def __init__(self, spark: SparkSession, path: str, rows: str, key: str = "transaction_id", slots: int = SLOTS):
        self.spark, self.path, self.rows, self.key, self.slots = spark, path, rows, key, slots

    def _word(self, key: Column) -> tuple[Column, Column]:
        h = F.xxhash64(key, F.lit(3))
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(6 * k)).bitwiseAND(63).cast("int")) for k in range(BITS)]
        mask = bits[0]
        for b in bits[1:]:
            mask = mask.bitwiseOR(b)
        return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(self.slots)).cast("int"), mask

    def add(self, written: DataFrame, batch_id: int) -> None:
        slot, mask = self._word(F.col(self.key))
        (written.where(F.col(self.key).isNotNull()).select(slot.alias("slot"), mask.alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("word"))
         .sortWithinPartitions("slot").write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}"))

    def batches(self, ids: DataFrame, batch_id: int) -> list[int]:
        """Batches before ``batch_id`` that may hold one of the ids: at most a number a batch."""
        fs, root = fs_of(self.spark, self.path)
        if not fs.exists(root):
            return []
        slot, mask = self._word(F.col(self.key))
        words = self.spark.read.schema("slot int, word long, batch_id long").parquet(self.path).where(F.col("batch_id") < batch_id)
        probe = ids.where(F.col(self.key).isNotNull()).select(slot.alias("slot"), mask.alias("mask"))
        hit = probe.join(words, "slot").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
        return sorted(r["batch_id"] for r in hit.select("batch_id").distinct().collect())

    def stored(self, ids: DataFrame, batch_id: int) -> tuple[DataFrame | None, list[int]]:
        """The ids of those batches, read from their rows (None where there are none), and which they are."""
        at = self.batches(ids, batch_id)
        if not at:
            return None, at
        files = [f"{self.rows}/batch_id={b}" for b in at]
        return self.spark.read.parquet(*files).select(self.key), at


def digits(batch_id: int) -> Iterator[tuple[int, int]]:
    """(level, first batch) of the runs that hold the batches before ``batch_id``, the oldest first."""
    level, size = 0, 1
    while size * BASE <= batch_id:
        level, size = level + 1, size * BASE
    at = 0
    while size:
        while at + size <= batch_id:
            yield level, at
            at += size
        level, size = level - 1, size // BASE


class Runs:
    """Totals per ``keys`` (columns ``sums``; both with their types) of all batches under ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], sums: dict[str, str]):
        self.spark, self.path, self.keys, self.sums = spark, path, keys, sums
        self.schema = ", ".join(f"{c} {t}" for c, t in (keys | sums).items())

    def _folder(self, level: int, first: int) -> str:
        return f"{self.path}/level={level}/first={first}"

    def _merged(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    def before(self, batch_id: int) -> DataFrame | None:
        """Totals of the batches before ``batch_id``: at most BASE - 1 runs a level are read."""
        folders = [f for run in digits(batch_id) for f in self._held(*run)]
        return self._merged(folders) if folders else None

    def current(self) -> DataFrame | None:
        """Totals of all batches that are there."""
        fs, root = fs_of(self.spark, self.path)
        if not fs.exists(root):
            return None
        levels = [int(st.getPath().getName().split("=")[1]) for st in fs.listStatus(root)]
        ends = [first + BASE ** x for x in levels for first in numbered(self.spark, f"{self.path}/level={x}", "first")]
        return self.before(max(ends)) if ends else None

    def _held(self, level: int, first: int) -> list[str]:
        """The folder of a run, or those of its parts where the merge has not been written yet."""
        if committed(self.spark, self._folder(level, first)):
            return [self._folder(level, first)]
        size = BASE ** (level - 1) if level else 0
        return [f for k in range(BASE if level else 0) for f in self._held(level - 1, first + k * size)]

    def add(self, delta: DataFrame, batch_id: int) -> None:
        """Write the batch's totals and the merges that fall due with it."""
        self._write(delta, 0, batch_id)
        level, size = 1, BASE
        while (batch_id + 1) % size == 0:
            parts = [f for k in range(BASE) for f in self._held(level - 1, batch_id + 1 - size + k * size // BASE)]
            self._write(self._merged(parts), level, batch_id + 1 - size)
            level, size = level + 1, size * BASE

    def _write(self, rows: DataFrame, level: int, first: int) -> None:
        rows.select(*self.keys, *self.sums).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(self._folder(level, first))

    def drop_merged(self, batch_id: int) -> None:
        """Delete runs that neither this batch nor a later one reads; called when the batch begins,
        as then no earlier batch can be replayed."""
        needed = set(digits(batch_id))
        fs, root = fs_of(self.spark, self.path)
        if not fs.exists(root):
            return
        for st in fs.listStatus(root):
            level = int(st.getPath().getName().split("=")[1])
            for first in numbered(self.spark, f"{self.path}/level={level}", "first"):
                if first + BASE ** level <= batch_id and (level, first) not in needed:
                    gone, path = fs_of(self.spark, self._folder(level, first))
                    gone.delete(path, True)
