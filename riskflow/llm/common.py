"""Helpers the operators share: tables, written intermediates, row prefilters, text buffers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import scratch_path

#: Rows and bytes of one Arrow batch; they bound what a Python task holds at once.
BATCH_ROWS, BATCH_BYTES = 20_000, 2 << 20
#: Bits of the row prefilter (2 MB however large the data is) and of one of its rows.
FILTER_BITS, FILTER_ROW = 1 << 24, 1 << 15

_M = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Session settings of the Python stages: small Arrow batches, UTC."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder of ``spark.checkpoint.dir``."""
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex[:12]}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    lost executors re-read files instead of recomputing what lies upstream."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, key_col: str) -> DataFrame:
    """``rows`` plus a boolean ``__hit``: false only where ``key`` is surely not in ``keys``.

    The filter is a bitmap of fixed size (512 rows of 4 KB), so it may be
    broadcast at any scale; where it is too full to help, more rows say true and
    the exact join behind it drops them. Null keys say false.
    """
    bits = (keys.select(_bit(F.col(key_col)).alias("__x")).groupBy(F.shiftright("__x", 15).alias("__b"))
            .agg(F.bitmap_construct_agg(F.col("__x").bitwiseAND(FILTER_ROW - 1)).alias("__bm")))
    out = rows.withColumn("__x", F.when(key.isNotNull(), _bit(key)))
    at = F.col("__x").bitwiseAND(FILTER_ROW - 1).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bm"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, at.bitwiseAND(7)).bitwiseAND(1) == 1
    return (out.join(F.broadcast(bits), F.shiftright(F.col("__x"), 15) == F.col("__b"), "left")
            .withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__x", "__b", "__bm"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def segments(raw: bytes, cut: re.Pattern, size: int = 1 << 20) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes that end where ``cut`` matches."""
    a = 0
    while len(raw) - a > size:
        at = cut.search(raw, a + size)
        if at is None:
            break
        yield raw[a:at.start()]
        a = at.start()
    yield raw[a:] if a else raw


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for uint64 arrays (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n odd uint64 values from a fixed seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & _M)) | np.uint64(1)
