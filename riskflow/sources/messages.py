"""Message-stream sources and sinks.

A transaction topic carries one JSON object per message. ``message_stream``
returns a streaming DataFrame with ``value`` (the JSON text) and the arrival order:
``offset``, with Kafka ``broker_ts``, ``partition`` and ``offset``, as offsets repeat
across partitions. Kafka is used when its
connector is on the classpath; a folder of JSON-lines files (one
``{"offset": n, "value": "..."}`` record per line) is the portable source
used in tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("value", T.StringType()),
])


def message_stream(spark: SparkSession, kind: str = "files", path: str | None = None,
                   max_files_per_trigger: int | None = None, **kafka_options) -> DataFrame:
    """S3: the message source. ``kind='kafka'`` reads from the earliest offset
    (the consumer group is the query's checkpoint)."""
    if kind == "kafka":
        r = spark.readStream.format("kafka").option("startingOffsets", "earliest")
        for k, v in kafka_options.items():
            r = r.option(k, v)
        return r.load().select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("broker_ts"),
                               F.col("partition"), F.col("offset"))
    r = spark.readStream.schema(ENVELOPE).format("json")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(path)


def to_messages(df: DataFrame, order_cols: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows -> envelope (offset, value=JSON of the row).

    Offsets follow ``order_cols``: a distributed range-partitioned sort,
    then ``monotonically_increasing_id`` (increasing across and within the
    sorted partitions; not dense, like offsets spread over partitions)."""
    return envelopes(df.orderBy(*order_cols), F.monotonically_increasing_id(), exclude)


def envelopes(df: DataFrame, offset: Column, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows -> envelope with the offset that is given, in one narrow pass: a sort over ranges
    reads its input two or three times, and derives the rows as often."""
    cols = [c for c in df.columns if c not in exclude]
    return df.select(offset.alias("offset"), F.to_json(F.struct(*cols)).alias("value"))


def replay_csv_to_topic(spark: SparkSession, csv_dir: str, schema: T.StructType, out_dir: str,
                        checkpoint: str, max_files_per_trigger: int = 1):
    """CSV files -> JSON message files, paced by ``maxFilesPerTrigger``
    (the streaming stand-in for the fixed per-record sleep)."""
    src = (spark.readStream.schema(schema).option("header", True)
                .option("maxFilesPerTrigger", max_files_per_trigger).csv(csv_dir))
    msgs = src.select(F.to_json(F.struct(*src.columns)).alias("value"))
    return (msgs.writeStream.format("text").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start(out_dir))
