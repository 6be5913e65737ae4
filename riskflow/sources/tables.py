"""Parquet table access (the driver tables) with explicit column pruning."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskflow.session import stored

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Read one driver table; ``columns`` keeps the scan's ReadSchema narrow."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def projected_scan(df: DataFrame, columns: list[str]) -> DataFrame:
    """Explicit projection; Catalyst prunes the parquet ReadSchema to it."""
    return df.select(*columns)


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, explicit schema, timestamp parsed (no inference)."""
    from riskflow.schema import TRANSACTION
    return (spark.read.schema(TRANSACTION).option("header", True)
                 .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path))


def seed_load(spark: SparkSession, csv_path: str, table_path: str) -> str:
    """Idempotent seed: create+load when the table is absent, load when it
    is empty, otherwise do nothing. Returns what happened."""
    if table_exists(spark, table_path):
        if spark.read.parquet(table_path).limit(1).count() > 0:
            return "skipped"
        action = "loaded"
    else:
        action = "created"
    read_transactions_csv(spark, csv_path).write.mode("append").parquet(table_path)
    return action


def write_partitioned(df: DataFrame, path: str, ts: str = "timestamp", mode: str = "overwrite") -> None:
    """Monthly partitions (year, month); readers filtering on them get
    partition pruning. Rows are range-partitioned on time first, so a busy
    month is written by many tasks (each a time slice) and files are
    time-clustered (min/max skipping inside a month)."""
    from pyspark.sql import functions as F
    out = df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts))
    (out.repartitionByRange(ts).sortWithinPartitions(ts)
        .write.mode(mode).partitionBy("year", "month").parquet(path))


def replace_folders(spark: SparkSession, path: str, parts: list[str], touched: DataFrame, change: Callable[[DataFrame], DataFrame],
                    order: list[str], fmt: str = "parquet", schema=None, options: dict | None = None) -> list[str]:
    """Rewrite the partition folders (of columns ``parts``) that ``touched`` names; the files of all others stay as they are.

    Only these folders are read. What ``change`` makes of their rows is stored whole first, then written with
    dynamic partition overwrite; folders left without rows are removed. Running it again after a failure gives the
    same table as long as ``change`` gives the same rows for changed ones. Returns the folders' names."""
    keys = [tuple(r) for r in touched.select(*parts).distinct().collect()]        # names of folders: no more than a listing
    names = [_folder(parts, k) for k in keys]
    if not names:
        return []
    reader = spark.read.format(fmt).options(**(options or {})).option("basePath", path)
    rows = (reader.schema(schema) if schema else reader).load([f"{path}/{n}" for n in names])
    after = stored(change(rows).select(*rows.columns), "folders")
    left = {_folder(parts, tuple(r)) for r in after.select(*parts).distinct().collect()}
    if left:
        (after.repartitionByRange(*parts, *order).sortWithinPartitions(*parts, *order).write.mode("overwrite").format(fmt)
              .options(**(options or {})).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).save(path))
    jvm = spark.sparkContext._jvm
    for n in sorted(set(names) - left):
        gone = jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    spark.catalog.refreshByPath(path)
    return sorted(names)


def _folder(parts: list[str], key: tuple) -> str:
    return "/".join(f"{p}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for p, v in zip(parts, key))
