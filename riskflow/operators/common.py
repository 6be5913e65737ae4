"""Shared skew-safe building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.session import reliable


def exclusive_prefix(df: DataFrame, order_col: str, value_cols: list[str],
                     bucket: Column, partition_cols: list[str] | None = None,
                     inclusive: bool = False) -> DataFrame:
    """Running sums of ``value_cols`` in ``order_col`` order, per partition.

    Adds ``cum_<v>`` = sum over rows strictly before (or up to and including
    with ``inclusive``). ``bucket`` must be a monotone function of the order
    column (e.g. a floor of it). Two levels, so no single task ever sees a
    whole partition: bucket totals -> prefix over buckets (one row per
    bucket) -> running window inside each (partition, bucket).
    """
    parts = list(partition_cols or [])
    t = df.withColumn("_bk", bucket)
    tot = t.groupBy(*parts, "_bk").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    wb = Window.partitionBy(*parts).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*parts, "_bk", *[F.coalesce(F.sum(f"_t_{v}").over(wb), F.lit(0)).alias(f"_p_{v}")
                                      for v in value_cols])
    end = 0 if inclusive else -1
    wl = Window.partitionBy(*parts, "_bk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    out = t.join(tot, [*parts, "_bk"], "left")
    for v in value_cols:
        out = out.withColumn(f"cum_{v}", F.coalesce(F.sum(v).over(wl), F.lit(0)) + F.col(f"_p_{v}"))
    return out.drop("_bk", *[f"_p_{v}" for v in value_cols])


def distributed_prefix(df: DataFrame, order_cols: list[str], value_cols: list[str],
                       partition_cols: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """Running sums in (partition_cols, order_col) order for keys with
    arbitrarily many distinct values.

    The rows are range-partitioned on (partition_cols, order_col) and stored, and the
    range partition is the bucket of the two-level ``exclusive_prefix``: buckets hold
    about equal row counts, ties share one, and there is one total a bucket and group.
    """
    parts = list(partition_cols or [])
    (order_col,) = order_cols
    t = reliable(df.repartitionByRange(*parts, order_col).withColumn("_pid", F.spark_partition_id()))
    return exclusive_prefix(t, order_col, value_cols, F.col("_pid"), parts, inclusive=inclusive).drop("_pid")
