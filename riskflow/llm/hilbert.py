"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2^BITS buckets of about equal row counts (approximate
quantiles of all rows; strings by exact cuts between whole values), the cell's
index on the Hilbert curve orders the rows, and runs of that order become shards. Rows
near in every dimension so share a shard, and the shards' minima and maxima let a
reader skip files on any of the dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import materialise, partitions
from riskflow.operators.common import distributed_prefix

BITS = 5
ACCURACY = 10_000


def as_number(rows: DataFrame, col: str, kind: str) -> Column:
    """An order-preserving number for a column; null comes first. A string's number is how many of the cuts it reaches."""
    if kind in ("string", "binary"):
        cuts = string_cuts(rows, col)
        reached = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(col))) if cuts else F.lit(0)
        return F.when(F.col(col).isNull(), -1).otherwise(reached).cast("double")
    return F.coalesce(F.col(col).cast("double"), F.lit(float("-inf")))


def string_cuts(rows: DataFrame, col: str) -> list:
    """Up to 2^BITS values that cut the rows in the order of whole values into nearly equal runs: the least value of each
    run, where a value falls into the run of its first row. Values are counted first, so a frequent one is one row."""
    line = distributed_prefix(rows.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n")), ["v"], ["n"])
    total = line.agg(F.sum("n").alias("n")).scalar()
    run = F.floor(F.col("cum_n") * (1 << BITS) / total)
    return sorted(r.v for r in line.groupBy(run.alias("run")).agg(F.min("v").alias("v")).collect())


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of (n, d) cells below 2^bits: Gray-code un-rotation from the top bit
    down (Skilling's transform), then the bits of all dimensions interleaved."""
    x = cells.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[:, i] & q) > 0
            x[on, 0] ^= low
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def _index_batches(bounds: list[list[float]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.stack([np.searchsorted(np.array(cut), b.column(n).to_numpy(zero_copy_only=False), "right") for cut, n in zip(bounds, names)], 1)
            curve = curve_index(cells, BITS) if len(b) else np.zeros(0, np.int64)
            keep = [i for i, n in enumerate(b.schema.names) if n not in names]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(curve)], [*(b.schema.names[i] for i in keep), "curve"])
    return run


def shards(rows: DataFrame, dims: list[str], key: str, size: str | None = None, count: int = 16) -> DataFrame:
    """``rows`` with ``curve``, ``shard`` (0 to count - 1) and ``slot`` (gapless from 0).

    Without ``size`` the row counts of two shards differ by one at most; with the name of
    a size column the shards hold near equal sums of it. Ties on the curve go by ``key``,
    then by the rest of the row, so equal cells and hot values split freely. Nulls come
    first in their dimension; an empty table gives an empty table. Columns named like these
    three or like the inner ones (_d0 and so on, _tie, _at, _part, _row, _low, _n0, _w0, _ns,
    _ws) are refused; map columns too, as rows are hashed. Pass narrow rows, not texts.
    """
    spark, types = rows.sparkSession, dict(rows.dtypes)
    names = [f"_d{i}" for i in range(len(dims))]
    taken = {"curve", "shard", "slot", "_tie", "_at", "_part", "_row", "_low", "_n", "_w", "_n0", "_w0", "_ns", "_ws", *names} & {c.lower() for c in rows.columns}
    if taken or any("map<" in t for t in types.values()):
        raise ValueError(f"columns that cannot be sharded: {sorted(taken) or 'maps'}")
    wide = rows.withColumns({n: as_number(rows, c, types[c]) for n, c in zip(names, dims)})
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    got = wide.agg(*[F.percentile_approx(n, F.array(*map(F.lit, steps)), F.lit(ACCURACY)).alias(n) for n in names]).first()
    bounds = [sorted(got[n] or []) for n in names]   # a fixed number of cuts; a frequent value takes several and so its share of cells
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + ["curve long"])
    curved = wide.mapInArrow(_index_batches(bounds, names), schema)
    n = partitions(spark)
    tie = F.xxhash64(*rows.columns)
    sorted_ = (curved.withColumn("_tie", tie).repartitionByRange(n, "curve", key, "_tie").sortWithinPartitions("curve", key, "_tie")
               .withColumn("_at", F.monotonically_increasing_id()))
    sorted_ = materialise(sorted_, "curve")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    weight = F.col(size).cast("long") if size else F.lit(1).cast("long")
    blocks = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    # one row a range partition, so the running sums see as many rows as there are partitions
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("_part", *[F.coalesce(F.sum(c).over(order), F.lit(0).cast("long")).alias(f"{c}0") for c in ("_n", "_w")],
                           *[F.sum(c).over(every).alias(f"{c}s") for c in ("_n", "_w")])
    ranked = sorted_.withColumn("_part", part).join(F.broadcast(blocks), "_part").withColumn("_row", F.col("_n0") + at)
    if size:
        # the middle of a row on the line of all sizes tells its shard
        run = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        mid = 2 * (F.col("_w0") + F.sum(weight).over(run)) - weight
        ranked = ranked.withColumn("shard", F.least(F.floor(mid * count / (2 * F.col("_ws"))), F.lit(count - 1)).cast("int"))
        low = ranked.groupBy("shard").agg(F.min("_row").alias("_low"))
        ranked = ranked.join(F.broadcast(low), "shard").withColumn("slot", F.col("_row") - F.col("_low"))
    else:
        # shard s holds the rows from ceil(s * n / count) on
        ranked = ranked.withColumn("shard", F.expr(f"int(_row * {count} div _ns)"))
        ranked = ranked.withColumn("slot", F.col("_row") - F.expr(f"(shard * _ns + {count - 1}) div {count}"))
    return ranked.select(*rows.columns, "curve", "shard", F.col("slot").cast("long").alias("slot"))
