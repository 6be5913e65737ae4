"""Tiered retention: hot (main table) -> warm (archive table) -> cold
(compressed JSON files) -> purge (P1-P8, J3-J8, U2, F9, A2, S7, S8).

Every step is a plain DataFrame plan over the tables (anti/semi joins,
filtered aggregates) that gives the new version of a table. On stored
tables ``erase_cold``, ``purge_months`` and ``restore_months`` rewrite only the
partition folders concerned.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.session import reliable, stored, ts_lit
from riskflow.sources.tables import replace_folders, write_partitioned

# bytes per row used by the storage estimate (hot / warm rows; cold rows
# before a 3:1 gzip ratio)
HOT_ROW_BYTES = 500
WARM_ROW_BYTES = 500
COLD_ROW_BYTES = 300
COLD_COMPRESSION = 3
COLD_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
COLD_OPTIONS = {"compression": "gzip", "timestampNTZFormat": COLD_TS}
COLD_BUCKETS = 64            # folders of an export's account list


def cutoff(as_of: str, days: int) -> Column:
    return ts_lit(as_of) - F.make_dt_interval(days=F.lit(int(days)))


def tier_of(as_of: str, retention_days: int = C.RETENTION_DAYS, archive_days: int = C.ARCHIVE_DAYS,
            purge_days: int = C.PURGE_DAYS, ts: str = "timestamp") -> Column:
    """Hot >= h; warm < h and >= w; cold < w and >= p; purge < p."""
    t = F.col(ts)
    return (F.when(t >= cutoff(as_of, retention_days), F.lit("hot"))
             .when(t >= cutoff(as_of, archive_days), F.lit("warm"))
             .when(t >= cutoff(as_of, purge_days), F.lit("cold"))
             .when(t.isNotNull(), F.lit("purge")))


def tier_stats(main: DataFrame, as_of: str, retention_days: int = C.RETENTION_DAYS,
               archive_days: int = C.ARCHIVE_DAYS, purge_days: int = C.PURGE_DAYS) -> DataFrame:
    """A2: per-tier counts, total, oldest and newest in one filtered pass."""
    tier = tier_of(as_of, retention_days, archive_days, purge_days)
    return main.agg(
        F.count_if(tier == "hot").alias("hot_storage_count"),
        F.count_if(tier == "warm").alias("warm_storage_count"),
        F.count_if(tier == "cold").alias("cold_storage_count"),
        F.count_if(tier == "purge").alias("purge_eligible_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.min("timestamp").alias("oldest_record"),
        F.max("timestamp").alias("newest_record"))


def not_archived(main: DataFrame, archive: DataFrame, as_of: str,
                 retention_days: int = C.RETENTION_DAYS) -> DataFrame:
    """Main rows older than the hot cutoff whose id is not archived yet
    (``left_anti`` on the non-null key: the same as NOT IN here, without
    the null-aware anti join that NOT IN would plan)."""
    old = main.where(F.col("timestamp") < cutoff(as_of, retention_days))
    return old.join(archive.select("transaction_id"), "transaction_id", "left_anti")


def insert_ignore(target: DataFrame, rows: DataFrame, key: str = "transaction_id") -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: new keys only, first copy of
    a key within the batch (min by the full row, a partial aggregate)."""
    fresh = rows.join(target.select(key), key, "left_anti")
    cols = [c for c in rows.columns if c != key]
    fresh = (fresh.groupBy(key).agg(F.min(F.struct(*cols)).alias("_r")).select(key, "_r.*"))
    return target.unionByName(fresh.select(*target.columns))


def warm_copy(main: DataFrame, archive: DataFrame, as_of: str,
              retention_days: int = C.RETENTION_DAYS) -> DataFrame:
    """The rows to append to the archive, stamped ``archived_at``.
    Copy only: the main table keeps them (deletion is disabled)."""
    return not_archived(main, archive, as_of, retention_days).withColumn("archived_at", ts_lit(as_of))


def cold_candidates(archive: DataFrame, as_of: str, archive_days: int = C.ARCHIVE_DAYS) -> DataFrame:
    """Archive rows older than the warm cutoff, oldest first."""
    return archive.where(F.col("timestamp") < cutoff(as_of, archive_days))


def export_cold(archive: DataFrame, base_path: str, as_of: str, archive_days: int = C.ARCHIVE_DAYS,
                dry_run: bool = False) -> tuple[int, str]:
    """Gzip JSON-lines export of the cold rows under
    ``<base>/cutoff=YYYYMMDD`` (overwrite per cutoff: re-running the export
    for the same cutoff is idempotent). Rows are range-partitioned on the
    timestamp so the files are ordered and the sort is distributed; each range
    is a folder ``slice=N``, and ``_accounts`` tells in which slices an account
    has rows (``erase_cold``). Returns (row count, path); nothing is written on
    a dry run or when no row qualifies."""
    rows = cold_candidates(archive, as_of, archive_days)
    n = rows.count()
    if dry_run or n == 0:
        return n, ""
    day = as_of[:10].replace("-", "")
    path = f"{base_path.rstrip('/')}/cutoff={day}"
    (rows.repartitionByRange("timestamp", "transaction_id").withColumn("slice", F.spark_partition_id())
         .sortWithinPartitions("slice", "timestamp", "transaction_id")
         .write.mode("overwrite").options(**COLD_OPTIONS).partitionBy("slice").json(path))
    pairs = archive.sparkSession.read.schema("account_id string").json(path).select(*_account_key(), "slice").distinct()
    (pairs.repartitionByRange("bucket", "account", "slice").sortWithinPartitions("bucket", "account", "slice")
          .write.partitionBy("bucket").parquet(f"{path}/_accounts"))
    return n, path


def _account_key() -> list[Column]:
    key = F.xxhash64("account_id")
    return [F.pmod(key, F.lit(COLD_BUCKETS)).cast("int").alias("bucket"), key.alias("account")]


def erase_cold(spark, path: str, schema, requests: DataFrame) -> list[str]:
    """J8 in place: the accounts in ``requests`` leave the export at ``path`` and its account list. Only slices that
    hold one of them are read and rewritten, all other files stay byte for byte. Data go first, so a run that was
    cut short finds its slices again. Returns the slices rewritten. Rows without an account stay."""
    asked = reliable(requests.where(F.col("account_id").isNotNull()).select("account_id").distinct())
    keys = asked.select(*_account_key()).distinct()
    hit = reliable(spark.read.parquet(f"{path}/_accounts").join(keys, ["bucket", "account"], "left_semi").select("bucket", "slice").distinct())
    done = replace_folders(spark, path, ["slice"], hit, lambda rows: erase(rows, asked), ["timestamp", "transaction_id"],
                           "json", schema, COLD_OPTIONS)
    replace_folders(spark, f"{path}/_accounts", ["bucket"], hit, lambda rows: rows.join(keys, ["bucket", "account"], "left_anti"),
                    ["account", "slice"])
    return done


def read_cold(spark, path: str, schema, array: bool = False) -> DataFrame:
    """Read an export back: JSON lines, or with ``array`` files that hold one JSON
    array each (such a file is read by one task)."""
    return (spark.read.schema(schema).option("multiLine", array)
                 .option("timestampNTZFormat", COLD_TS).json(path).select(*[f"`{f.name}`" for f in schema.fields]))


def purge_keep(archive: DataFrame, as_of: str, purge_days: int = C.PURGE_DAYS,
               holds: DataFrame | None = None) -> DataFrame:
    """P4 (+J7): the archive after the purge: all rows but those before the purge
    cutoff (rows without a timestamp stay), plus older rows of accounts under legal hold."""
    old = _old(as_of, purge_days)
    if holds is None:
        return archive.where(~old)
    return _held(archive, holds).where(~old | F.col("_held").isNotNull()).select(*archive.columns)


def _old(as_of: str, days: int) -> Column:
    return F.coalesce(F.col("timestamp") < cutoff(as_of, days), F.lit(False))


def _held(archive: DataFrame, holds: DataFrame) -> DataFrame:
    """``archive`` with ``_held``, not null for accounts under legal hold; the list is
    stored first, so that AQE can split the join where one account is hot."""
    held = reliable(holds.select("account_id").distinct()).withColumn("_held", F.lit(True))
    return archive.join(held, "account_id", "left")


def purged_rows(archive: DataFrame, as_of: str, purge_days: int = C.PURGE_DAYS,
                holds: DataFrame | None = None) -> DataFrame:
    """The complement of ``purge_keep`` (what a purge deletes)."""
    old = archive.where(_old(as_of, purge_days))
    return old if holds is None else _held(old, holds).where("_held is null").select(*archive.columns)


def purge_months(spark, path: str, as_of: str, purge_days: int = C.PURGE_DAYS, holds: DataFrame | None = None) -> list[str]:
    """P4 (+J7) on a table stored by month (S10): only months that begin before the purge cutoff are read and rewritten,
    and go whole where nothing stays. Returns the months touched."""
    edge = datetime.fromisoformat(as_of) - timedelta(days=purge_days)
    old = F.struct("year", "month") <= F.struct(F.lit(edge.year), F.lit(edge.month))
    months = spark.read.parquet(path).where(F.col("year") <= edge.year).where(old).select("year", "month").distinct()
    return replace_folders(spark, path, ["year", "month"], months, lambda rows: purge_keep(rows, as_of, purge_days, holds),
                           ["timestamp", "transaction_id"])


def restore_months(spark, path: str, requested: DataFrame, source: DataFrame) -> None:
    """J6 on a table stored by month: requested rows that the table lacks are appended to their months, no file is rewritten;
    one copy of an id (the least row), and none on a second run."""
    table = spark.read.parquet(path)
    cols = [c for c in table.columns if c not in ("transaction_id", "year", "month")]
    fresh = restore(requested, source, table)[0].groupBy("transaction_id").agg(F.min(F.struct(*cols)).alias("_r"))
    write_partitioned(stored(fresh.select("transaction_id", "_r.*"), "restored"), path, mode="append")
    spark.catalog.refreshByPath(path)


def dry_run(main: DataFrame, archive: DataFrame, as_of: str, retention_days: int = C.RETENTION_DAYS,
            archive_days: int = C.ARCHIVE_DAYS, purge_days: int = C.PURGE_DAYS, holds: DataFrame | None = None) -> DataFrame:
    """P5: what each step would do, counts only, as scalar subqueries; rows under legal hold stay."""
    a = not_archived(main, archive, as_of, retention_days).agg(F.count(F.lit(1))).scalar()
    e = cold_candidates(archive, as_of, archive_days).agg(F.count(F.lit(1))).scalar()
    p = purged_rows(archive, as_of, purge_days, holds).agg(F.count(F.lit(1))).scalar()
    return main.sparkSession.range(1).select(a.alias("would_archive"), e.alias("would_export"),
                                             p.alias("would_purge"))


def run_summary(main: DataFrame, archive: DataFrame, as_of: str, retention_days: int = C.RETENTION_DAYS,
                archive_days: int = C.ARCHIVE_DAYS, purge_days: int = C.PURGE_DAYS, holds: DataFrame | None = None) -> DataFrame:
    """Stats -> warm copy -> cold export -> purge (but for rows under legal hold), summarised as one row.

    Each count is of the plan the step would execute on the state left by
    the previous step (archive after the copy; purge on that archive)."""
    stats = tier_stats(main, as_of, retention_days, archive_days, purge_days)
    copied = warm_copy(main, archive, as_of, retention_days)
    archive2 = archive.unionByName(copied, allowMissingColumns=True)
    n_copied = copied.agg(F.count(F.lit(1))).scalar()
    n_export = cold_candidates(archive2, as_of, archive_days).agg(F.count(F.lit(1))).scalar()
    n_purge = purged_rows(archive2, as_of, purge_days, holds).agg(F.count(F.lit(1))).scalar()
    return stats.select("*", n_copied.alias("archived_count"), n_export.alias("exported_count"),
                        n_purge.alias("purged_count"))


def run(main: DataFrame, archive: DataFrame, base: str, as_of: str, retention_days: int = C.RETENTION_DAYS,
        archive_days: int = C.ARCHIVE_DAYS, purge_days: int = C.PURGE_DAYS, holds: DataFrame | None = None,
        dry_run: bool = False) -> DataFrame:
    """Stats -> warm copy -> cold export -> purge, with writes under ``base``:
    ``archive/copied=<day>`` (the archive after the copy), ``cold/cutoff=<day>`` and
    ``archive/version=<day>`` (after the purge, the next run's archive). Each step reads
    what the one before wrote, and overwrites its folder, so a run may be repeated.
    Returns the stats and the counts of what was done (dry run: would be done).
    """
    spark, day = main.sparkSession, as_of[:10].replace("-", "")
    stats = tier_stats(main, as_of, retention_days, archive_days, purge_days)
    if dry_run:
        return run_summary(main, archive, as_of, retention_days, archive_days, purge_days, holds)
    root = f"{base.rstrip('/')}/archive"
    copied = warm_copy(main, archive, as_of, retention_days)
    n_copied = copied.count()                      # before the write: rows of an earlier run of the day do not count
    archive.unionByName(copied, allowMissingColumns=True).write.mode("overwrite").parquet(f"{root}/copied={day}")
    after = spark.read.parquet(f"{root}/copied={day}")
    n_cold, _ = export_cold(after, f"{base.rstrip('/')}/cold", as_of, archive_days)
    n_purged = purged_rows(after, as_of, purge_days, holds).count()
    purge_keep(after, as_of, purge_days, holds).write.mode("overwrite").parquet(f"{root}/version={day}")
    return stats.select("*", *[F.lit(n).cast("long").alias(c) for c, n in (("archived_count", n_copied), ("exported_count", n_cold), ("purged_count", n_purged))])


def rewrite_cold(spark, path: str, out: str, schema, requests: DataFrame, array: bool = False) -> int:
    """J8 in the cold tier: the export at ``path`` without the accounts in ``requests``,
    written to ``out``; returns the rows that stay."""
    (erase(read_cold(spark, path, schema, array), requests).write.mode("overwrite").option("compression", "gzip")
     .option("timestampNTZFormat", COLD_TS).option("ignoreNullFields", "false").json(out))
    return read_cold(spark, out, schema).count()


def storage_estimate(stats: DataFrame) -> DataFrame:
    """Bytes per tier from the tier counts."""
    return stats.select(
        (F.col("hot_storage_count") * HOT_ROW_BYTES).alias("hot_bytes"),
        (F.col("warm_storage_count") * WARM_ROW_BYTES).alias("warm_bytes"),
        (F.col("cold_storage_count") * COLD_ROW_BYTES / COLD_COMPRESSION).alias("cold_bytes_compressed"),
        (F.col("cold_storage_count") * COLD_ROW_BYTES).alias("cold_bytes_raw"))


def archive_range(archive: DataFrame, start: str, end: str) -> DataFrame:
    """BETWEEN on the timestamp (inclusive both ends)."""
    return archive.where(F.col("timestamp").between(ts_lit(start), ts_lit(end)))


def all_tiers(hot: DataFrame, warm: DataFrame, cold: DataFrame, key: str = "transaction_id") -> DataFrame:
    """One row per key across tiers; the hottest copy wins (archive
    *copies* rows, so an id can live in several tiers). A grouped
    ``min_by`` on the tier rank, never a window over a key group."""
    cols = [c for c in hot.columns if c != key]
    u = (hot.select(key, *cols, F.lit(0).alias("_rank"))
         .unionByName(warm.select(key, *cols, F.lit(1).alias("_rank")))
         .unionByName(cold.select(key, *cols, F.lit(2).alias("_rank"))))
    tier = F.element_at(F.array(F.lit("hot"), F.lit("warm"), F.lit("cold")), F.col("_w._rank") + 1)
    return (u.groupBy(key).agg(F.min_by(F.struct(*cols, "_rank"), F.col("_rank")).alias("_w"))
             .select(key, *[F.col(f"_w.{c}").alias(c) for c in cols], tier.alias("tier")))


def restore(requested: DataFrame, source: DataFrame, target: DataFrame, key: str = "transaction_id"):
    """Restore requested ids from ``source`` into ``target``, skipping
    ids the target already has. Returns (rows to insert, duplicate report)."""
    wanted = source.join(requested.select(key).distinct(), key, "left_semi")
    fresh = wanted.join(target.select(key), key, "left_anti")
    dups = (wanted.join(target.select(key), key, "left_semi")
                  .groupBy(key).agg(F.count(F.lit(1)).alias("copies")))
    return fresh, dups


def erase(table: DataFrame, requests: DataFrame, key: str = "account_id") -> DataFrame:
    """The table without the accounts in ``requests``."""
    return table.join(reliable(requests.select(key).distinct()), key, "left_anti")


def purge_audit(purged: DataFrame, as_of: str, reason: str) -> DataFrame:
    """One audit row per purge run: count, range and reason."""
    return purged.agg(F.count(F.lit(1)).alias("purged_count"), F.min("timestamp").alias("oldest"),
                      F.max("timestamp").alias("newest")).select(
        "*", ts_lit(as_of).alias("purged_at"), F.lit(reason).alias("reason"))
