"""Registered queries: tiered retention over the multi-year orders history."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskflow.operators import retention as R
from riskflow.plans.registry import query
from riskflow.plans.sqlparts import CATS
from riskflow.session import scratch_path, ts_lit
from riskflow.sources import adapters
from riskflow.sources.tables import write_partitioned

AS_OF = adapters.ORDERS_AS_OF          # 2001-08-02
PREV_AS_OF = "2001-02-01 00:00:00"     # the previous archival run
HOT, WARM, PURGE = 90, 365, 1825


def cut(days: int, as_of: str = AS_OF) -> str:
    return f"(TIMESTAMP '{as_of}' - INTERVAL {days} DAY)"


OTX = f"""otx AS (
  SELECT printf('ORD_%08d', o_orderkey) AS transaction_id,
         printf('ACC_%06d', o_custkey) AS account_id,
         o_orderdate AS "timestamp",
         round(o_totalprice, 2) AS amount,
         {CATS}[o_orderkey % 11 + 1] AS merchant_category,
         COALESCE(n.n_name, 'Unknown') AS location,
         CAST(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS INTEGER) AS is_fraud
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
                LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

ARCH = f"""{OTX},
arch0 AS (SELECT *, TIMESTAMP '{PREV_AS_OF}' AS archived_at FROM otx WHERE "timestamp" < {cut(HOT, PREV_AS_OF)}),
copied AS (
  SELECT *, TIMESTAMP '{AS_OF}' AS archived_at FROM otx
  WHERE "timestamp" < {cut(HOT)} AND transaction_id NOT IN (SELECT transaction_id FROM arch0)),
arch AS (SELECT * FROM arch0 UNION ALL SELECT * FROM copied),
holds AS (SELECT DISTINCT account_id FROM otx WHERE is_fraud = 1 AND "timestamp" >= {cut(WARM)}),
cold AS (SELECT * FROM arch WHERE "timestamp" < {cut(WARM)}),
warm AS (SELECT * FROM arch WHERE "timestamp" >= {cut(PURGE)})"""

WITH_ARCH = "WITH " + ARCH


def _main(spark, d):
    return adapters.orders_transactions(spark, d)


def _state(spark, d):
    """(main, previous archive, archive after this run's warm copy)."""
    main = _main(spark, d)
    arch0 = (main.where(F.col("timestamp") < R.cutoff(PREV_AS_OF, HOT))
                 .withColumn("archived_at", ts_lit(PREV_AS_OF)))
    arch = arch0.unionByName(R.warm_copy(main, arch0, AS_OF, HOT))
    return main, arch0, arch


def _holds(main):
    return (main.where((F.col("is_fraud") == 1) & (F.col("timestamp") >= R.cutoff(AS_OF, WARM)))
                .select("account_id").distinct())


@query("tier_stats", f"""WITH {OTX}
SELECT count(*) FILTER (WHERE "timestamp" >= {cut(HOT)}) AS hot_storage_count,
       count(*) FILTER (WHERE "timestamp" < {cut(HOT)} AND "timestamp" >= {cut(WARM)}) AS warm_storage_count,
       count(*) FILTER (WHERE "timestamp" < {cut(WARM)} AND "timestamp" >= {cut(PURGE)}) AS cold_storage_count,
       count(*) FILTER (WHERE "timestamp" < {cut(PURGE)}) AS purge_eligible_count,
       count(*) AS total_count, min("timestamp") AS oldest_record, max("timestamp") AS newest_record
FROM otx""")
def q_tier_stats(spark, d):
    return R.tier_stats(_main(spark, d), AS_OF, HOT, WARM, PURGE)


@query("tier_assign", f"""WITH {OTX}
SELECT transaction_id,
       CASE WHEN "timestamp" >= {cut(HOT)} THEN 'hot' WHEN "timestamp" >= {cut(WARM)} THEN 'warm'
            WHEN "timestamp" >= {cut(PURGE)} THEN 'cold' ELSE 'purge' END AS tier
FROM otx""")
def q_tier_assign(spark, d):
    return _main(spark, d).select("transaction_id", R.tier_of(AS_OF, HOT, WARM, PURGE).alias("tier"))


@query("not_archived", WITH_ARCH + """
SELECT transaction_id, "timestamp" FROM copied""")
def q_not_archived(spark, d):
    main, arch0, _ = _state(spark, d)
    return R.not_archived(main, arch0, AS_OF, HOT).select("transaction_id", "timestamp")


@query("warm_copy", WITH_ARCH + "\nSELECT * FROM copied")
def q_warm_copy(spark, d):
    main, arch0, _ = _state(spark, d)
    return R.warm_copy(main, arch0, AS_OF, HOT)


@query("insert_ignore", WITH_ARCH + """
SELECT transaction_id, archived_at FROM arch""")
def q_insert_ignore(spark, d):
    """The copy is sent twice (a retried run); the second copy is ignored."""
    main, arch0, _ = _state(spark, d)
    rows = R.warm_copy(main, arch0, AS_OF, HOT)
    return R.insert_ignore(arch0, rows.unionByName(rows)).select("transaction_id", "archived_at")


@query("purge_keep", WITH_ARCH + "\nSELECT * FROM warm")
def q_purge_keep(spark, d):
    _, _, arch = _state(spark, d)
    return R.purge_keep(arch, AS_OF, PURGE)


@query("legal_hold", WITH_ARCH + f"""
SELECT * FROM arch WHERE "timestamp" >= {cut(PURGE)} OR account_id IN (SELECT account_id FROM holds)""")
def q_legal_hold(spark, d):
    main, _, arch = _state(spark, d)
    return R.purge_keep(arch, AS_OF, PURGE, holds=_holds(main))


@query("dry_run", WITH_ARCH + f"""
SELECT (SELECT count(*) FROM copied) AS would_archive,
       (SELECT count(*) FROM arch0 WHERE "timestamp" < {cut(WARM)}) AS would_export,
       (SELECT count(*) FROM arch0 WHERE "timestamp" < {cut(PURGE)}) AS would_purge""")
def q_dry_run(spark, d):
    main, arch0, _ = _state(spark, d)
    return R.dry_run(main, arch0, AS_OF, HOT, WARM, PURGE)


RETENTION_SQL = WITH_ARCH + f"""
SELECT count(*) FILTER (WHERE "timestamp" >= {cut(HOT)}) AS hot_storage_count,
       count(*) FILTER (WHERE "timestamp" < {cut(HOT)} AND "timestamp" >= {cut(WARM)}) AS warm_storage_count,
       count(*) FILTER (WHERE "timestamp" < {cut(WARM)} AND "timestamp" >= {cut(PURGE)}) AS cold_storage_count,
       count(*) FILTER (WHERE "timestamp" < {cut(PURGE)}) AS purge_eligible_count,
       count(*) AS total_count, min("timestamp") AS oldest_record, max("timestamp") AS newest_record,
       (SELECT count(*) FROM copied) AS archived_count,
       (SELECT count(*) FROM cold) AS exported_count,
       (SELECT count(*) FROM arch WHERE "timestamp" < {cut(PURGE)}) AS purged_count
FROM otx"""


@query("retention_summary", RETENTION_SQL)
def q_retention_summary(spark, d):
    main, arch0, _ = _state(spark, d)
    return R.run_summary(main, arch0, AS_OF, HOT, WARM, PURGE)


@query("retention_run", RETENTION_SQL)
def q_retention_run(spark, d):
    """P6 with all its writes, in the shared folder."""
    main, arch0, _ = _state(spark, d)
    return R.run(main, arch0, scratch_path(spark, f"retention-{uuid.uuid4().hex[:12]}"), AS_OF, HOT, WARM, PURGE)


@query("cold_round_trip", WITH_ARCH + "\nSELECT * FROM cold")
def q_cold_round_trip(spark, d):
    """The cold export written and read back."""
    _, _, arch = _state(spark, d)
    _, path = R.export_cold(arch, scratch_path(spark, f"cold-{uuid.uuid4().hex[:12]}"), AS_OF, WARM)
    return R.read_cold(spark, path, arch.schema) if path else arch.limit(0)


@query("storage_estimate", f"""WITH {OTX},
s AS (SELECT count(*) FILTER (WHERE "timestamp" >= {cut(HOT)}) AS h,
             count(*) FILTER (WHERE "timestamp" < {cut(HOT)} AND "timestamp" >= {cut(WARM)}) AS w,
             count(*) FILTER (WHERE "timestamp" < {cut(WARM)} AND "timestamp" >= {cut(PURGE)}) AS c FROM otx)
SELECT h * 500 AS hot_bytes, w * 500 AS warm_bytes, c * 300 / 3 AS cold_bytes_compressed,
       c * 300 AS cold_bytes_raw FROM s""")
def q_storage_estimate(spark, d):
    return R.storage_estimate(R.tier_stats(_main(spark, d), AS_OF, HOT, WARM, PURGE))


@query("archive_range", WITH_ARCH + """
SELECT * FROM arch WHERE "timestamp" BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:59'""")
def q_archive_range(spark, d):
    _, _, arch = _state(spark, d)
    return R.archive_range(arch, "1997-01-01 00:00:00", "1997-12-31 23:59:59")


ALL_TIERS_SQL = WITH_ARCH + f""",
hot AS (SELECT * FROM otx WHERE transaction_id NOT IN (SELECT transaction_id FROM arch0)),
u AS (
  SELECT transaction_id, account_id, "timestamp", amount, 0 AS rk FROM hot
  UNION ALL SELECT transaction_id, account_id, "timestamp", amount, 1 FROM warm
  UNION ALL SELECT transaction_id, account_id, "timestamp", amount, 2 FROM cold),
tiers AS (
  SELECT transaction_id, account_id, "timestamp", amount,
         ['hot', 'warm', 'cold'][rk + 1] AS tier
  FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY rk) AS rn FROM u) WHERE rn = 1)"""


def _tiers(spark, d):
    main, arch0, arch = _state(spark, d)
    # the hot table keeps what this run has copied; the rows of the run before were deleted
    # from it, so an id lives in up to three tiers
    hot = main.join(arch0.select("transaction_id"), "transaction_id", "left_anti")
    warm = R.purge_keep(arch, AS_OF, PURGE)
    cold = R.cold_candidates(arch, AS_OF, WARM)
    cols = ["transaction_id", "account_id", "timestamp", "amount"]
    return main, arch, warm, cold, R.all_tiers(hot.select(*cols), warm.select(*cols), cold.select(*cols))


@query("all_tiers", ALL_TIERS_SQL + "\nSELECT * FROM tiers")
def q_all_tiers(spark, d):
    return _tiers(spark, d)[4]


@query("restore", ALL_TIERS_SQL + """
SELECT * FROM cold WHERE account_id IN (SELECT account_id FROM holds)
  AND transaction_id NOT IN (SELECT transaction_id FROM warm)""")
def q_restore(spark, d):
    main, _, warm, cold, _ = _tiers(spark, d)
    requested = cold.join(_holds(main), "account_id", "left_semi").select("transaction_id")
    fresh, _ = R.restore(requested, cold, warm)
    return fresh


@query("restore_duplicates", ALL_TIERS_SQL + """
SELECT transaction_id, count(*) AS copies FROM cold
WHERE account_id IN (SELECT account_id FROM holds) AND transaction_id IN (SELECT transaction_id FROM warm)
GROUP BY transaction_id""")
def q_restore_duplicates(spark, d):
    main, _, warm, cold, _ = _tiers(spark, d)
    requested = cold.join(_holds(main), "account_id", "left_semi").select("transaction_id")
    _, dups = R.restore(requested, cold, warm)
    return dups


ERASE_SQL = ALL_TIERS_SQL + """,
req AS (SELECT printf('ACC_%06d', c_custkey) AS account_id FROM customer
        WHERE c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 0)"""


def _erasure_requests(spark, d):
    from riskflow.sources.tables import read_table
    c = read_table(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    return (c.where((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_acctbal") < 0))
             .select(F.format_string("ACC_%06d", "c_custkey").alias("account_id")))


@query("erasure", ERASE_SQL + """
SELECT tier, count(*) AS remaining FROM tiers WHERE account_id NOT IN (SELECT account_id FROM req) GROUP BY tier""")
def q_erasure(spark, d):
    tiers = _tiers(spark, d)[4]
    return R.erase(tiers, _erasure_requests(spark, d)).groupBy("tier").agg(F.count(F.lit(1)).alias("remaining"))


@query("purge_audit", WITH_ARCH + f"""
SELECT count(*) AS purged_count, min("timestamp") AS oldest, max("timestamp") AS newest,
       TIMESTAMP '{AS_OF}' AS purged_at, 'retention policy {PURGE} days' AS reason
FROM arch WHERE "timestamp" < {cut(PURGE)}""")
def q_purge_audit(spark, d):
    _, _, arch = _state(spark, d)
    return R.purge_audit(R.purged_rows(arch, AS_OF, PURGE), AS_OF, f"retention policy {PURGE} days")


@query("cold_erasure", ERASE_SQL + """
SELECT * FROM cold WHERE account_id NOT IN (SELECT account_id FROM req)""")
def q_cold_erasure(spark, d):
    """J8 in the cold tier: only the slices that hold a requested account are rewritten."""
    _, _, arch = _state(spark, d)
    _, path = R.export_cold(arch, scratch_path(spark, f"cold-{uuid.uuid4().hex[:12]}"), AS_OF, WARM)
    if not path:
        return arch.limit(0)
    R.erase_cold(spark, path, arch.schema, _erasure_requests(spark, d))
    return R.read_cold(spark, path, arch.schema)


def _by_month(spark, rows):
    path = scratch_path(spark, f"months-{uuid.uuid4().hex[:12]}")
    write_partitioned(rows, path)
    return path


@query("purge_months", WITH_ARCH + f"""
SELECT *, year("timestamp") AS year, month("timestamp") AS month FROM arch
WHERE "timestamp" >= {cut(PURGE)} OR account_id IN (SELECT account_id FROM holds)""")
def q_purge_months(spark, d):
    """P4 and J7 on the stored monthly layout."""
    main, _, arch = _state(spark, d)
    path = _by_month(spark, arch)
    R.purge_months(spark, path, AS_OF, PURGE, _holds(main))
    out = spark.read.parquet(path)
    return out.withColumns({c: F.col(c).cast("long") for c in ("year", "month")})


@query("restore_months", ALL_TIERS_SQL + """
SELECT transaction_id, account_id, "timestamp", amount FROM warm
UNION ALL
SELECT transaction_id, account_id, "timestamp", amount FROM cold WHERE account_id IN (SELECT account_id FROM holds)
  AND transaction_id NOT IN (SELECT transaction_id FROM warm)""")
def q_restore_months(spark, d):
    """J6 into the stored monthly layout, sent twice."""
    main, _, warm, cold, _ = _tiers(spark, d)
    path = _by_month(spark, warm)
    requested = cold.join(_holds(main), "account_id", "left_semi").select("transaction_id")
    for _ in range(2):
        R.restore_months(spark, path, requested, cold)
    return spark.read.parquet(path).select("transaction_id", "account_id", "timestamp", "amount")
