"""Tier boundaries, warm-copy idempotence, legal hold, export round trip (FIXTURES §7)."""
from pyspark.sql import functions as F

from riskflow.operators import retention as R
from riskflow.schema import ARCHIVE

AS_OF = "2024-06-30 00:00:00"


def _main(spark):
    offsets = [("hot", "90 00:00:00"), ("warm1", "90 00:00:01"), ("warm2", "365 00:00:00"),
               ("cold1", "365 00:00:01"), ("cold2", "2555 00:00:00"), ("purge", "2555 00:00:01")]
    rows = [(tid, f"ACC_{i % 2}", off, 10.0 + i) for i, (tid, off) in enumerate(offsets)]
    df = spark.createDataFrame(rows, "transaction_id string, account_id string, off string, amount double")
    return df.select("transaction_id", "account_id",
                     (F.to_timestamp_ntz(F.lit(AS_OF)) - F.expr("CAST(off AS INTERVAL DAY TO SECOND)"))
                     .alias("timestamp"), "amount",
                     F.lit("Groceries").alias("merchant_category"), F.lit("Oulu").alias("location"),
                     F.lit(0).alias("is_fraud"))


def test_tier_boundaries(spark):
    m = _main(spark)
    tiers = {r.transaction_id: r.t for r in m.select("transaction_id", R.tier_of(AS_OF).alias("t")).collect()}
    assert tiers == {"hot": "hot", "warm1": "warm", "warm2": "warm", "cold1": "cold", "cold2": "cold",
                     "purge": "purge"}
    s = R.tier_stats(m, AS_OF).first()
    assert (s.hot_storage_count, s.warm_storage_count, s.cold_storage_count, s.purge_eligible_count,
            s.total_count) == (1, 2, 2, 1, 6)


def test_warm_copy_is_idempotent(spark):
    m = _main(spark)
    empty = spark.createDataFrame([], ARCHIVE).drop("ml_anomaly_score", "alert_reason", "is_anomaly", "status")
    first = R.warm_copy(m, empty, AS_OF)
    assert first.count() == 5
    archive = empty.unionByName(first)
    assert R.warm_copy(m, archive, AS_OF).count() == 0
    assert R.insert_ignore(archive, first.unionByName(first)).count() == 5


def test_purge_and_legal_hold(spark):
    m = _main(spark)
    arch = R.warm_copy(m, m.limit(0).withColumn("archived_at", F.lit(None).cast("timestamp_ntz")), AS_OF)
    kept = {r.transaction_id for r in R.purge_keep(arch, AS_OF).collect()}
    assert "purge" not in kept and "cold2" in kept
    holds = spark.createDataFrame([("ACC_1",)], "account_id string")     # 'purge' row is ACC_1
    kept_h = {r.transaction_id for r in R.purge_keep(arch, AS_OF, holds=holds).collect()}
    assert "purge" in kept_h
    assert R.purged_rows(arch, AS_OF).count() == 1


def test_cold_export_round_trip(spark, tmp_dir):
    m = _main(spark)
    arch = R.warm_copy(m, m.limit(0).withColumn("archived_at", F.lit(None).cast("timestamp_ntz")), AS_OF)
    n, path = R.export_cold(arch, tmp_dir + "/cold", AS_OF)
    assert n == 3 and path.endswith("cutoff=20240630")
    back = R.read_cold(spark, path, arch.schema)
    assert back.count() == 3
    assert back.exceptAll(R.cold_candidates(arch, AS_OF).select(*back.columns)).count() == 0
    assert R.export_cold(arch, tmp_dir + "/cold", AS_OF, dry_run=True) == (3, "")
    n2, _ = R.export_cold(arch, tmp_dir + "/cold", AS_OF)        # re-run overwrites the same cutoff
    assert n2 == 3 and R.read_cold(spark, path, arch.schema).count() == 3


def test_erasure_and_all_tiers(spark):
    m = _main(spark)
    cols = ["transaction_id", "account_id", "timestamp", "amount"]
    t = R.all_tiers(m.select(*cols).limit(2), m.select(*cols), m.select(*cols).limit(0))
    assert {r.tier for r in t.collect()} == {"hot", "warm"}
    gone = R.erase(t, spark.createDataFrame([("ACC_0",)], "account_id string"))
    assert {r.account_id for r in gone.collect()} == {"ACC_1"}


def test_rows_without_a_time_are_never_purged(spark):
    a = _main(spark).select("transaction_id", "account_id", "timestamp")
    a = a.unionByName(spark.createDataFrame([("none", "ACC_9", None)], a.schema))
    kept = {r.transaction_id for r in R.purge_keep(a, AS_OF).collect()}
    gone = {r.transaction_id for r in R.purged_rows(a, AS_OF).collect()}
    assert gone == {"purge"} and "none" in kept and len(kept) + len(gone) == 7
    holds = a.where("transaction_id = 'purge'").select("account_id")
    assert R.purged_rows(a, AS_OF, holds=holds).count() == 0 and R.purge_keep(a, AS_OF, holds=holds).count() == 7


def test_a_run_writes_every_tier_and_may_be_repeated(spark, tmp_dir):
    main = _main(spark)
    archive = main.limit(0).withColumn("archived_at", F.to_timestamp_ntz(F.lit(AS_OF)))
    want = R.run(main, archive, tmp_dir, AS_OF, dry_run=True).first()
    for _ in range(2):
        assert R.run(main, archive, tmp_dir, AS_OF).first() == want
    assert (want.archived_count, want.exported_count, want.purged_count) == (5, 3, 1)
    left = spark.read.parquet(tmp_dir + "/archive/version=20240630")
    assert {r.transaction_id for r in left.collect()} == {"warm1", "warm2", "cold1", "cold2"}
    cold = tmp_dir + "/cold/cutoff=20240630"
    req = main.where("transaction_id = 'cold1'").select("account_id")
    n = R.rewrite_cold(spark, cold, tmp_dir + "/cold2", archive.schema, req)
    assert n == R.erase(R.read_cold(spark, cold, archive.schema), req).count() < 3


def test_a_dry_run_knows_the_holds(spark, tmp_dir):
    main = _main(spark)
    archive = main.limit(0).withColumn("archived_at", F.to_timestamp_ntz(F.lit(AS_OF)))
    holds = main.where("transaction_id = 'purge'").select("account_id")
    said = R.run(main, archive, tmp_dir, AS_OF, holds=holds, dry_run=True).first()
    assert said.purged_count == 0 and R.run(main, archive, tmp_dir, AS_OF, holds=holds).first() == said
    # an archive that holds the day's copies already: nothing is copied again
    again = spark.read.parquet(tmp_dir + "/archive/version=20240630")
    assert R.run(main, again, tmp_dir + "/again", AS_OF, holds=holds).first().archived_count == 0


def test_cold_files_with_one_json_array(spark, tmp_dir):
    import gzip
    import os
    os.makedirs(tmp_dir + "/arr")
    with gzip.open(tmp_dir + "/arr/a.json.gz", "wt") as f:
        f.write('[{"transaction_id": "a", "amount": 1.5},\n {"transaction_id": "b", "amount": 2.5}]')
    got = R.read_cold(spark, tmp_dir + "/arr", ARCHIVE, array=True).select("transaction_id", "amount").collect()
    assert sorted(map(tuple, got)) == [("a", 1.5), ("b", 2.5)]


def _files(path):
    """relative name -> content of a stored table's data files."""
    import os
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.startswith("part-"):
                full = os.path.join(folder, n)
                out[os.path.relpath(full, path)] = open(full, "rb").read()
    return out


def _cold_rows(spark):
    rows = spark.range(600).select(
        F.format_string("t%04d", "id").alias("transaction_id"),
        F.when(F.col("id") == 599, None).when(F.col("id") < 20, "EARLY").when(F.col("id") < 90, "ALONE").otherwise(
            F.format_string("ACC_%d", F.col("id") % 7)).alias("account_id"),
        (F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")) + F.make_dt_interval(days=F.col("id").cast("int"))).alias("timestamp"))
    return rows.withColumn("amount", F.lit(1.5))


def test_cold_erasure_rewrites_only_the_slices_concerned(spark, tmp_dir):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = _cold_rows(spark)
        n, path = R.export_cold(rows, tmp_dir + "/cold", AS_OF, 0)
        before = _files(path)
        slices = {f.split("/")[0] for f in before if f.startswith("slice=")}
        assert n == 600 and len(slices) > 3
        asked = spark.createDataFrame([("EARLY",), ("EARLY",), (None,), ("NOBODY",)], "account_id string")
        done = R.erase_cold(spark, path, rows.schema, asked)
        after = _files(path)
        same = {f for f in before if f.startswith("slice=") and after.get(f) == before[f]}
        assert done == ["slice=0"] and same == {f for f in before if f.startswith("slice=") and not f.startswith("slice=0/")}
        back = R.read_cold(spark, path, rows.schema)
        assert back.exceptAll(rows.where("account_id <> 'EARLY' OR account_id IS NULL")).count() == 0 and back.count() == 580
        assert R.erase_cold(spark, path, rows.schema, asked) == [] and _files(path) == after       # nothing left to do
        # a slice that loses all its rows goes; the account list forgets its account too
        every = spark.createDataFrame([("ALONE",), *((f"ACC_{i}",) for i in range(7))], "account_id string")
        assert len(R.erase_cold(spark, path, rows.schema, every)) == len(slices)
        assert [r.transaction_id for r in R.read_cold(spark, path, rows.schema).collect()] == ["t0599"]
        assert R.erase_cold(spark, path, rows.schema, asked.limit(0)) == []
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_months_without_changes_keep_their_files(spark, tmp_dir):
    from riskflow.operators import review
    from riskflow.sources.tables import write_partitioned
    rows = _cold_rows(spark).withColumn("status", F.lit("NEW"))
    rows = rows.unionByName(spark.createDataFrame([("none", "ACC_1", None, 1.0, "NEW")], ", ".join(f"{c} {t}" for c, t in rows.dtypes)))
    path = tmp_dir + "/months"
    write_partitioned(rows, path)
    before = _files(path)
    updates = spark.createDataFrame([("t0003", "fraud"), ("t0400", "closed?"), ("none", "FRAUD"), ("lost", "FRAUD")],
                                    "transaction_id string, new_status string")
    touched = review.update_months(spark, path, updates)
    null = "__HIVE_DEFAULT_PARTITION__"
    assert touched == ["year=2020/month=1", f"year={null}/month={null}"]
    after = _files(path)
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if f.rsplit("/", 1)[0] in touched}
    got = {r.transaction_id: r.status for r in spark.read.parquet(path).collect()}
    assert len(got) == 601 and {k for k, v in got.items() if v != "NEW"} == {"t0003", "none"}
    # the purge: whole months before the edge go, the month of the edge is cut, rows without a time and held accounts stay
    holds = spark.createDataFrame([("EARLY",)], "account_id string")
    gone = R.purge_months(spark, path, "2020-04-11 00:00:00", 1, holds)
    assert gone == [f"year=2020/month={m}" for m in (1, 2, 3, 4)]
    left = spark.read.parquet(path)
    want = rows.where("timestamp IS NULL OR account_id = 'EARLY' OR timestamp >= '2020-04-10'").select("transaction_id")
    assert sorted(r[0] for r in left.select("transaction_id").collect()) == sorted(r[0] for r in want.collect())
    assert not any(f.startswith(("year=2020/month=2/", "year=2020/month=3/")) for f in _files(path))
    # restored once, however often it is asked, by new files alone
    kept = _files(path)
    for _ in range(2):
        R.restore_months(spark, path, rows.where("account_id = 'ALONE'"), rows.unionByName(rows))
    assert spark.read.parquet(path).count() == want.count() + 70
    assert all(_files(path)[f] == kept[f] for f in kept)


def test_purge_of_months_reads_old_months_alone(spark, tmp_dir):
    from riskflow.sources.tables import write_partitioned
    path = tmp_dir + "/plan"
    write_partitioned(_cold_rows(spark), path)
    assert R.purge_months(spark, path, "2019-06-01 00:00:00", 1) == []
    assert spark.read.parquet(path).count() == 600
