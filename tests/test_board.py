"""Dashboard counts kept by the stream: equal to the counts of the rows, after updates and replays."""
from pyspark.sql import functions as F

from riskflow.operators import review, score
from riskflow.plans import views
from riskflow.session import reliable
from riskflow.streaming.board import Board
from riskflow.streaming.runs import BASE, Seen, digits

SF = "/root/testdata/sf0.001"


def _same(board):
    rows = board.rows()
    anomalies = rows.where("is_anomaly = 1")
    assert board.kpis().collect() == review.kpis(rows).collect()
    assert board.by_category().collect() == review.by_category(anomalies).collect()
    assert board.by_status().collect() == review.by_status(anomalies).collect()


def _write(spark, seen, board, part, b):
    board.added.drop_merged(b)
    part.write.mode("overwrite").parquet(f"{seen.rows}/batch_id={b}")
    written = spark.read.parquet(f"{seen.rows}/batch_id={b}")
    board.add(written, b)
    seen.add(written, b)


def test_counts_follow_batches_and_updates(spark, tmp_dir):
    rows = views.scored(spark, SF).withColumn("b", F.pmod(F.xxhash64("transaction_id"), F.lit(BASE + 3)).cast("int"))
    rows = reliable(rows)
    seen = Seen(spark, tmp_dir + "/seen", tmp_dir + "/scored")
    board = Board(spark, tmp_dir + "/board", seen)
    assert board.kpis().collect() == review.kpis(rows.limit(0)).collect()
    assert board.update(spark.createDataFrame([("x", "FRAUD")], "transaction_id string, new_status string"), 0).count() == 0
    parts = [rows.where(F.col("b") == b).drop("b") for b in range(BASE + 3)]
    for b in range(4):
        _write(spark, seen, board, parts[b], b)
    _same(board)
    decided = reliable(score.review_decisions(rows))
    first = board.update(decided, 1)                      # only the rows stored so far change
    stored = spark.read.parquet(seen.rows)
    assert first.count() == decided.join(stored, "transaction_id", "left_semi").count() > 0
    _same(board)
    for b in range(4, BASE + 3):                          # batches after an update, one of them merged with older ones
        _write(spark, seen, board, parts[b], b)
    _same(board)
    assert board.rows().count() == rows.count()
    second = decided.withColumn("new_status", F.lit("closed")).unionByName(decided).withColumn("seq", F.lit(1)).unionByName(
        decided.withColumns({"new_status": F.lit("Dismissed"), "seq": F.lit(2)}))
    board.update(second, 2, order="seq")
    _same(board)
    counts = sorted(map(tuple, board.counts().collect()))
    # again: the last update, and the batch that came last
    board.update(second, 2, order="seq")
    _write(spark, seen, board, parts[BASE + 2], BASE + 2)
    assert sorted(map(tuple, board.counts().collect())) == counts
    assert board.by_status().where("status = 'DISMISSED'").first()["count"] == decided.count()
    board.update(decided, 3)                              # statuses may go back
    _same(board)
    assert len(list(digits(BASE + 3))) < BASE + 3
    # an update reads the batches that may hold its ids
    one = decided.limit(1)
    assert len(seen.batches(one, 1 << 62)) < BASE + 3


def test_no_rows_no_ids_unknown_statuses(spark, tmp_dir):
    schema = "transaction_id string, is_anomaly int, merchant_category string, status string, timestamp timestamp_ntz"
    seen = Seen(spark, tmp_dir + "/seen", tmp_dir + "/scored")
    board = Board(spark, tmp_dir + "/board", seen)
    _write(spark, seen, board, spark.createDataFrame([], schema), 0)
    assert board.kpis().first()["total_transactions"] == 0
    rows = [("a", 1, None, "new", None), (None, 1, "Travel", None, None), ("b", 0, "Travel", None, None)]
    _write(spark, seen, board, spark.createDataFrame(rows, schema), 1)
    updates = [("a", "no such"), ("a", None), (None, "FRAUD"), ("zz", "FRAUD"), ("b", "fraud")]
    changed = board.update(spark.createDataFrame(updates, "transaction_id string, new_status string"), 0)
    assert [(r.transaction_id, r.from_status, r.to_status) for r in changed.collect()] == [("b", "NEW", "FRAUD")]
    _same(board)
