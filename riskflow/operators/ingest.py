"""Ingest: validate, reject, de-duplicate, normalise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import constants as C
from riskflow.functions import exprs as X
from riskflow.schema import SCORED, TRANSACTION_COLUMNS
from riskflow.session import stored


def reject_reason(amount: Column | None = None, at: Column | None = None) -> Column:
    """The first failed check, in the reference order, else NULL.

    Missing fields are checked in order; then the amount must parse as a
    number and be > 0. NaN and +Infinity pass (Spark orders NaN above every
    number). A missing label is an extra, later reason: such a row could never
    be stored. Checks and ``typed`` share their expressions, so what passes
    here never fails there. ``amount`` and ``at`` are the parsed fields where they are columns already.
    """
    amount_num = X.number("amount") if amount is None else amount
    at = X.utc_timestamp("timestamp") if at is None else at
    checks = [F.when(F.col(f).isNull(), F.lit(f"Missing required field: {f}"))
              for f in C.REQUIRED_FIELDS]
    checks += [
        F.when(amount_num.isNull(), F.concat(F.lit("Invalid amount format: "), F.col("amount"))),
        F.when(amount_num <= 0, F.concat(F.lit("Invalid amount: "), amount_num.cast("string"),
                                         F.lit(" (must be positive)"))),
        F.when(F.col("is_fraud").isNull(), F.lit("Missing required field: is_fraud")),
        F.when(at.isNull(),
               F.concat(F.lit("Invalid timestamp format: "), F.col("timestamp"))),
    ]
    return F.coalesce(*checks)


def positive_amounts(tx: DataFrame) -> DataFrame:
    """I3 on typed rows: those that the check of the amount lets through; a missing one is not judged."""
    return tx.where(F.coalesce(F.col("amount") > 0, F.lit(True)))


def validate(requests: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (NULL = valid)."""
    return requests.withColumn("reject_reason", reject_reason())


def checked(requests: DataFrame) -> DataFrame:
    """Requests with ``reject_reason`` and, as ``_t``, the parsed fields (amount, timestamp,
    is_fraud), stored once: whoever filters on the reason or reads a field again reads
    columns. Left as expressions, a filter on the reason repeats the derivation of every
    field that the checks use."""
    parsed = F.struct(F.col("_a").alias("amount"), F.col("_w").alias("timestamp"), F.col("is_fraud").cast("int").alias("is_fraud"))
    read = requests.withColumns({"_a": X.number("amount"), "_w": X.utc_timestamp("timestamp")})       # parsed once a row
    return stored(read.withColumns({"reject_reason": reject_reason(F.col("_a"), F.col("_w")), "_t": parsed}).drop("_a", "_w"), "requests")


def typed(valid: DataFrame) -> DataFrame:
    """Valid requests -> TRANSACTION types (amount parsed once, timestamp parsed)."""
    if "_t" in valid.columns:
        return valid.withColumns({c: F.col(f"_t.{c}") for c in ("amount", "timestamp", "is_fraud")}).drop("_t")
    return valid.withColumns({"amount": X.number("amount"), "timestamp": X.utc_timestamp("timestamp"), "is_fraud": F.col("is_fraud").cast("int")})


def dedupe_first(valid: DataFrame, key: str = "transaction_id",
                 order: tuple[str, ...] = ("arrival_ts", "copy")) -> DataFrame:
    """I5 within a batch: the first arrival of each key wins; rows that arrive
    together are ordered by their other columns, so the winner is always the same.

    ``min`` of a struct is an ordinary aggregate, so a key that is replayed
    millions of times is pre-aggregated map-side (no group is ever buffered whole).
    """
    return _winners(valid, key, order).select(key, "_w.*")


def _winners(valid: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    rest = [c for c in valid.columns if c != key and c not in order]
    return valid.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_w"), F.count(F.lit(1)).alias("_n"))


def duplicates(valid: DataFrame, key: str = "transaction_id",
               order: tuple[str, ...] = ("arrival_ts", "copy"), won: DataFrame | None = None) -> DataFrame:
    """Rows that lost I5: for each key all rows but one. Copies equal to the winner in
    every column are counted per key, and all but one of them come back."""
    rest = [c for c in valid.columns if c != key and c not in order]
    again = (_winners(valid, key, order) if won is None else won).where("_n > 1")
    rows = valid.select(key, F.struct(*order, *rest).alias("_r")).join(again, key)
    later = rows.where("_r != _w").select(key, "_r.*")
    equal = (rows.where("_r = _w").groupBy(key).agg(F.min("_r").alias("_r"), F.count(F.lit(1)).alias("_c"))
                 .where("_c > 1").withColumn("_i", F.explode(F.sequence(F.lit(2), F.col("_c").cast("int")))).select(key, "_r.*"))
    return later.unionByName(equal).select(*valid.columns)


def split_requests(requests: DataFrame, order: tuple[str, ...] = ("arrival_ts", "copy"),
                   keep: tuple[str, ...] = ("arrival_ts",)):
    """I2-I5 on requests or on what ``checked`` made of them: (accepted TRANSACTION rows with their ``order`` columns,
    rejects(transaction_id, reject_reason, *keep)).

    ``order`` is the arrival order used by dedupe (first arrival wins) and by
    the history behind it."""
    v = requests if "_t" in requests.columns else checked(requests)
    bad = v.where(F.col("reject_reason").isNotNull())
    ok = v.where(F.col("reject_reason").isNull()).drop("reject_reason")
    # only keys that came more than once need a winner; as their list is stored, its size
    # decides whether the other rows are shuffled at all
    again = stored(ok.groupBy("transaction_id").count().where("count > 1").select("transaction_id"), "again")
    several = ok.join(again, "transaction_id", "left_semi")
    won = stored(_winners(several, "transaction_id", order), "winners")
    first = ok.join(again, "transaction_id", "left_anti").unionByName(won.select("transaction_id", "_w.*"))
    dups = duplicates(several, order=order, won=won).withColumn("reject_reason", F.lit("Duplicate transaction_id"))
    rejects = (bad.select("transaction_id", "reject_reason", *keep)
                  .unionByName(dups.select("transaction_id", "reject_reason", *keep)))
    accepted = typed(first).select(*TRANSACTION_COLUMNS, *order)
    return accepted, rejects


def dead_letter(rejects: DataFrame, at: Column, raw: str | None = None) -> DataFrame:
    """Dead-letter record {transaction, error, timestamp} as JSON text; the
    transaction is the message as it came (column ``raw``) or the row's columns."""
    tx_cols = [c for c in rejects.columns if c not in ("reject_reason",)]
    tx = F.col(raw) if raw else F.to_json(F.struct(*tx_cols))
    return rejects.select(
        F.to_json(F.struct(tx.alias("transaction"),
                           F.col("reject_reason").alias("error"),
                           at.alias("timestamp"))).alias("value"))


def clean_location(df: DataFrame, c: str = "location") -> DataFrame:
    """Remove newlines, trim."""
    return df.withColumn(c, F.trim(F.replace(F.col(c), F.lit("\n"), F.lit(""))))


def schema_evolve(df: DataFrame) -> DataFrame:
    """Add any missing SCORED column as a typed NULL; keep the order."""
    have = set(df.columns)
    for f in SCORED.fields:
        if f.name not in have:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*[f.name for f in SCORED.fields],
                     *[c for c in df.columns if c not in {f.name for f in SCORED.fields}])
