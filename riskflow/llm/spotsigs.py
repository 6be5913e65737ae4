"""SpotSigs fingerprints (DataFrame functions only).

Each occurrence of a common word is a spot. Its signature is the hash of that word and
of the next CHAIN content words (words that are not common) within REACH words. A
text's fingerprint is the set of its signatures; formatting, menus and other text
without common words hardly touches it. Sets compare by Jaccard likeness; only sets
whose lengths can reach the threshold are compared, partition by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import materialise, partitions

CHAIN = 2
REACH = 10
MARK = "\u0001"

# Common words (articles, pronouns, prepositions, forms of be and have) by language.
COMMON = {
    "en": "a an and are as at be been but by can for from had has have he her his if in is it its not of on or our she so that the their them there they this to was we were what which who will with would you".split(),
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so und um uns von vor war was wie wir zu zum zur".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais me même nous on ou où par pas pour qu que qui sa sans se ses son sur tu un une vous".split(),
    "es": "al como con de del el ella en entre era es esta este ha hay la las le les lo los más me mi muy no nos o para pero por que se si sin sobre su sus también un una y ya".split(),
}
_ALL = sorted({w for ws in COMMON.values() for w in ws})


def with_signatures(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the sorted set of the text's signatures (32-bit).

    A text without a spot has one signature, the hash of the whole text; null counts
    as empty. The steps are columns of their own, so no word is looked at twice.
    """
    words, marked, spots = f"_{out}_w", f"_{out}_m", f"_{out}_s"
    t = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn(words, F.split(F.lower(t), r"[^\p{L}\p{N}]+"))
    rows = rows.withColumn(marked, F.transform(F.filter(words, lambda w: w != ""), lambda w: F.when(w.isin(_ALL), F.concat(F.lit(MARK), w)).otherwise(w)))
    rows = rows.withColumn(spots, F.filter(F.sequence(F.lit(1), F.size(marked) + 1), lambda i: F.coalesce(F.get(marked, i - 1).startswith(MARK), F.lit(False))))
    # get() is null past the end, so the last index, one too many, is never a spot
    follow = lambda i: F.slice(F.filter(F.slice(marked, i + 1, F.lit(REACH)), lambda w: ~w.startswith(MARK)), 1, CHAIN)
    sigs = F.transform(spots, lambda i: F.hash(F.get(marked, i - 1), follow(i)))
    rows = rows.withColumn(out, F.array_sort(F.array_distinct(sigs)))
    return rows.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(F.hash(t)))).drop(words, marked, spots)


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def as_text(sigs: str) -> Column:
    """The set as lower-case hex, 8 digits a signature, ascending."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def with_next(rows: DataFrame, key: str, text: str, carry: list[str] | None = None, prepare=lambda df: df) -> DataFrame:
    """``rows`` with ``next_<text>`` and ``next_<c>`` for the columns that ``prepare`` adds:
    those of the row that follows by (key, text), after the last that of the first.

    Rows fall into ranges of the key by approximate quantiles of all keys. A range also
    gets a copy of the first row of the next, so one shuffle serves and no task sees more
    than its ranges. Null keys come first; a single row follows itself.
    """
    spark = rows.sparkSession
    count = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx(key, F.array(*[F.lit(i / count) for i in range(1, count)]), F.lit(100 * count)).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))                           # at most count - 1 numbers
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0)
    placed = rows.withColumn("_b", F.when(F.col(key).isNull(), -1).otherwise(bucket).cast("int"))
    firsts = placed.groupBy("_b").agg(F.min(key).alias("_first"))
    every = Window.orderBy("_b")                             # at most count + 1 rows
    firsts = firsts.withColumn("_to", F.coalesce(F.lag("_b").over(every), F.max("_b").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    lead_rows = (placed.join(F.broadcast(firsts.withColumnRenamed("_b", "_f")), (F.col("_b") == F.col("_f")) & F.col(key).eqNullSafe(F.col("_first")))
                 .withColumn("_b", F.col("_to")).drop("_f", "_first", "_to").withColumn("_ghost", F.lit(True)))
    all_ = placed.withColumn("_ghost", F.lit(False)).unionByName(lead_rows).repartition(partitions(spark), "_b")
    ordered = Window.partitionBy("_b").orderBy("_ghost", F.col(key).asc_nulls_first(), text)
    out = prepare(all_)
    for c in [text, *(carry or [])]:
        out = out.withColumn(f"next_{c}", F.lead(c).over(ordered))
    return out.where("not _ghost").drop("_ghost", "_b")


def matches(fingerprints: DataFrame, key: str, sigs: str, percent: int = 80) -> DataFrame:
    """(a, b, likeness): pairs of different sets, a < b, with a likeness of ``percent`` or
    more, between class representatives, where a class is the keys with equal sets and
    its smallest key represents it (``classes`` lists them).

    Lengths are cut into partitions that grow by 1 / threshold, so partners lie in the
    same or the next one. Within them a pair must share one of the rarest signatures of
    both (the prefix that a pair at the threshold cannot miss); lengths are checked
    again before the whole sets are compared.
    """
    tau = percent / 100
    reps = materialise(classes(fingerprints, key, sigs).where("member = rep").select("rep", "sigs").distinct(), "reps")
    df = reps.select(F.explode("sigs").alias("s")).groupBy("s").count()
    rare = (reps.select("rep", F.size("sigs").alias("n"), F.explode("sigs").alias("s")).join(df, "s")
            .withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("count", "s")))
            .where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * tau - 1e-9) + 1)
            .withColumn("p", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / tau)))))
    left = rare.select(F.col("rep").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("p", F.col("p") + 1)).alias("p"))
    right = rare.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "s", "p")
    pairs = (left.join(right, ["s", "p"]).where((F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * tau))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out = (pairs.join(reps.select(F.col("rep").alias("a"), F.col("sigs").alias("sa")), "a")
           .join(reps.select(F.col("rep").alias("b"), F.col("sigs").alias("sb")), "b"))
    return out.withColumn("likeness", likeness("sa", "sb")).where(F.col("likeness") >= tau - 1e-12).select("a", "b", "likeness")


def classes(fingerprints: DataFrame, key: str, sigs: str) -> DataFrame:
    """(member, rep, sigs): the smallest key with the same set."""
    rows = fingerprints.select(F.col(key).alias("member"), F.col(sigs).alias("sigs"))
    low = rows.groupBy(F.xxhash64("sigs").alias("h"), "sigs").agg(F.min("member").alias("rep"))
    return rows.withColumn("h", F.xxhash64("sigs")).join(low, ["h", "sigs"]).select("member", "rep", "sigs")
