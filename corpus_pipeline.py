"""Corpus pipeline: language ID, near-dedup, suffix dedup, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame. ``run`` writes what a stage returns as Parquet to the shared folder and
reads it back as the next stage's documents. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import decontam, langid, minhash, packing, suffix, tokens
from riskflow.llm.common import materialise, maybe_in, table, tune


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``ids``; only likely hits are shuffled."""
    sift = maybe_in(docs, F.col("doc_id"), ids, "doc_id")
    return sift.where("not __hit").drop("__hit").unionByName(sift.where("__hit").drop("__hit").join(ids, "doc_id", "left_anti"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language (null, empty, no letter) go, also where no label was there to
    learn from. The language found is written to rows without a label; labels stay. An empty
    table stays empty, repeated rows are judged alike, further columns are kept as they are."""
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = langid.predict(docs, model).where(F.col("lang_pred") != langid.UNKNOWN)
    return out.select(*[F.coalesce(f"row.`{c}`", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8 or more) the
    smallest id stays, of its repeated rows (equal id and text) one. Rows without an id, a text or
    a word are in no group and stay."""
    found = materialise(minhash.near_duplicates(docs, minhash.Plan(width=5, percent=80)), "groups")
    gone = found.where("doc > component").select(F.col("doc").alias("doc_id")).distinct()
    kept = _without(docs, gone)
    again = found.where("doc is not null and n_shingles > 0").groupBy(F.col("doc").alias("doc_id")).count().where("count > 1").select("doc_id")
    again = materialise(again, "repeated")
    sift = maybe_in(kept, F.col("doc_id"), again, "doc_id")
    return sift.where("not __hit").drop("__hit").unionByName(
        sift.where("__hit").withColumn("__hit", F.xxhash64("text")).dropDuplicates(["doc_id", "__hit"]).drop("__hit"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of 50-byte strings are cut out of the texts; rows all stay. A
    character that loses some of its bytes goes with them."""
    out = suffix.remove_repeats(docs)
    raw = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.regexp_replace(F.make_valid_utf8(raw), "�", ""))
    cut = out.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("row.text")))
    cols = [F.col("text") if c == "text" else F.char_length("text").cast(dict(docs.dtypes)["n_chars"]).alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c)
            for c in docs.columns]
    return cut.select(*cols)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, with all rows of their id; rows without an id stay,
    and all do where the benchmark is empty."""
    found = decontam.leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, materialise(found.select("doc_id").distinct(), "leaking"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048. A null or empty text is its end id alone; rows without an
    id are packed too, repeated rows one by one."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), tokens.WORDS, end=1)
    return out.withColumnRenamed("doc", "doc_id").withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

# No SQL: the classifier, sketches and tokenizers are beyond it; the tests hold the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
