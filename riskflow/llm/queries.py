"""The opN_* queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from riskflow.llm import boilerplate, decontam, gru, hilbert, langid, minhash, packing, phrases, retrieval, spotsigs, suffix, tokenfile, tokens, warc
from riskflow.llm.common import scratch, table
from riskflow.llm.registry import ORACLE, QUERIES, query


__all__ = ["ORACLE", "QUERIES"]


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    out = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.octet_length(F.coalesce("row.text", F.lit("")))
    return out.select(F.col("row.doc_id").alias("doc_id"), n.cast("long").alias("n_bytes"),
                      (n - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_minhash_dedup")
def op3(spark, sf_dir):
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Plan(width=3, percent=85))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                      F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return (out.select("row.doc_id", "lang_pred", "score")
            .select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score"))


@query("op6_decontaminate")
def op6(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_packing")
def op4(spark, sf_dir):
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), tokens.WORDS, end=1)
    return out.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_token_files")
def op5(spark, sf_dir):
    uri = scratch(spark, "tokens")
    done = tokenfile.write_tokens(table(spark, sf_dir, "documents"), uri, public_tokenizers.path("byte_bpe_50k.json"), tokens.SPACE_LED, end=0)
    return tokenfile.read_tokens(done, uri).select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM d JOIN f USING (payload_digest)""")
def op9(spark, sf_dir):
    uri = scratch(spark, "warc")
    index = warc.archive(table(spark, sf_dir, "pages"), uri)
    return warc.read(index, uri).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_hilbert_shards")
def op2(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
                                                     F.crc32(text.cast("binary")).alias("text_crc32"))
    out = hilbert.shards(rows, ["lang", "source", "size"], "doc_id", count=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_spotsigs")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = spotsigs.with_next(docs, "doc_id", "text", ["sigs"], lambda df: spotsigs.with_signatures(df, "text", "sigs"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = spotsigs.with_signatures(rows, "edited", "edited_sigs")
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       spotsigs.as_text("sigs").alias("fingerprint"), spotsigs.as_text("edited_sigs").alias("edited_fingerprint"),
                       spotsigs.likeness("sigs", "edited_sigs").alias("near_edited"), spotsigs.likeness("sigs", "next_sigs").alias("near_next"))


@query("op10_main_text")
def op10(spark, sf_dir):
    out = boilerplate.extract(table(spark, sf_dir, "pages"))
    return out.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op13_ranked_search", f"""
    WITH d AS (SELECT doc_id, {TERMS_SQL} AS ws FROM documents),
    seen AS (SELECT doc_id, len(ws) AS n, ws FROM d WHERE len(ws) > 0),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM seen),
    asked AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark),
    post AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM seen) GROUP BY ALL),
    terms AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
              FROM post, total WHERE term IN (SELECT term FROM asked) GROUP BY term),
    scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l)))) AS BIGINT) AS score
               FROM asked JOIN terms USING (term) JOIN post USING (term), total GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank", doc_id, score
               FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE "rank" <= 10""")
def op13(spark, sf_dir):
    out = retrieval.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@query("op12_collocations", r"""
    WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
               FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
    sized AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    grams AS (SELECT lang, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i:i])) AS ws FROM pieces
              UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) FROM pieces
              UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) FROM pieces
              UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3])) FROM pieces),
    f AS (SELECT lang, ws, array_to_string(ws, ' ') AS phrase, count(*) AS a FROM grams GROUP BY lang, ws HAVING count(*) >= 30),
    sides AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
              FROM (SELECT lang, phrase, a, ws, unnest(range(1, len(ws))) AS k FROM f)),
    cuts AS (SELECT s.lang, s.phrase, s.a, s.k, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * s.a) // (x.a + y.a) AS BIGINT) AS score
             FROM sides s JOIN f x ON x.lang = s.lang AND x.phrase = s.head JOIN f y ON y.lang = s.lang AND y.phrase = s.tail),
    best AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    around AS (SELECT lang, phrase, max(a) AS longer FROM (
                 SELECT lang, a, array_to_string(ws[1:2], ' ') AS phrase FROM f WHERE len(ws) >= 3
                 UNION ALL SELECT lang, a, array_to_string(ws[2:3], ' ') FROM f WHERE len(ws) >= 3
                 UNION ALL SELECT lang, a, array_to_string(ws[3:4], ' ') FROM f WHERE len(ws) = 4
                 UNION ALL SELECT lang, a, array_to_string(ws[1:3], ' ') FROM f WHERE len(ws) = 4
                 UNION ALL SELECT lang, a, array_to_string(ws[2:4], ' ') FROM f WHERE len(ws) = 4) GROUP BY lang, phrase),
    kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
             WHERE o.longer IS NULL OR CAST(100 AS HUGEINT) * o.longer < CAST(80 AS HUGEINT) * b.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank", phrase, a, l, r, n, score
    FROM kept JOIN sized USING (lang) QUALIFY "rank" <= 2000""")
def op12(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op11_recurrent_lm")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gru.train(docs.where(~gru.held_out()))
    return gru.score(docs, model).select(F.col("doc").alias("doc_id"), gru.held_out("doc").alias("held_out"), "n_tokens", "n_known",
                                         "train_tokens", "base_score", "score")
