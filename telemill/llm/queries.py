"""The registered queries of this folder: ``opN_<name>``, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import (
    bpe,
    codes,
    decontaminate,
    embeddings,
    html,
    licenses,
    lines,
    mixing,
    negatives,
    simhash,
    suffixes,
    toxicity,
    warc,
)
from telemill.llm.common import table
from telemill.session import shared_dir


def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 100 bytes take from every document."""
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm
  FROM embeddings
),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(embedding) > 0 AND norm > 0 AND isfinite(norm)
    AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
),
e AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.embedding) = len(b.embedding)
    AND list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (a.norm * b.norm) >= 0.98
),
r AS (
  SELECT vec_id, vec_id AS root FROM embeddings
  UNION
  SELECT e.v, r.root FROM r JOIN e ON e.u = r.vec_id WHERE r.root < e.v
),
n AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
SELECT vec_id, coalesce(any_value(n_links), 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept
FROM r LEFT JOIN n ON n.u = r.vec_id GROUP BY vec_id
"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back."""
    out_dir = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), out_dir)
    return warc.read(spark, out_dir, payloads=False).drop("payload", "url").withColumnRenamed("id", "page_id")


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document occurs in benchmark items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digests(found).withColumnRenamed("id", "doc_id")


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
),
-- Windows of the items; an item of fewer words is one window.
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, gram)),
h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id
),
n AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a model fitted on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def line_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats in every document, by its original offsets, and what is left of the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n_chars_in"))
    spans = F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"]))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    none, zero = F.lit(""), F.lit(0)
    return lines.remove_repeats(docs).select(
        "doc_id", F.coalesce(F.length("text").cast("long"), zero).alias("n_chars"), F.coalesce("n_chars_in", zero).alias("n_chars_in"),
        F.coalesce(F.size("removed").cast("long"), zero).alias("n_removed"), F.coalesce(size, zero).alias("removed_chars"),
        F.coalesce(F.concat_ws(",", spans), none).alias("spans"), F.sha2(F.coalesce("text", none), 256).alias("kept_sha256"),
    )


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encoded(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector and its error."""
    found, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.with_label_errors(found).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(codes.books_digest(books)).alias("codebooks_sha256"),
    )


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, with the labels of every seventh moved on."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("id") % 50 == 0)


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document gives to a mix of all sources."""
    given = mixing.mix(table(spark, sf_dir, "documents"))[1]
    return given.withColumnRenamed("id", "doc_id").drop("source")


def build() -> dict:
    """Query name to (callable, oracle SQL or None)."""
    return {
        "op1_suffix_dedup": (substring_repeats, None),
        "op2_embedding_dedup": (embedding_near_duplicates, EMBEDDING_SQL),
        "op3_html_text": (page_texts, None),
        "op4_warc": (warc_archives, WARC_SQL),
        "op5_decontamination": (decontamination, DECONTAMINATION_SQL),
        "op6_toxicity": (toxicity_scores, None),
        "op7_simhash": (simhash_near_duplicates, None),
        "op8_line_dedup": (line_repeats, lines.LINE_REPEATS_SQL),
        "op9_bpe": (bpe_round_trip, None),
        "op10_license_scan": (license_scan, licenses.scan_sql()),
        "op11_vector_codes": (vector_codes, codes.CODES_SQL),
        "op12_source_mix": (source_mix, mixing.MIX_SQL),
        "op13_hard_negatives": (hard_negatives, negatives.NEGATIVES_SQL),
        "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    }
