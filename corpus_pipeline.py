"""A corpus from raw documents to token ids: filter, two de-duplications, decontamination, encoding.

``STAGES`` are applied in order; each gets what the one before kept, as a table read back from Parquet in
the cluster's shared folder.
"""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import bpe, decontaminate, lines, simhash, toxicity
from telemill.llm.common import table
from telemill.session import shared_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# Encoding, the hashes of the fingerprints and the fitted model are beyond SQL.
ORACLE_SQL = None


def _measured(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` with ``n_chars`` as the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 under a model fitted on the labelled ones."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by SimHash, and of near copies by their shingles, the document with the smallest id."""
    return simhash.keep_first_of_both(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines and passages that stand earlier."""
    return _measured(lines.remove_repeats(docs), docs)


def drop_benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without what they share with benchmark items; those that are mostly that go."""
    return _measured(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digest of the text they decode to."""
    return bpe.encode_decode(docs, TOKENIZER).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_copies),
    ("lines", drop_repeated_lines),
    ("decontamination", drop_benchmark_spans),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = PurePosixPath(f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{folder / name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
