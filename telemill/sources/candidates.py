"""Candidate events: one JSON document per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.sqltext import let, once, struct
from telemill.operators.privacy.jsonwalk import candidate_failure


def with_candidate_status(df: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``parsed`` (VARIANT, null on failure) and ``failure_code``; bad rows stay as quarantine rows."""
    document = f"try_parse_json({column})"
    checked = let("doc", document, struct(parsed="doc", failure=candidate_failure(column, "doc")))
    return (
        df.transform(once, "_c", checked)
        .withColumn("failure_code", F.col("_c.failure"))
        .withColumn("parsed", F.expr("IF(_c.failure IS NULL, _c.parsed, NULL)"))
        .drop("_c")
    )


def read_candidates(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Text files with one candidate per line as ``raw``, ``parsed``, ``failure_code``."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.text(path) if not streaming else reader.schema("value string").text(path)
    return with_candidate_status(lines.withColumnRenamed("value", "raw"))
