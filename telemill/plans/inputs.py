"""Inputs of the registered queries, derived from the given tables by Spark.

The reference tables hold business data, not telemetry, so every query turns whole tables into the
documents, lines or rows its operator reads. The same rules are written out in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.session import configure

NOW_TEXT = "2024-02-01 00:00:00"
NOW = f"timestamp'{NOW_TEXT}Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; timestamps without zone count as UTC."""
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over two tasks a core or more, however the input is split.

    A file of one row group is one task to the reader, whatever its size; the wide expressions over its rows would
    run on one core. The rows move as they were read, before they grow.
    """
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks, df.rdd.getNumPartitions()))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the number inside ``props`` as ``k``."""
    events = spread(table(spark, sf_dir, "events"))
    return events.withColumn("k", F.expr("cast(get_json_object(props, '$.k') AS bigint)"))


# How an event row becomes a candidate document; k runs from 0 to 99 and steers the odd cases.
CANDIDATE = """
CASE
  WHEN k = 3 THEN '{bad'
  WHEN k = 4 THEN '[]'
  WHEN k = 5 THEN '  '
  ELSE to_json(named_struct(
    'schemaVersion', IF(k = 1, '0.9', '1.0.0'),
    'eventId', concat('event-', event_id),
    'eventOriginalId', concat('src-', event_id div 2),
    'timeGenerated', concat(date_format(IF(k = 6, ts - INTERVAL 6 YEARS, ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z'),
    'eventCategory', IF(event_type = 'error', 'authentication', 'application-security'),
    'eventType', IF(event_type = 'error', 'authentication_failure', event_type),
    'eventAction', concat(event_type, '.attempt'),
    'eventResult', CASE WHEN k = 2 THEN 'bogus' WHEN event_type = 'error' THEN 'failure' ELSE 'success' END,
    'eventSeverity', IF(event_type = 'error', 'high', NULL),
    'eventOutcomeReason', IF(k % 2 = 0, concat('reason ', k), NULL),
    'application', named_struct('name', 'shop', 'environment', 'test'),
    'actor', IF(k < 20, NULL, named_struct('userId', concat('u', user_id), 'username', concat('user', user_id))),
    'target', IF(k % 4 = 0, named_struct('type', 'item', 'id', concat('t', k)), NULL),
    'source', IF(k % 3 = 0, named_struct('ipAddress', concat('10.0.', user_id div 256, '.', user_id % 256)), NULL),
    'request', IF(k % 5 <> 0, named_struct('correlationId', concat('c', event_id)), NULL),
    'labels', map('tier', concat('t', k % 3)),
    'attributes', named_struct(
      'password', IF(k % 11 = 0, 'never-store', NULL),
      'note', CASE WHEN k % 7 = 0 THEN concat('mail a', k, '@example.org now') WHEN k % 13 = 0 THEN 'pan 4111111111111111' END,
      'plain', concat('value ', k))))
END
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, event_type, k, raw``: one candidate document per event."""
    return numbered_events(spark, sf_dir).select("event_id", "event_type", "k", F.expr(CANDIDATE).alias("raw"))


# The oracle's view of the same rows: what each candidate holds.
CANDIDATE_CTE = """
e AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
),
c AS (
  SELECT *,
    CASE WHEN k = 3 THEN 'invalid-json' WHEN k = 4 THEN 'root-must-be-object' WHEN k = 5 THEN 'empty-payload' END AS failure_code,
    k % 11 = 0 AS has_password, k % 7 = 0 AS has_mail, (k % 7 <> 0 AND k % 13 = 0) AS has_card,
    k >= 20 AS has_actor, k % 4 = 0 AS has_target, k % 3 = 0 AS has_source, k % 5 <> 0 AS has_corr, k % 2 = 0 AS has_reason
  FROM e
)
"""
