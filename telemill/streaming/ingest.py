"""Structured Streaming forms of the ingest pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemill.operators import dedupe, ingest, policy
from telemill.operators.detect import DetectionRule, detect
from telemill.operators.ingest import CollectorIdentity
from telemill.operators.privacy.policy import PrivacyPolicy
from telemill.session import stable
from telemill.sinks.lake import write_streams
from telemill.streaming.keyindex import BUCKET_KEYS, MERGE, KeyIndex

CLOCK = "current_timestamp()"


def process_stream(
    candidates: DataFrame,
    collector: CollectorIdentity,
    now: str = CLOCK,
    policies: Sequence[policy.TelemetryPolicy] = policy.DEFAULT_POLICIES,
    privacy: PrivacyPolicy | None = None,
    column: str = "raw",
) -> DataFrame:
    """The whole pipeline on an unbounded input; stateless. Late and early events are quarantined, not lost."""
    return ingest.process(candidates, collector, now, policies, privacy, column=column)


def dedupe_stream(processed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Accepted events without repeats of a fingerprint inside the watermark.

    State is bounded by the delay: a repeat that comes later passes. Use :func:`exact_dedupe_batch`
    for suppression without a time limit.
    """
    return (
        processed.filter("accepted")
        .withColumn("time_generated", F.col("event.timeGenerated"))
        .withWatermark("time_generated", delay)
        .dropDuplicatesWithinWatermark(["fingerprint"])
    )


def exact_dedupe_batch(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Ledger rows of a micro-batch that are new to the batch and to the table."""
    return dedupe.mark_duplicates(dedupe.dedupe_first(batch), existing)


def write_exact(batch: DataFrame, base: str, batch_id: int, bucket_keys: int = BUCKET_KEYS, merge: int = MERGE) -> None:
    """Appends the ledger rows of a micro-batch whose fingerprint and event id were never written before.

    Rows go to ``base/rows/batch=N``, their keys to a :class:`telemill.streaming.keyindex.KeyIndex`, of which only
    the files that may hold one of the batch's keys are opened. A replayed batch ignores and overwrites what it
    wrote itself.
    """
    spark = batch.sparkSession
    index = KeyIndex(spark, f"{base}/index", bucket_keys, merge)
    first = stable(dedupe.dedupe_first(batch))

    def keys(df: DataFrame) -> DataFrame:
        both = F.array(
            F.struct(F.lit("fingerprint").alias("kind"), F.col("fingerprint").alias("key")),
            F.struct(F.lit("event_id").alias("kind"), F.col("event_id").alias("key")),
        )
        return df.select(F.inline(both)).where("key IS NOT NULL")

    known = index.known(keys(first), batch_id)
    fresh = first
    for kind in ("fingerprint", "event_id"):
        seen = known.where(F.col("kind") == kind).select(F.col("key").alias(kind)).distinct()
        fresh = fresh.join(seen, kind, "left_anti")
    fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")
    written = spark.read.schema(batch.schema).parquet(f"{base}/rows/batch={batch_id}")
    index.add(keys(written), batch_id)


def start_exact(rows: DataFrame, base: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Ledger rows into a table without repeats, however late a repeat comes."""
    writer = rows.writeStream.foreachBatch(lambda df, batch_id: write_exact(df, base, batch_id)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def alert_stream(processed: DataFrame, rules: Sequence[DetectionRule], delay: str = "1 hour", now: str = CLOCK) -> DataFrame:
    """Alerts of accepted events, once per rule, event and rule version inside the watermark."""
    timed = processed.filter("accepted").withColumn("event_time", F.col("event.timeGenerated"))
    alerts = detect(timed, rules, now).withWatermark("detected_at", delay)
    return alerts.dropDuplicatesWithinWatermark(["rule_id", "event_id", "rule_hash"])


def burst_counts(alerts: DataFrame, window: str = "5 minutes", delay: str = "10 minutes", time: str = "detected_at") -> DataFrame:
    """Alerts per rule and tumbling window."""
    marked = alerts if not alerts.isStreaming else alerts.withWatermark(time, delay)
    return (
        marked.groupBy(F.window(time, window).alias("w"), "rule_id")
        .agg(F.count("*").alias("alerts"))
        .select(F.col("w.start").alias("bucket"), "rule_id", "alerts")
    )


def start_lake(processed: DataFrame, base: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes every micro-batch to the lake, replay-safe.

    ``checkpoint`` belongs to this stream alone and outlives it: batch numbers go on from there, and with
    them the folders that a batch overwrites.
    """
    writer = processed.writeStream.foreachBatch(lambda df, batch_id: write_streams(df, base, batch_id)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
