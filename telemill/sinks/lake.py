"""Flattened analytics rows and the partitioned event lake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.schema import SCHEMA_VERSION

# Destination columns, the envelope member they come from and their length limit.
FLAT_COLUMNS = (
    ("TimeGenerated", "timeGenerated", None),
    ("EventId", "eventId", 128),
    ("EventOriginalId", "eventOriginalId", 256),
    ("EventCategory", "eventCategory", 128),
    ("EventType", "eventType", 128),
    ("EventAction", "eventAction", 128),
    ("EventResult", "eventResult", 32),
    ("EventSeverity", "eventSeverity", 32),
    ("ApplicationName", "application.name", 128),
    ("ApplicationEnvironment", "application.environment", 64),
    ("ActorUserId", "actor.userId", 256),
    ("ActorUsername", "actor.username", 256),
    ("SourceIpAddress", "source.ipAddress", 64),
    ("CorrelationId", "request.correlationId", 256),
    ("PolicyId", "security.policyId", 128),
    ("PolicyVersion", "security.policyVersion", 32),
    ("PolicyHash", "security.policyHash", 128),
    ("ValueScore", "security.valueScore", None),
    ("CollectorId", "collector.id", 128),
)


def flatten_for_analytics(df: DataFrame, event: str = "event") -> DataFrame:
    """Twenty flat columns of the envelopes of the current schema version."""
    columns = [
        (F.substring(F.coalesce(F.col(f"{event}.{path}"), F.lit("")), 1, limit) if limit else F.col(f"{event}.{path}")).alias(name)
        for name, path, limit in FLAT_COLUMNS
    ]
    return df.filter(F.col(f"{event}.schemaVersion") == SCHEMA_VERSION).select(*columns, F.to_json(event).alias("RawEnvelope"))


#: Parts of a day of one stream.
FILES = 8


def stream_of(action: str = "action") -> str:
    """Lake stream of a decision."""
    return f"CASE WHEN {action} IN ('accept', 'redactAndAccept') THEN 'accepted' WHEN {action} = 'reject' THEN 'rejected' ELSE 'quarantined' END"


def write_streams(processed: DataFrame, base: str, batch_id: int | None = None, files: int = FILES) -> None:
    """Writes processed rows as Parquet, partitioned by stream and event date.

    One write with a partition column serves all three streams. A micro-batch writes under its own
    ``batch`` folder and overwrites just that, so a replayed batch leaves no duplicates.
    Rows are dealt by stream, date and ``files`` parts of the fingerprint first: a task opens the files of few
    dates, a folder gets at most ``files`` of them, and a busy day is spread.
    """
    # VARIANT attributes are kept as JSON text.
    rows = processed.select(
        F.expr(stream_of()).alias("stream"),
        F.coalesce(F.to_date("event.timeGenerated"), F.lit("1970-01-01").cast("date")).alias("event_date"),
        "action",
        "reasons",
        "fingerprint",
        F.to_json("event").alias("event"),
        F.to_json("alert").alias("alert"),
    )
    target = base if batch_id is None else f"{base.rstrip('/')}/batch={batch_id}"
    dealt = rows.repartition("stream", "event_date", F.pmod(F.xxhash64("fingerprint", "event"), F.lit(files)))
    dealt.write.mode("append" if batch_id is None else "overwrite").partitionBy("stream", "event_date").parquet(target)
