"""Incremental scans of a table by cursor, and the cursor table."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.sqltext import lit
from telemill.functions.text import instant_text, joined_parts

KINDS = ("incrementing", "timestamp", "composite")

# The logical columns of an audit row, in order.
AUDIT_COLUMNS = {
    "sequence": "bigint",
    "event_time": "timestamp",
    "username": "string",
    "action": "string",
    "target_type": "string",
    "target_id": "string",
    "previous_value": "string",
    "new_value": "string",
    "source_ip_address": "string",
}
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Cursor:
    """Position of an incremental scan."""

    sequence: int = 0
    event_time: datetime = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def time_sql(self) -> str:
        utc = self.event_time.astimezone(timezone.utc).replace(tzinfo=None)
        return f"timestamp{lit(utc.isoformat(sep=' ') + 'Z')}"


class OverlapSaturated(RuntimeError):
    """A full batch inside the overlap window moved the cursor nowhere."""


class RecordTooLarge(RuntimeError):
    """A record is larger than the source allows."""


def incremental_scan(
    df: DataFrame,
    kind: str,
    cursor: Cursor,
    batch: int | None,
    sequence: str = "sequence",
    event_time: str = "event_time",
    overlap: timedelta = timedelta(0),
) -> DataFrame:
    """Rows after the cursor in cursor order, at most ``batch``; over JDBC all three steps are pushed down."""
    if kind not in KINDS:
        raise ValueError(f"unknown cursor kind: {kind}")
    if kind == "incrementing":
        rows = df.filter(F.col(sequence) > F.lit(cursor.sequence)).orderBy(sequence)
    elif kind == "timestamp":
        seconds = overlap.total_seconds()
        start = f"{cursor.time_sql()} - make_dt_interval(0, 0, 0, {seconds})"
        rows = df.filter(F.col(event_time) >= F.expr(start)).orderBy(event_time, sequence)
    else:
        at = F.expr(cursor.time_sql())
        rows = df.filter(
            (F.col(event_time) > at) | ((F.col(event_time) == at) & (F.col(sequence) > F.lit(cursor.sequence)))
        ).orderBy(event_time, sequence)
    return rows if batch is None else rows.limit(batch)


def next_cursor(
    batch: DataFrame, kind: str, cursor: Cursor, sequence: str = "sequence", event_time: str = "event_time", **more: Column
) -> DataFrame:
    """One row ``rows, sequence, event_time, advanced``; the cursor is null when nothing advanced.

    ``more`` are further aggregates of the same pass, by name.
    """
    order = f"struct({sequence} AS s)" if kind == "incrementing" else f"struct({event_time} AS t, {sequence} AS s)"
    top = batch.agg(
        F.count("*").alias("rows"),
        F.expr(f"max_by(struct({sequence} AS s, {event_time} AS t), {order})").alias("top"),
        *(value.alias(name) for name, value in more.items()),
    )
    moved = (
        f"top.s > {cursor.sequence}"
        if kind == "incrementing"
        else f"(top.t > {cursor.time_sql()} OR (top.t = {cursor.time_sql()} AND top.s > {cursor.sequence}))"
    )
    return top.select(
        "rows",
        F.expr(f"coalesce({moved}, false)").alias("advanced"),
        F.expr(f"IF({moved}, top.s, NULL)").alias("sequence"),
        F.expr(f"IF({moved}, top.t, NULL)").alias("event_time"),
        *more,
    )


def batch_report(
    batch: DataFrame,
    kind: str,
    cursor: Cursor,
    batch_size: int,
    max_record_bytes: int,
    overlap: timedelta = timedelta(0),
    sequence: str = "sequence",
    event_time: str = "event_time",
) -> DataFrame:
    """One row with the next cursor, the largest record and the guards ``saturated`` and ``oversized``."""
    # The batch is read once: cursor and largest record are aggregates of one pass.
    size = F.octet_length(F.to_json(F.struct(*batch.columns)))
    moved = next_cursor(batch, kind, cursor, sequence, event_time, largest=F.coalesce(F.max(size), F.lit(0)))
    full = F.lit(overlap > timedelta(0)) & (F.col("rows") == F.lit(batch_size)) & ~F.col("advanced")
    return moved.select(
        "*", full.alias("saturated"), (F.col("largest") > F.lit(max_record_bytes)).alias("oversized")
    )


def check_batch(report: DataFrame, source_id: str) -> None:
    """Raises when a guard of the one-row report is set."""
    row = report.first()
    if row["oversized"]:
        raise RecordTooLarge(f"source {source_id}: a record has {row['largest']} bytes")
    if row["saturated"]:
        raise OverlapSaturated(f"source {source_id}: reduce the overlap or raise the batch size")


def map_audit_rows(df: DataFrame, columns: Mapping[str, str], source_id: str) -> DataFrame:
    """Audit rows to source records: mapped columns, ``original_id`` and ``fingerprint``."""
    unknown = set(columns) - set(AUDIT_COLUMNS)
    if unknown or not {"sequence", "event_time"} <= set(columns):
        raise ValueError(f"column mapping needs sequence and event_time; unknown names: {sorted(unknown)}")
    bad = [c for c in columns.values() if not IDENTIFIER.fullmatch(c)]
    if bad:
        raise ValueError(f"not plain column identifiers: {bad}")
    mapped = df.selectExpr(
        *[f"cast({columns.get(name, 'NULL')} AS {kind}) AS {name}" for name, kind in AUDIT_COLUMNS.items()]
    )
    material = joined_parts(lit(source_id), "sequence", instant_text("event_time"))
    return mapped.withColumn("original_id", F.col("sequence").cast("string")).withColumn(
        "fingerprint", F.expr(f"sha2({material}, 256)")
    )


def current_cursors(log: DataFrame) -> DataFrame:
    """Current row per source of an append-only cursor log ``source_id, value, version, updated_at``."""
    return log.groupBy("source_id").agg(
        F.max_by("value", "version").alias("value"),
        F.max_by("updated_at", "version").alias("updated_at"),
        F.max("version").alias("version"),
    )


def advance_cursors(current: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies ``source_id, expected_version, value, updated_at`` proposals.

    Returns the new cursor rows to append and the conflicting proposals. Version 0 creates a cursor;
    any other expected version has to be the current one. At most one proposal per source and version
    wins, the smallest value first.
    """
    one = proposals.groupBy("source_id", "expected_version").agg(
        F.min(F.struct("value", "updated_at")).alias("_p"), F.count("*").alias("_n")
    )
    joined = one.join(current.select("source_id", F.col("version").alias("_current")), "source_id", "left")
    fits = F.coalesce(F.col("_current"), F.lit(0)) == F.col("expected_version")
    advanced = joined.filter(fits).select(
        "source_id", F.col("_p.value").alias("value"), (F.col("expected_version") + 1).alias("version"),
        F.col("_p.updated_at").alias("updated_at"),
    )
    stale = joined.select(
        "source_id", "expected_version", F.col("_current").alias("current_version"),
        F.when(fits, F.col("_n") - 1).otherwise(F.col("_n")).alias("refused"),
    ).filter("refused > 0")
    return advanced, stale
