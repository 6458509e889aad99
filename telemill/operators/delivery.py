"""Delivery results: classification, acknowledgement, retry and dead-letter routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators.ledger import ledger_apply
from telemill.session import stable

# Back-off limits in seconds, and statuses worth another try.
MAX_EXPONENT = 8
MAX_DELAY = 300
MAX_JITTER = 10
JITTER_SHARE = 0.2
RETRYABLE_STATUSES = (0, 408, 429)


def classify_delivery(results: DataFrame, status: str = "status") -> DataFrame:
    """Adds ``code`` and ``retryable`` to failed results; a null status is a failed upload."""
    return results.withColumns(
        {
            "code": F.expr(f"IF({status} IS NULL, 'azure-upload-failed', concat('azure-http-', {status}))"),
            "retryable": F.expr(
                f"coalesce({status}, 0) IN ({', '.join(map(str, RETRYABLE_STATUSES))}) OR coalesce({status}, 0) >= 500"
            ),
        }
    )


def acknowledged(batch: DataFrame, failures: DataFrame) -> DataFrame:
    """Rows of the batch without a failure."""
    return batch.join(failures.select("event_id"), "event_id", "left_anti")


def match_failures(failed_payloads: DataFrame, batch: DataFrame, payload: str = "payload") -> DataFrame:
    """Event ids of payloads that a destination returned as failed, matched by digest.

    The payload texts are not shuffled, only their digests.
    """
    wanted = failed_payloads.withColumn("_digest", F.sha2(payload, 256)).drop(payload)
    known = batch.select("event_id", F.sha2(payload, 256).alias("_digest"))
    return wanted.join(known, "_digest").drop("_digest")


def retry_delay(attempt: str) -> str:
    """Seconds before the next try, without jitter."""
    return f"least({MAX_DELAY}D, pow(2, least({attempt}, {MAX_EXPONENT})))"


def route_failures(failures: DataFrame, batch: DataFrame, now: str, jitter_seed: int | None = None) -> DataFrame:
    """Failures with ``next_state`` and ``next_attempt_at``.

    Retryable failures wait for the time the destination gave, else for the back-off of the row's
    attempts plus jitter (none without a seed, so that results repeat); others are dead-lettered.
    """
    joined = failures.join(batch.select("event_id", "delivery_attempts"), "event_id")
    jitter = F.lit(0.0) if jitter_seed is None else F.rand(jitter_seed) * F.least(F.lit(float(MAX_JITTER)), F.col("_delay") * JITTER_SHARE)
    given = "retry_after" if "retry_after" in failures.columns else "cast(NULL AS timestamp)"
    return (
        joined.withColumn("_delay", F.expr(retry_delay("delivery_attempts")))
        .withColumn("_wait", F.col("_delay") + jitter)
        .withColumn("next_state", F.when(F.col("retryable"), "retrying").otherwise("dead-lettered"))
        .withColumn(
            "next_attempt_at",
            F.expr(f"IF(retryable, coalesce({given}, {now} + make_dt_interval(0, 0, 0, cast(_wait AS decimal(18, 6)))), NULL)"),
        )
        .drop("_delay", "_wait")
    )


#: What an output adapter tells about an event: acknowledged, with what, or failed, with a code.
RESULT = "event_id string, acknowledged boolean, acknowledgement string, code string, retryable boolean, retry_after timestamp"
Adapter = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def deliver(batch: DataFrame, adapter: Adapter) -> DataFrame:
    """Sends the rows of a batch through an adapter, a function from record batches to results (:data:`RESULT`).

    The adapter runs in the tasks, on the columns that ``batch`` has. Its results are kept before anything reads
    them, as a second run would send again; a task that is lost does send its rows again, so a destination has to
    know rows by their id. A row without a result is neither acknowledged nor failed: its lease runs out.
    """
    return stable(batch.mapInArrow(adapter, RESULT))


def settle(ledger: DataFrame, results: DataFrame, now: str, jitter_seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ledger after the results of a delivery, and the moves that were refused.

    Acknowledged rows are delivered; failed ones wait for another try or are dead-lettered, as :func:`route_failures`
    says. Of several results of a row an acknowledgement counts.
    """
    one = results.groupBy("event_id").agg(F.max_by(F.struct("acknowledged", "acknowledgement", "code", "retryable", "retry_after"), "acknowledged").alias("r")).select("event_id", "r.*")
    done = one.where("acknowledged").selectExpr("event_id", "'delivered' AS action", "cast(NULL AS timestamp) AS next_attempt_at", "cast(NULL AS string) AS failure_code", "coalesce(acknowledgement, event_id) AS acknowledgement")
    failed = one.where("NOT acknowledged").select("event_id", F.coalesce("code", F.lit("unknown")).alias("code"), F.coalesce("retryable", F.lit(False)).alias("retryable"), "retry_after")
    routed = route_failures(failed, ledger, now, jitter_seed)
    lost = routed.selectExpr("event_id", "next_state AS action", "next_attempt_at", "code AS failure_code", "cast(NULL AS string) AS acknowledgement")
    moves = done.unionByName(lost).selectExpr("event_id", "1L AS seq", "action", f"{now} AS at", "cast(NULL AS timestamp) AS lease_until", "next_attempt_at", "failure_code", "acknowledgement")
    return ledger_apply(ledger, moves)
