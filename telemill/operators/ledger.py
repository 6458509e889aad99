"""The delivery ledger: rows with a delivery state, and what is done with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.sqltext import lit, lookup, struct

# Delivery states.
QUEUED, UPLOADING, RETRYING, DELIVERED, DEAD_LETTERED = 0, 1, 2, 3, 4
STATE_NAMES = {QUEUED: "queued", UPLOADING: "uploading", RETRYING: "retrying", DELIVERED: "delivered", DEAD_LETTERED: "dead-lettered"}
MAX_LEASE = 10_000

LEDGER = (
    "event_id string, fingerprint string, payload string, payload_bytes bigint, received_at timestamp, state int, "
    "delivery_attempts int, lease_until timestamp, next_attempt_at timestamp, last_failure_code string, "
    "acknowledgement string, delivered_at timestamp"
)
TRANSITION = (
    "event_id string, seq bigint, action string, at timestamp, lease_until timestamp, next_attempt_at timestamp, "
    "failure_code string, acknowledgement string"
)


def ledger_snapshot(ledger: DataFrame) -> DataFrame:
    """One row: count per state, total bytes, oldest undelivered row. Reads no payload."""
    counts = [F.count_if(F.col("state") == s).alias(name.replace("-", "_")) for s, name in STATE_NAMES.items()]
    return ledger.agg(
        *counts,
        F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("total_bytes"),
        F.min(F.when(F.col("state").isin(QUEUED, UPLOADING, RETRYING), F.col("received_at"))).alias("oldest_undelivered"),
    )


def ledger_bytes(ledger: DataFrame) -> DataFrame:
    """One row: total payload bytes."""
    return ledger.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("total_bytes"))


def is_due(now: str) -> str:
    """Queued, due for a retry, or with an expired lease."""
    return (
        f"(state = {QUEUED} OR (state = {RETRYING} AND (next_attempt_at IS NULL OR next_attempt_at <= {now})) "
        f"OR (state = {UPLOADING} AND lease_until <= {now}))"
    )


def due_for_delivery(ledger: DataFrame, now: str, limit: int) -> DataFrame:
    """The next rows to deliver, oldest first (a bounded top-k)."""
    if not 1 <= limit <= MAX_LEASE:
        raise ValueError(f"limit must be between 1 and {MAX_LEASE}")
    return ledger.filter(F.expr(is_due(now))).orderBy("received_at", "event_id").limit(limit)


def lease(due: DataFrame, now: str, duration: str) -> DataFrame:
    """Rows as they are after leasing: uploading, one more attempt, lease set. ``duration`` is SQL."""
    return due.withColumns(
        {
            "state": F.lit(UPLOADING),
            "delivery_attempts": F.col("delivery_attempts") + 1,
            "lease_until": F.expr(f"{now} + {duration}"),
        }
    )


#: Results of an attempt: the state they lead to and what they have to bring. Only *uploading* rows have results.
RESULTS = {
    "delivered": (DELIVERED, "acknowledgement"),
    "retrying": (RETRYING, "failure_code"),
    "dead-lettered": (DEAD_LETTERED, "failure_code"),
}
# What each transition does to the row; only *lease* may start from a state other than uploading.
_ALLOWED = {
    "lease": (
        f"row.state = {QUEUED} OR (row.state = {RETRYING} AND (row.next_attempt_at IS NULL OR row.next_attempt_at <= t.at)) "
        f"OR (row.state = {UPLOADING} AND row.lease_until <= t.at)"
    ),
    **{action: f"row.state = {UPLOADING} AND coalesce(t.{needs}, '') <> ''" for action, (_, needs) in RESULTS.items()},
}
_NEXT_STATE = {"lease": UPLOADING, **{action: to for action, (to, _) in RESULTS.items()}}
_STATE = (
    "struct<state:int,delivery_attempts:int,lease_until:timestamp,next_attempt_at:timestamp,"
    "last_failure_code:string,acknowledgement:string,delivered_at:timestamp>"
)


def ledger_apply(ledger: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folds transitions into the ledger in ``seq`` order; illegal moves leave the row unchanged.

    Returns the ledger after the moves and one row per refused move. The fold is per event id, whose
    transitions are few by nature (every delivery attempt adds two); payloads do not take part in the
    grouping and are joined back by id.
    """
    moves = transitions.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "action", "at", "lease_until", "next_attempt_at", "failure_code", "acknowledgement"))).alias("_moves")
    )
    allowed = "CASE " + " ".join(f"WHEN t.action = {lit(a)} THEN {test}" for a, test in _ALLOWED.items()) + " ELSE false END"
    target = "CASE " + " ".join(f"WHEN t.action = {lit(a)} THEN {s}" for a, s in _NEXT_STATE.items()) + " END"
    after = struct(
        state=f"cast({target} AS int)",
        delivery_attempts="row.delivery_attempts + IF(t.action = 'lease', 1, 0)",
        lease_until="IF(t.action = 'lease', t.lease_until, NULL)",
        next_attempt_at="CASE WHEN t.action = 'retrying' THEN t.next_attempt_at WHEN t.action = 'lease' THEN row.next_attempt_at END",
        last_failure_code="CASE WHEN t.action IN ('retrying', 'dead-lettered') THEN t.failure_code WHEN t.action = 'lease' THEN row.last_failure_code END",
        acknowledgement="IF(t.action = 'delivered', t.acknowledgement, row.acknowledgement)",
        delivered_at="IF(t.action = 'delivered', t.at, row.delivered_at)",
    )
    start = struct(
        row=f"cast(struct(state, delivery_attempts, lease_until, next_attempt_at, last_failure_code, acknowledgement, delivered_at) AS {_STATE})",
        refused="cast(array() AS array<struct<seq:bigint,action:string,from_state:int>>)",
    )
    refuse = "array_append(acc.refused, named_struct('seq', t.seq, 'action', t.action, 'from_state', row.state))"
    step = (
        "element_at(transform(array(acc.row), row -> "
        f"IF(coalesce({allowed}, false), named_struct('row', cast({after} AS {_STATE}), 'refused', acc.refused), "
        f"named_struct('row', row, 'refused', {refuse}))), 1)"
    )
    fold = f"aggregate(coalesce(_moves, array()), {start}, (acc, t) -> {step})"
    state_columns = ("state", "delivery_attempts", "lease_until", "next_attempt_at", "last_failure_code", "acknowledgement", "delivered_at")
    # Slim rows go through the fold; unknown event ids stay visible as refused moves.
    folded = (
        moves.join(ledger.select("event_id", *state_columns), "event_id", "left")
        .withColumn("_f", F.expr(fold))
        .select("event_id", F.col("_f.row").alias("_row"), F.col("_f.refused").alias("_refused"))
    )
    updated = ledger.join(folded.select("event_id", "_row"), "event_id", "left").select(
        *[
            F.when(F.col("_row").isNull(), F.col(c)).otherwise(F.col(f"_row.{c}")).alias(c) if c in state_columns else F.col(c)
            for c in ledger.columns
        ]
    )
    refused = folded.select("event_id", F.explode("_refused").alias("r")).select("event_id", "r.*")
    return updated, refused


def latest_state(transitions: DataFrame) -> DataFrame:
    """Last transition per event of an append-only log."""
    rest = [c for c in transitions.columns if c not in ("event_id",)]
    return transitions.groupBy("event_id").agg(F.max_by(F.struct(*rest), "seq").alias("_t")).select("event_id", "_t.*")


def state_name(state: str) -> str:
    """Name of a state number."""
    return lookup(f"cast({state} AS string)", {str(k): v for k, v in STATE_NAMES.items()}, "NULL")
