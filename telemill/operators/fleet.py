"""Collector fleet: life cycle folded from events, details, overview and lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.sqltext import struct
from telemill.operators.ordinals import ordered_blocks

# Collector statuses.
STATUSES = ("Pending", "Approved", "Active", "Suspended", "Revoked")
STALE_AFTER = "INTERVAL 15 MINUTES"
EXCEPTIONS = 12
LATEST_APPROVALS = 250
LATEST_AUDIT = 500

SOURCE_REPORT = "struct<source_id:string,type:string,status:string,lag_seconds:bigint,last_event_at:timestamp>"
OUTPUT_REPORT = "struct<output_id:string,type:string,status:string,last_acknowledged_at:timestamp,last_error_code:string>"

# One row per thing that happened to a collector: 'register', 'heartbeat' or 'decide'.
FLEET_EVENT = (
    "collector_id string, seq bigint, kind string, at timestamp, principal string, machine_name string, environment string, "
    "version string, configuration_hash string, policy_hash string, queue_depth bigint, delivery_status string, "
    f"sources array<{SOURCE_REPORT}>, outputs array<{OUTPUT_REPORT}>, action string, target_status string, reason string, actor_name string"
)
_STATE = (
    "struct<machine_name:string,environment:string,version:string,status:string,principal:string,first_seen_at:timestamp,"
    "last_seen_at:timestamp,configuration_hash:string,policy_hash:string,queue_depth:bigint,delivery_status:string,"
    "reports_seq:bigint>"
)
_LOG = "struct<seq:bigint,kind:string,at:timestamp,action:string,principal:string,outcome:string>"

#: Decisions: the statuses they may start from and the one they have to lead to.
DECISIONS = {
    "approved": (("Pending",), "Approved"),
    "rejected": (("Pending",), "Revoked"),
    "suspended": (("Approved", "Active"), "Suspended"),
    "revoked": (("Pending", "Approved", "Active", "Suspended"), "Revoked"),
}
LONGEST_REASON = 500

#: What the order of events decides on: it alone passes through the fold, with the principal that owns a collector.
_SLIM = ("seq", "kind", "at", "principal", "machine_name", "environment", "version", "configuration_hash", "policy_hash",
         "queue_depth", "delivery_status", "action", "target_status", "reason")


def identity(owner: str | None, principal: str | None) -> str:
    """How an event's principal relates to the collector's: ``none`` (no owner yet), ``same`` or ``other``."""
    if owner is None:
        return "none"
    return "other" if principal is not None and principal != owner else "same"


def has_reason(reason: str | None) -> bool:
    """Whether a decision gives a reason of a legal length."""
    return bool(reason and reason.strip() and len(reason) <= LONGEST_REASON)


@lru_cache(maxsize=4096)
def transitions(kind: str | None, action: str | None, target: str | None, reason: bool, relation: str) -> dict[str | None, tuple[str, str | None]]:
    """What an event does: for each status (null: unknown collector) the outcome and the status after it."""
    found = {}
    for status in (None, *STATUSES):
        after = status
        if kind == "register":
            outcome = "identity-conflict" if relation == "other" else "ok"
            after = status or "Pending"
        elif kind == "heartbeat":
            if relation != "same" or status is None:
                outcome = "unknown-collector"
            else:
                outcome, after = ("ok", "Active") if status in ("Approved", "Active") else ("state-conflict", status)
        elif kind == "decide":
            sources, leads_to = DECISIONS.get(action, ((), None))
            if not reason:
                outcome = "reason-required"
            elif status is None:
                outcome = "unknown-collector"
            else:
                outcome, after = ("ok", target) if status in sources and target == leads_to else ("state-conflict", status)
        else:
            outcome = "unknown-kind"
        found[status] = (outcome, after if outcome == "ok" else status)
    return found


def next_owner(owner: str | None, kind: str | None, principal: str | None) -> str | None:
    """The owner after an event: the principal of the first registration; one without a principal frees the collector."""
    return principal if kind == "register" and identity(owner, principal) != "other" else owner


def _groups(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple]:
    """The rows of a block as tuples, in order."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


_BORDER = "block int, place int, collector_id string, start_status string, start_owner string, resets boolean, owner string, statuses array<string>"


def _borders(batches: Iterator[pa.RecordBatch], owners: dict[int, str | None] | None) -> Iterator[pa.RecordBatch]:
    """What a block does to its first and its last collector, whose events may go beyond it.

    First the owner: ``resets`` if it does not depend on the owner before, and the owner then (else the one that
    an unowned collector gets). Once the owners before each block are known, the status: for each status before,
    null first, the one after the block's events, a map that composes with those of other blocks.
    """
    names = ("_block", "collector_id", "start_status", "start_owner", "kind", "principal", "action", "target_status", "reason")
    found: list[list] = []
    current = None
    for block, collector, status, owner, kind, principal, action, target, reason in _groups(batches, names):
        if current is None or collector != current[2]:
            # Only the first and the last collector of a block are told.
            found = [found[0], None] if found else []
            place = 0 if not found else 1
            known = owner if owners is None or place else owners.get(block, owner)
            current = [block, place, collector, status, owner, False, known if owners is not None else None, [None, *STATUSES]]
            found = [current] if not found else [found[0], current]
        if owners is None:
            if kind == "register":
                if principal is None:
                    current[5], current[6] = True, None
                elif current[6] is None:
                    current[6] = principal
        else:
            relation = identity(current[6], principal)
            step = transitions(kind, action, target, has_reason(reason), relation)
            current[7] = [step[s][1] for s in current[7]]
            current[6] = next_owner(current[6], kind, principal)
    columns = list(zip(*found)) or [()] * 8
    types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _BORDER.split(", ")])


def _chained(blocks: DataFrame) -> dict[int, tuple[str | None, str | None]]:
    """Owner and status of each block's first collector before the block, where its events began in another one.

    Two rows for each block reach the driver, and blocks are as many as sort partitions.
    """

    def walk(rows: list, after) -> dict:
        before, ends = {}, {}
        previous = None
        for row in sorted(rows, key=lambda r: (r.block, r.place)):
            goes_on = previous is not None and row.place == 0 and previous == row.collector_id
            start = ends[previous] if goes_on else None
            if goes_on:
                before[row.block] = start
            ends = {row.collector_id: after(row, start, goes_on)}
            previous = row.collector_id
        return before

    def owner_after(row, start, goes_on):
        first = start if goes_on else row.start_owner
        return row.owner if row.resets or first is None else first

    def status_after(row, start, goes_on):
        first = start if goes_on else row.start_status
        return row.statuses[(None, *STATUSES).index(first)]

    owners = walk(blocks.mapInArrow(lambda b: _borders(b, None), _BORDER).collect(), owner_after)
    statuses = walk(blocks.mapInArrow(lambda b: _borders(b, owners), _BORDER).collect(), status_after)
    return {block: (owners[block], statuses[block]) for block in owners}


def fleet_fold(events: DataFrame) -> DataFrame:
    """Folds the events of every collector in ``seq`` order.

    Gives an outcome per event, ``ok``, ``identity-conflict``, ``unknown-collector``, ``state-conflict``,
    ``reason-required`` or ``unknown-kind``, and the state of each collector after its events: rows
    ``collector_id, log`` and ``collector_id, state``, see :func:`fleet_outcomes` and :func:`fleet_state`.

    Events are sorted once and cut into blocks; a collector of any number of events is spread over many of them.
    What a block does to a status is a map over the six statuses, and such maps compose, so the status at a block's
    start follows from the maps of the blocks before, and every block is then walked by itself. No list of a
    collector's events is ever made. Reports and other wide values stay out of the fold.
    """
    return fold_from(None, events)


def fold_from(snapshot: DataFrame | None, events: DataFrame) -> DataFrame:
    """As :func:`fleet_fold`, starting from earlier states ``collector_id, state`` (rows of another kind are ignored)."""
    if snapshot is None:
        earlier = None
        slim = events.select("collector_id", *_SLIM, F.lit(None).cast("string").alias("start_status"), F.lit(None).cast("string").alias("start_owner"))
    else:
        earlier = snapshot.where("state IS NOT NULL").select("collector_id", F.col("state").alias("_start"))
        begin = earlier.select("collector_id", F.col("_start.status").alias("start_status"), F.col("_start.principal").alias("start_owner"))
        slim = events.select("collector_id", *_SLIM).join(begin, "collector_id", "left")
    blocks = ordered_blocks(slim, ["collector_id"], list(_SLIM))
    before = _chained(blocks)
    names = ["collector_id", *_SLIM]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, owner, status, number = None, None, None, 0
        for batch in batches:
            outcomes, statuses, owners, places = [], [], [], []
            for row in _groups(iter([batch]), ("_block", "collector_id", "start_status", "start_owner", "kind", "principal", "action", "target_status", "reason")):
                block, collector, start_status, start_owner, kind, principal, action, target, reason = row
                if number == 0 or collector != current:
                    owner, status = before.get(block, (start_owner, start_status)) if number == 0 else (start_owner, start_status)
                    current = collector
                outcome, status = transitions(kind, action, target, has_reason(reason), identity(owner, principal))[status]
                owner = next_owner(owner, kind, principal)
                outcomes.append(outcome)
                statuses.append(status)
                owners.append(owner)
                places.append(block << 40 | number)
                number += 1
            more = [pa.array(outcomes, pa.string()), pa.array(statuses, pa.string()), pa.array(owners, pa.string()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], names=[*names, "outcome", "status", "owner", "place"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.select(names).schema)
    walked = blocks.mapInArrow(walk, f"{types}, outcome string, status string, owner string, place bigint")

    ok = F.col("outcome") == "ok"
    place = lambda *kinds: F.when(ok & F.col("kind").isin(*kinds), F.col("place"))
    ends = walked.groupBy("collector_id").agg(
        F.max_by(F.struct("status", "owner"), "place").alias("last"),
        F.min_by("at", F.when(F.col("at").isNotNull(), place("register"))).alias("first_at"),
        F.max_by(F.struct("machine_name", "environment"), place("register")).alias("made"), F.max(place("register")).alias("made_at"),
        F.max_by(F.struct("seq", "at", "version", "configuration_hash", "policy_hash"), place("register", "heartbeat")).alias("told"),
        F.max_by(F.struct("queue_depth", "delivery_status"), place("heartbeat")).alias("beat"), F.max(place("heartbeat")).alias("beat_at"),
    )
    ends = ends.withColumn("_start", F.expr(f"cast(NULL AS {_STATE})")) if earlier is None else ends.join(earlier, "collector_id", "full")
    # A registration gives a depth and a delivery status to a collector that has none.
    filled = "made_at IS NOT NULL AND (beat_at IS NULL OR made_at > beat_at)"
    kept = lambda name: f"IF(beat_at IS NULL, _start.{name}, beat.{name})"
    state = struct(
        machine_name="IF(made_at IS NULL, _start.machine_name, made.machine_name)",
        environment="IF(made_at IS NULL, _start.environment, made.environment)",
        version="IF(told IS NULL, _start.version, told.version)", status="IF(last IS NULL, _start.status, last.status)",
        principal="IF(last IS NULL, _start.principal, last.owner)", first_seen_at="coalesce(_start.first_seen_at, first_at)",
        last_seen_at="IF(told IS NULL, _start.last_seen_at, told.at)",
        configuration_hash="IF(told IS NULL, _start.configuration_hash, told.configuration_hash)",
        policy_hash="IF(told IS NULL, _start.policy_hash, told.policy_hash)",
        queue_depth=f"IF({filled}, coalesce({kept('queue_depth')}, 0L), {kept('queue_depth')})",
        delivery_status=f"IF({filled}, coalesce({kept('delivery_status')}, 'unknown'), {kept('delivery_status')})",
        reports_seq="IF(told IS NULL, _start.reports_seq, told.seq)",
    )
    known = "coalesce(last.status, _start.status) IS NOT NULL"
    states = ends.select("collector_id", F.expr(f"IF({known}, cast({state} AS {_STATE}), NULL)").alias("state"), F.expr(f"cast(NULL AS {_LOG})").alias("log"))
    logs = walked.select("collector_id", F.expr(f"cast(NULL AS {_STATE})").alias("state"), F.struct("seq", "kind", "at", "action", "principal", "outcome").cast(_LOG).alias("log"))
    return states.unionByName(logs)


def fleet_state(folded: DataFrame) -> DataFrame:
    """Current row of every known collector."""
    return folded.filter("state IS NOT NULL").select("collector_id", "state.*")


def fleet_outcomes(folded: DataFrame) -> DataFrame:
    """One row per event with its outcome."""
    return folded.filter("log IS NOT NULL").select("collector_id", "log.*")


def fleet_audit(folded: DataFrame) -> DataFrame:
    """Audit rows: accepted registrations and decisions."""
    return (
        fleet_outcomes(folded)
        .filter("outcome = 'ok' AND kind IN ('register', 'decide')")
        .select("collector_id", "seq", "at", "principal", F.expr("concat('collector.', IF(kind = 'register', 'registered', action))").alias("event"))
    )


def current_reports(states: DataFrame, events: DataFrame, what: str) -> DataFrame:
    """Source or output rows of the last accepted report of every collector (older ones are replaced)."""
    if what not in ("sources", "outputs"):
        raise ValueError("what must be 'sources' or 'outputs'")
    last = states.select("collector_id", F.col("reports_seq").alias("seq"))
    # By its files' size Spark takes a table for small whose rows grow here, and would hold all reports in every task.
    return (
        events.select("collector_id", "seq", what)
        .hint("merge")
        .join(last, ["collector_id", "seq"])
        .select("collector_id", F.explode(what).alias("r"))
        .select("collector_id", "r.*")
    )


def collector_details(collectors: DataFrame, sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """Collectors with their sources and outputs as sorted arrays."""

    def nested(rows: DataFrame, key: str, name: str) -> DataFrame:
        rest = [c for c in rows.columns if c != "collector_id"]
        ordered = [key, *[c for c in rest if c != key]]
        return rows.groupBy("collector_id").agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias(name))

    return (
        collectors.join(nested(sources, "source_id", "sources"), "collector_id", "left")
        .join(nested(outputs, "output_id", "outputs"), "collector_id", "left")
        .withColumn("sources", F.coalesce("sources", F.array()))
        .withColumn("outputs", F.coalesce("outputs", F.array()))
    )


def not_healthy(column: str) -> str:
    """Any status but healthy, case ignored."""
    return f"lower({column}) <> 'healthy'"


def fleet_overview(collectors: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """One row of fleet counters."""
    stale = f"last_seen_at < {now} - {STALE_AFTER}"
    totals = collectors.agg(
        F.count("*").alias("total"),
        F.expr("count_if(status = 'Pending')").alias("pending"),
        F.expr(f"count_if(status IN ('Suspended', 'Revoked') OR {not_healthy('delivery_status')})").alias("unhealthy"),
        F.expr(f"count_if({stale})").alias("stale"),
        F.coalesce(F.sum("queue_depth"), F.lit(0)).alias("queue_depth"),
    )
    seen = sources.agg(
        F.expr("count_if(lower(status) = 'healthy')").alias("healthy_sources"),
        F.expr(f"count_if({not_healthy('status')})").alias("degraded_sources"),
    )
    return totals.crossJoin(seen)  # one row each


def fleet_exceptions(collectors: DataFrame, now: str) -> DataFrame:
    """The first collectors that need attention, most recently seen first (a top-k report)."""
    test = (
        f"status IN ('Pending', 'Suspended', 'Revoked') OR last_seen_at < {now} - {STALE_AFTER} "
        f"OR {not_healthy('delivery_status')}"
    )
    return list_collectors(collectors.filter(test)).limit(EXCEPTIONS)


def list_collectors(collectors: DataFrame, status: str | None = None) -> DataFrame:
    """Collectors by last contact, newest first."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    rows = collectors if status is None else collectors.filter(F.col("status") == F.lit(status))
    return rows.orderBy(F.col("last_seen_at").desc(), "collector_id")


def latest_approvals(approvals: DataFrame) -> DataFrame:
    """The newest approvals (a top-k report)."""
    return approvals.orderBy(F.col("occurred_at").desc(), "id").limit(LATEST_APPROVALS)


def latest_audit(audit: DataFrame) -> DataFrame:
    """The newest audit rows (a top-k report)."""
    return audit.orderBy(F.col("occurred_at").desc(), "id").limit(LATEST_AUDIT)
