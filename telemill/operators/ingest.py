"""The ingest pipeline: candidate JSON to accepted, quarantined and rejected events with alerts.

Everything up to the fingerprint is one narrow stage without a shuffle, on batch and stream alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill import schema as S
from telemill.functions.fingerprint import event_fingerprint
from telemill.functions.sqltext import let, lit, once, struct, when
from telemill.operators import envelope, policy
from telemill.operators.privacy import engine, jsonwalk
from telemill.operators.privacy.detectors import Detector
from telemill.operators.privacy.policy import PrivacyPolicy

PRIVACY_USER = "telemill.privacy-engine"
PRIVACY_DISPLAY = "Privacy & Secret Protection"


@dataclass(frozen=True)
class CollectorIdentity:
    """Who collected the events."""

    id: str
    version: str
    source_adapter: str
    configuration_hash: str

    def sql(self, now: str) -> str:
        return struct(
            id=lit(self.id),
            version=lit(self.version),
            sourceAdapter=lit(self.source_adapter),
            configurationHash=lit(self.configuration_hash),
            batchId="cast(NULL AS string)",
            receivedAt=now,
        )


def with_fields(event: str, changes: dict[str, str]) -> str:
    """The envelope struct with some members replaced."""
    return struct(**{name: changes.get(name, f"{event}.{name}") for name in S.ENVELOPE_FIELDS})


def arrange_sql(event: str, decision: str, redaction: str, collector: str, now: str) -> str:
    """Envelope with decision and collector context.

    Any finding makes the decision *redact and accept*, even one whose action leaves the text alone.
    """
    touched = (
        f"size({redaction}.removed_paths) > 0 OR size({redaction}.masked_paths) > 0 "
        f"OR size({redaction}.privacy.detected) > 0"
    )
    security = struct(
        policyId=f"{decision}.policyId",
        policyVersion=f"{decision}.policyVersion",
        valueScore=f"{decision}.score",
        decision=f"IF({touched}, 'redactAndAccept', 'accept')",
        classificationReasons=f"{decision}.reasons",
        policyHash=f"{decision}.policyHash",
    )
    return with_fields(
        event,
        {"timeObserved": f"coalesce({event}.timeObserved, {now})", "security": security, "collector": collector},
    )


def alert_severity(detected: str) -> str:
    """High for secrets, key material, cards, tax file numbers and secret field names."""
    high = (
        "startswith(d, 'secret.') OR startswith(d, 'crypto.') "
        "OR substring_index(d, ':', 1) IN ('fin.credit-card', 'au.tfn', 'field-name-secret')"
    )
    return f"IF(exists({detected}, d -> {high}), 'high', 'medium')"


def alert_sql(event: str, redaction: str, collector: str, now: str) -> str:
    """Security event about what the privacy controls did to another event; null when nothing is worth it.

    The id is derived from the source event and the detector set, so a replay gives the same alert.
    """
    worthy = f"filter({redaction}.privacy.detected, d -> {engine.is_alert_worthy('d')})"
    labels = (
        f"map('sourceEventId', {event}.eventId, 'sourceEventType', {event}.eventType, "
        f"'sourceEventCategory', {event}.eventCategory, 'detectorFingerprint', detector_set)"
    )
    request = struct(
        correlationId=f"coalesce({event}.request.correlationId, {event}.eventId)",
        **{k: f"{event}.request.{k}" for k in ("traceId", "sessionId", "method", "path", "statusCode")},
    )
    actor = struct(
        userId="cast(NULL AS string)",
        username=lit(PRIVACY_USER),
        displayName=lit(PRIVACY_DISPLAY),
        type="'system'",
        role="cast(NULL AS string)",
    )
    actions = (
        f"map_filter({redaction}.privacy.actions, (k, v) -> exists(worthy, d -> substring_index(d, ':', 1) = k))"
    )
    values = {
        "schemaVersion": lit(S.SCHEMA_VERSION),
        "eventId": f"left(concat('privacy-', {event}.eventId, '-', left(sha2(detector_set, 256), 32)), 128)",
        "eventOriginalId": f"left(concat({event}.eventId, ':', detector_set), 128)",
        "timeGenerated": now,
        "timeObserved": now,
        "eventCategory": "'privacy-control'",
        "eventType": "'sensitive_data_detected'",
        "eventAction": "'privacy.control.applied'",
        "eventResult": "'success'",
        "eventSeverity": alert_severity("worthy"),
        "eventOutcomeReason": "concat('Privacy engine applied controls for ', size(worthy), ' high-risk finding(s)')",
        "application": f"{event}.application",
        "actor": actor,
        "target": struct(type="'telemetry_event'", id=f"{event}.eventId", name=f"{event}.eventType"),
        "source": f"{event}.source",
        "request": request,
        "change": f"cast(NULL AS {S.CHANGE})",
        "security": f"cast(NULL AS {S.SECURITY})",
        "collector": collector,
        "labels": labels,
        "attributes": f"cast(NULL AS {S.ATTRIBUTES})",
        "privacy": struct(detected="worthy", actions=actions),
    }
    body = let("detector_set", "array_join(worthy, ',')", struct(**values))
    return let("worthy", worthy, f"IF({event} IS NULL OR size(worthy) = 0, NULL, {body})")


def process(
    candidates: DataFrame,
    collector: CollectorIdentity,
    now: str,
    policies: Sequence[policy.TelemetryPolicy] = policy.DEFAULT_POLICIES,
    privacy: PrivacyPolicy | None = None,
    detectors: Sequence[Detector] | None = None,
    column: str = "raw",
    strict: bool = False,
) -> DataFrame:
    """One row per candidate with what became of it.

    Adds ``event`` (arranged when accepted), ``action``, ``reasons``, ``decision``, ``fingerprint``,
    ``redaction`` and ``alert`` (an accepted alert envelope or null). The raw text is dropped: it may
    hold what was redacted. ``now`` is a SQL timestamp expression.
    """
    who = collector.sql(now)
    redacted = jsonwalk.redact_json(candidates, column, privacy, detectors).withColumn("_json", F.col("redaction.json"))
    decoded = envelope.decode_envelope(redacted, "_json", "event")
    checked = envelope.validate_envelope(decoded, now, "event", "failures", strict)
    judged = policy.evaluate_policies(checked, policies, "event", "_policy")

    accepted = "event IS NOT NULL AND size(failures) = 0 AND _policy.action IN ('accept', 'redactAndAccept')"
    draft = judged.withColumn("_accepted", F.expr(accepted)).transform(once, "_alert", alert_sql("event", "redaction", who, now))
    # The alert is an event like any other: it needs a policy that accepts it.
    alerts = policy.evaluate_policies(draft, policies, "_alert", "_alert_policy")
    alert_security = struct(
        policyId="_alert_policy.policyId",
        policyVersion="_alert_policy.policyVersion",
        valueScore="_alert_policy.score",
        decision="'accept'",
        classificationReasons="_alert_policy.reasons",
        policyHash="_alert_policy.policyHash",
    )
    settled = alerts.transform(
        once,
        "alert",
        "IF(_alert_policy.action IN ('accept', 'redactAndAccept'), " + with_fields("_alert", {"security": alert_security}) + ", NULL)",
    ).transform(once, "_arranged", f"IF(_accepted, {arrange_sql('event', '_policy', 'redaction', who, now)}, event)")

    action = when(
        [
            ("redaction.failure_code IS NOT NULL OR decode_failure IS NOT NULL OR size(failures) > 0", "'quarantine'"),
            ("_accepted", "_arranged.security.decision"),
        ],
        "_policy.action",
    )
    extra = (
        "array_compact(array("
        "IF(size(redaction.removed_paths) > 0, concat('Removed ', size(redaction.removed_paths), ' prohibited field(s)'), NULL), "
        "IF(size(redaction.masked_paths) > 0, concat('Masked ', size(redaction.masked_paths), ' personal field(s)'), NULL), "
        "IF(alert IS NOT NULL, concat('Emitted privacy alert event ', alert.eventId), NULL)))"
    )
    reasons = when(
        [
            ("redaction.failure_code IS NOT NULL", "array(redaction.failure_code)"),
            ("decode_failure IS NOT NULL", "array(decode_failure)"),
            ("size(failures) > 0", "failures"),
            ("_accepted", f"concat(_policy.reasons, _policy.warnings, {extra})"),
        ],
        "concat(_policy.reasons, _policy.warnings)",
    )
    return (
        settled.withColumn("action", F.expr(action))
        .withColumn("reasons", F.expr(reasons))
        .withColumn("decision", F.expr("IF(size(failures) > 0, NULL, _policy)"))
        .withColumn("event", F.col("_arranged"))
        .withColumn("fingerprint", F.expr(f"IF(_accepted, {event_fingerprint('_arranged.')}, NULL)"))
        .withColumn("accepted", F.col("_accepted"))
        .drop(column, "_json", "_policy", "_accepted", "_alert", "_alert_policy", "_arranged", "failures", "decode_failure")
    )


def to_queue(processed: DataFrame, now: str) -> DataFrame:
    """Accepted events and their alerts as ledger rows (one pass over the input)."""
    alert_print = event_fingerprint("alert.")
    rows = (
        "array_compact(array("
        "IF(accepted, named_struct('event', event, 'fingerprint', fingerprint, 'is_alert', false), NULL), "
        f"IF(alert IS NOT NULL, named_struct('event', alert, 'fingerprint', {alert_print}, 'is_alert', true), NULL)))"
    )
    exploded = processed.select(F.explode(F.expr(rows)).alias("q"))
    return exploded.select(
        F.col("q.event.eventId").alias("event_id"),
        F.col("q.fingerprint").alias("fingerprint"),
        F.to_json("q.event").alias("payload"),
        F.expr(now).alias("received_at"),
        F.col("q.is_alert").alias("is_alert"),
    ).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))


def ingest_status(df: DataFrame, action: str = "action", queued: str = "queued", duplicate: str = "duplicate") -> DataFrame:
    """Adds the status code a caller would see: 202 new, 200 duplicate, 422 rejected, 400 otherwise."""
    code = when([(queued, "202"), (duplicate, "200"), (f"{action} = 'reject'", "422")], "400")
    return df.withColumn("status", F.expr(code))
