"""Default-deny telemetry policies, compiled to one expression per policy set."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.sqltext import let, lit, lits, once, struct, when
from telemill.functions.text import parse_decision, present

# The built-in decision for events no policy names.
DEFAULT_DENY_ID = "BWR-POL-DEFAULT-DENY"
DEFAULT_DENY_VERSION = "1.0.0"
DEFAULT_DENY_HASH = "builtin:default-deny-v1"
DEFAULT_DENY_REASON = "No approved policy matched event category and type"

# The field paths a policy may ask for. Any other path counts as absent.
TEXT_PATHS = (
    "schemaVersion",
    "eventId",
    "eventOriginalId",
    "eventCategory",
    "eventType",
    "eventAction",
    "application.name",
    "application.environment",
    "application.tenantId",
    "actor.userId",
    "actor.username",
    "target.id",
    "target.type",
    "source.ipAddress",
    "request.correlationId",
    "request.traceId",
    "eventOutcomeReason",
)
KNOWN_PATHS = (*TEXT_PATHS, "timeGenerated", "eventResult")


@dataclass(frozen=True)
class TelemetryPolicy:
    """One policy document."""

    id: str
    version: str
    event_categories: tuple[str, ...] = ()
    event_types: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    at_least_one: tuple[str, ...] = ()
    recommended: tuple[str, ...] = ()
    action: str = "accept"
    minimum_score: int = 0

    @property
    def hash(self) -> str:
        """Digest of the policy as canonical JSON (our own form)."""
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()

    @classmethod
    def from_document(cls, doc: Mapping) -> TelemetryPolicy:
        """A policy from a parsed YAML or JSON document, with its content checks."""
        if not str(doc.get("apiVersion", "")).endswith("security/v1") or doc.get("kind") != "TelemetryPolicy":
            raise ValueError("unsupported policy apiVersion or kind")
        meta, match = doc.get("metadata") or {}, doc.get("match") or {}
        needs, decision = doc.get("requirements") or {}, doc.get("decision") or {}
        policy = cls(
            id=str(meta.get("id") or "").strip(),
            version=str(meta.get("version") or "").strip(),
            event_categories=tuple(match.get("eventCategories") or ()),
            event_types=tuple(match.get("eventTypes") or ()),
            required=tuple(needs.get("requiredFields") or ()),
            at_least_one=tuple(needs.get("atLeastOne") or ()),
            recommended=tuple(needs.get("recommendedFields") or ()),
            action=str(decision.get("action", "")),
            minimum_score=int(decision.get("minimumValueScore", 0)),
        )
        if not policy.id or not policy.version or not (policy.event_categories or policy.event_types):
            raise ValueError("policy id, version and at least one match value are required")
        parse_decision(policy.action)
        if not 0 <= policy.minimum_score <= 100:
            raise ValueError("minimumValueScore must be between 0 and 100")
        return policy


# The two policies every deployment starts with.
AUTHENTICATION_FAILURE = TelemetryPolicy(
    id="BWR-POL-AUTH-FAILURE",
    version="1.0.0",
    event_categories=("authentication",),
    event_types=("authentication_failure", "account_lockout"),
    required=("timeGenerated", "eventType", "eventResult", "application.name"),
    at_least_one=("actor.userId", "actor.username"),
    recommended=("source.ipAddress", "eventOutcomeReason", "request.correlationId"),
    minimum_score=70,
)
SENSITIVE_DATA_DETECTED = TelemetryPolicy(
    id="BWR-POL-PRIVACY-DETECT",
    version="1.0.0",
    event_categories=("privacy-control",),
    event_types=("sensitive_data_detected",),
    required=("timeGenerated", "eventType", "eventResult", "application.name", "target.id"),
    recommended=("request.correlationId", "eventOutcomeReason", "labels.sourceEventId"),
    minimum_score=80,
)
DEFAULT_POLICIES = (AUTHENTICATION_FAILURE, SENSITIVE_DATA_DETECTED)


def has_value(event: str, path: str) -> str:
    """Whether the envelope has a value at a known path."""
    if path in TEXT_PATHS:
        return present(f"{event}.{path}")
    if path == "timeGenerated":
        return f"({event}.timeGenerated IS NOT NULL)"
    if path == "eventResult":
        return f"coalesce({event}.eventResult <> 'unknown', false)"
    return "false"


def policy_matches(event: str, policy: TelemetryPolicy) -> str:
    """Category and type both match; an empty list matches all."""
    tests = [
        f"{event}.{field} IN ({lits(values)})"
        for field, values in (("eventCategory", policy.event_categories), ("eventType", policy.event_types))
        if values
    ]
    return " AND ".join(tests) or "true"


def missing_fields(event: str, policy: TelemetryPolicy) -> str:
    """Names of required fields without a value, then an unmet at-least-one group."""
    checks = [f"IF({has_value(event, p)}, NULL, {lit(p)})" for p in policy.required]
    if policy.at_least_one:
        any_of = " OR ".join(has_value(event, p) for p in policy.at_least_one)
        checks.append(f"IF({any_of}, NULL, {lit('one-of(' + ','.join(policy.at_least_one) + ')')})")
    return f"array_compact(cast(array({', '.join(checks)}) AS array<string>))"


def value_score(event: str, policy: TelemetryPolicy, missing: str) -> str:
    """Investigation value of an event, 0 to 100."""
    recommended = " + ".join(f"cast({has_value(event, p)} AS int)" for p in policy.recommended) or "0"
    parts = [
        "40",
        f"greatest(0, 30 - 15 * {missing})",
        f"IF({event}.actor IS NOT NULL, 10, 0)",
        f"IF({event}.target IS NOT NULL, 5, 0)",
        f"IF({event}.source IS NOT NULL, 5, 0)",
        f"IF({present(event + '.request.correlationId')}, 10, 0)",
        f"least(5, {recommended})",
    ]
    return f"least(100, {' + '.join(parts)})"


def _policy_decision(event: str, policy: TelemetryPolicy) -> str:
    """Decision struct of one matching policy."""
    ids = dict(policyId=lit(policy.id), policyVersion=lit(policy.version), policyHash=lit(policy.hash))
    quarantine = struct(
        action="'quarantine'",
        **ids,
        score="score",
        reasons="transform(missing, m -> concat('Missing required field: ', m))",
        warnings="cast(array() AS array<string>)",
    )
    low = f"score < {policy.minimum_score}"
    absent = ", ".join(
        f"IF({has_value(event, p)}, NULL, {lit('Missing recommended field: ' + p)})" for p in policy.recommended
    )
    verdict = f"concat('Value score ', score, IF({low}, ' is below minimum ', ' meets minimum '), {policy.minimum_score})"
    decided = struct(
        action=f"IF({low}, 'reject', {lit(parse_decision(policy.action))})",
        **ids,
        score="score",
        reasons=(
            f"array(concat('Approved semantic event type: ', {event}.eventType), "
            f"'All required investigation fields present', {verdict})"
        ),
        warnings=f"array_compact(cast(array({absent}) AS array<string>))",
    )
    scored = let("score", value_score(event, policy, "size(missing)"), f"IF(size(missing) > 0, {quarantine}, {decided})")
    return let("missing", missing_fields(event, policy), scored)


def decision_sql(event: str, policies: Iterable[TelemetryPolicy]) -> str:
    """Decision struct: the first matching policy by id decides, no match rejects."""
    ordered = sorted(policies, key=lambda p: p.id)
    denied = struct(
        action="'reject'",
        policyId=lit(DEFAULT_DENY_ID),
        policyVersion=lit(DEFAULT_DENY_VERSION),
        policyHash=lit(DEFAULT_DENY_HASH),
        score="0",
        reasons=f"array({lit(DEFAULT_DENY_REASON)})",
        warnings="cast(array() AS array<string>)",
    )
    return when([(policy_matches(event, p), _policy_decision(event, p)) for p in ordered], denied)


def evaluate_policies(
    df: DataFrame, policies: Sequence[TelemetryPolicy] = DEFAULT_POLICIES, event: str = "event", output: str = "decision"
) -> DataFrame:
    """Adds ``struct<action, policyId, policyVersion, policyHash, score, reasons, warnings>``."""
    return df.transform(once, output, f"IF({event} IS NULL, NULL, {decision_sql(event, policies)})")
