"""Fixed schemas: the event envelope, the normalised event and their value lists."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0.0"

# Enumerations of the envelope, in declaration order.
EVENT_RESULTS = ("unknown", "success", "failure", "denied")
EVENT_SEVERITIES = ("informational", "low", "medium", "high", "critical")
ACTOR_TYPES = ("human", "service", "machine", "system", "unknown")
DECISIONS = ("accept", "reject", "sample", "aggregate", "redactAndAccept", "quarantine", "deadLetter")

# Known event types and categories.
EVENT_TYPES = (
    "authentication_failure",
    "authentication_success",
    "account_lockout",
    "role_membership_changed",
    "sensitive_data_exported",
    "sensitive_data_detected",
    "collector_started",
    "collector_upload_failed",
    "telemetry_aggregation_summary",
)
EVENT_CATEGORIES = (
    "authentication",
    "authorisation",
    "identity-management",
    "administrative-activity",
    "data-access",
    "application-security",
    "api-security",
    "collector-health",
    "privacy-control",
)

APPLICATION = "struct<name:string,version:string,environment:string,instance:string,tenantId:string>"
ACTOR = "struct<userId:string,username:string,displayName:string,type:string,role:string>"
TARGET = "struct<type:string,id:string,name:string>"
SOURCE = "struct<ipAddress:string,hostname:string,port:int>"
REQUEST = "struct<correlationId:string,traceId:string,sessionId:string,method:string,path:string,statusCode:int>"
CHANGE = "struct<field:string,previousValue:string,newValue:string>"
SECURITY = (
    "struct<policyId:string,policyVersion:string,valueScore:int,decision:string,"
    "classificationReasons:array<string>,policyHash:string>"
)
COLLECTOR = (
    "struct<id:string,version:string,sourceAdapter:string,configurationHash:string,"
    "batchId:string,receivedAt:timestamp>"
)
PRIVACY = "struct<detected:array<string>,actions:map<string,string>>"
LABELS = "map<string,string>"
ATTRIBUTES = "map<string,variant>"

# Column name to Spark type, in envelope order.
ENVELOPE_FIELDS = {
    "schemaVersion": "string",
    "eventId": "string",
    "eventOriginalId": "string",
    "timeGenerated": "timestamp",
    "timeObserved": "timestamp",
    "eventCategory": "string",
    "eventType": "string",
    "eventAction": "string",
    "eventResult": "string",
    "eventSeverity": "string",
    "eventOutcomeReason": "string",
    "application": APPLICATION,
    "actor": ACTOR,
    "target": TARGET,
    "source": SOURCE,
    "request": REQUEST,
    "change": CHANGE,
    "security": SECURITY,
    "collector": COLLECTOR,
    "labels": LABELS,
    "attributes": ATTRIBUTES,
    "privacy": PRIVACY,
}
ENVELOPE = ", ".join(f"{name} {kind}" for name, kind in ENVELOPE_FIELDS.items())


def envelope_type() -> T.StructType:
    """The envelope as a StructType."""
    return T.StructType.fromDDL(ENVELOPE)
