"""Typed rows of an application to event envelopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill import schema as S
from telemill.functions.sqltext import lit, struct
from telemill.functions.text import joined_parts, present


@dataclass(frozen=True)
class ApplicationInfo:
    """The application that emits the events."""

    name: str
    environment: str
    version: str | None = None
    instance: str | None = None
    tenant_id: str | None = None

    def sql(self) -> str:
        return struct(
            name=lit(self.name), version=lit(self.version), environment=lit(self.environment),
            instance=lit(self.instance), tenantId=lit(self.tenant_id),
        )


def _build(
    df: DataFrame, app: ApplicationInfo, now: str, required: tuple[str, ...], values: dict[str, str], extra_checks: tuple[tuple[str, str], ...] = ()
) -> DataFrame:
    """Adds ``rejects`` (names of blank required inputs) and ``event`` (null when there are any)."""
    checks = [f"IF({present(name)}, NULL, {lit(name)})" for name in required]
    checks += [f"IF({test}, NULL, {lit(name)})" for test, name in extra_checks]
    event_id = f"concat('evt-', left(sha2({joined_parts(values['eventType'], 'correlation_id', 'to_json(struct(*))')}, 256), 32))"
    full = {name: f"cast(NULL AS {kind})" for name, kind in S.ENVELOPE_FIELDS.items()}
    given = {
        "schemaVersion": lit(S.SCHEMA_VERSION),
        "eventId": event_id,
        "timeGenerated": now,
        "eventSeverity": "'medium'",
        "application": app.sql(),
        "request": struct(
            correlationId="correlation_id", traceId="NULL", sessionId="NULL", method="NULL", path="NULL", statusCode="NULL"
        ),
        **values,
    }
    cast_values = {name: f"cast({value} AS {S.ENVELOPE_FIELDS[name]})" for name, value in given.items()}
    return df.withColumn("rejects", F.expr(f"array_compact(array({', '.join(checks)}))")).withColumn(
        "event", F.expr(f"IF(size(rejects) > 0, NULL, {struct(**(full | cast_values))})")
    )


def _actor(user_id: str = "NULL", username: str = "NULL") -> str:
    return struct(userId=user_id, username=username, displayName="NULL", type="'human'", role="NULL")


def authentication_failed(df: DataFrame, app: ApplicationInfo, now: str) -> DataFrame:
    """Input ``username, user_id, failure_reason, correlation_id, source_ip, original_event_id``."""
    return _build(
        df, app, now,
        ("username", "failure_reason", "correlation_id"),
        {
            "eventOriginalId": "original_event_id",
            "eventCategory": "'authentication'",
            "eventType": "'authentication_failure'",
            "eventAction": "'authentication.attempt'",
            "eventResult": "'failure'",
            "eventOutcomeReason": "failure_reason",
            "actor": _actor("user_id", "username"),
            "source": f"IF(source_ip IS NULL, NULL, {struct(ipAddress='source_ip', hostname='NULL', port='NULL')})",
        },
    )


def role_membership_changed(df: DataFrame, app: ApplicationInfo, now: str) -> DataFrame:
    """Input ``actor_user_id, target_user_id, role, change ('added'/'removed'), reason, correlation_id``."""
    added = "lower(change) = 'added'"
    return _build(
        df, app, now,
        ("actor_user_id", "target_user_id", "role", "correlation_id"),
        {
            "eventCategory": "'identity-management'",
            "eventType": "'role_membership_changed'",
            "eventAction": f"IF({added}, 'role.add', 'role.remove')",
            "eventResult": "'success'",
            "eventOutcomeReason": "reason",
            "actor": _actor("actor_user_id"),
            "target": struct(type="'user'", id="target_user_id", name="NULL"),
            "change": struct(field="'role'", previousValue=f"IF({added}, NULL, role)", newValue=f"IF({added}, role, NULL)"),
        },
    )


def sensitive_data_exported(df: DataFrame, app: ApplicationInfo, now: str) -> DataFrame:
    """Input ``actor_user_id, export_id, data_classification, export_format, record_count, correlation_id``."""
    return _build(
        df, app, now,
        ("actor_user_id", "export_id", "data_classification", "correlation_id"),
        {
            "eventOriginalId": "export_id",
            "eventCategory": "'data-access'",
            "eventType": "'sensitive_data_exported'",
            "eventAction": "'data.export'",
            "eventResult": "'success'",
            "actor": _actor("actor_user_id"),
            "target": struct(type="'export'", id="export_id", name="NULL"),
            "labels": "map('dataClassification', data_classification)",
            "attributes": "map('recordCount', cast(record_count AS variant), 'exportFormat', cast(export_format AS variant))",
        },
        (("record_count >= 0", "record_count"),),
    )
