"""OCSF normalisation of twelve source kinds.

A mapper is a function from a parsed document (VARIANT fragment) and the clock to the members of the
normalised event; more kinds can be added with :func:`register_mapper`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.fingerprint import RESULT_NAMES
from telemill.functions.jsonread import jarray, jfirst, jnum, jstr, jtime
from telemill.functions.sqltext import let, lit, lookup, once, struct, when
from telemill.functions.text import contains_ci, truncate
from telemill.operators.envelope import decode_envelope

MAPPING_VERSION = "1.0.0"

OCSF_FIELDS = {
    "class_uid": "int",
    "class_name": "string",
    "category_uid": "int",
    "category_name": "string",
    "activity_id": "int",
    "activity_name": "string",
    "severity_id": "int",
    "severity": "string",
    "time": "timestamp",
    "type_name": "string",
    "message": "string",
    "status": "string",
    "source_id": "string",
    "metadata_product_name": "string",
    "metadata_product_vendor": "string",
    "metadata_version": "string",
    "actor_user_name": "string",
    "src_endpoint_ip": "string",
    "target_name": "string",
    "unmapped": "map<string,string>",
    "extensions": "map<string,variant>",
}
OCSF_EVENT = "struct<" + ",".join(f"{k}:{v}" for k, v in OCSF_FIELDS.items()) + ">"

Mapper = Callable[[str, str], dict[str, str]]

# Severity names by id.
SEVERITY_NAMES = {0: "Unknown", 1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical"}

IAM = ("3", "'Identity & Access Management'")
SYSTEM = ("1", "'System Activity'")
FINDINGS = ("2", "'Findings'")


def severity_id_from_number(value: str) -> str:
    """Severity id by number."""
    return when([(f"{value} IS NULL", "0"), (f"{value} <= 1.9D", "1"), (f"{value} <= 3.9D", "2"), (f"{value} <= 6.9D", "3"), (f"{value} <= 8.9D", "4")], "5")


def severity_id_from_label(label: str) -> str:
    """Severity id by label."""
    names = {1: "'INFORMATIONAL', 'INFO'", 2: "'LOW'", 3: "'MEDIUM', 'MED'", 4: "'HIGH'", 5: "'CRITICAL', 'CRIT'"}
    return when([(f"upper({label}) IN ({group})", str(i)) for i, group in names.items()], "0")


def severity_id_from_event(severity: str) -> str:
    """Severity id of an envelope severity."""
    order = ("informational", "low", "medium", "high", "critical")
    return when([(f"{severity} = {lit(name)}", str(i)) for i, name in enumerate(order, start=1)], "0")


def severity_name(severity_id: str) -> str:
    """Severity name of an id."""
    return when([(f"{severity_id} = {i}", lit(name)) for i, name in SEVERITY_NAMES.items()])


def _product(name: str, vendor: str) -> dict[str, str]:
    return dict(metadata_product_name=lit(name), metadata_product_vendor=lit(vendor))


def _choose(test: str, yes: tuple[str, str, str, str], no: tuple[str, str, str, str]) -> dict[str, str]:
    names = ("class_uid", "class_name", "category_uid", "category_name")
    return {name: f"IF({test}, {y}, {n})" for name, y, n in zip(names, yes, no)}


def cloudtrail(doc: str, now: str) -> dict[str, str]:
    """First record of a CloudTrail document."""
    r = f"coalesce(get({jarray(doc, 'Records')}, 0), {doc})"
    # The record is read by many members; the caller binds it under this name.
    source, failed = jstr("rec", "eventSource"), f"{jstr('rec', 'errorCode')} IS NOT NULL"
    return dict(
        _bind_rec=r,
        class_uid="3001", class_name="'Account Change'", category_uid=IAM[0], category_name=IAM[1],
        activity_id="1", activity_name=f"coalesce({jstr('rec', 'eventName')}, 'Unknown')",
        severity_id=f"IF({failed}, 3, 1)", time=f"coalesce({jtime('rec', 'eventTime')}, {now})",
        type_name="'CloudTrail'", message=source, status=f"IF({failed}, 'Failure', 'Success')",
        source_id=jstr("rec", "eventID"), actor_user_name=jstr("rec", "userIdentity", "userName"),
        src_endpoint_ip=jstr("rec", "sourceIPAddress"), target_name=source,
        unmapped=f"map('awsRegion', coalesce({jstr('rec', 'awsRegion')}, ''))",
        **_product("AWS CloudTrail", "AWS"),
    )


def guardduty(doc: str, now: str) -> dict[str, str]:
    """GuardDuty finding."""
    return dict(
        class_uid="2001", class_name="'Security Finding'", category_uid=FINDINGS[0], category_name=FINDINGS[1],
        activity_id="1", activity_name=f"coalesce({jstr(doc, 'type')}, 'Finding')",
        severity_id=severity_id_from_number(jnum(doc, "severity")),
        time=f"coalesce({jtime(doc, 'updatedAt')}, {jtime(doc, 'createdAt')}, {now})",
        type_name="'GuardDuty'", message=jstr(doc, "title"), status="'New'", source_id=jstr(doc, "id"),
        target_name=jstr(doc, "type"), **_product("Amazon GuardDuty", "AWS"),
    )


def securityhub(doc: str, now: str) -> dict[str, str]:
    """Security Hub finding."""
    return dict(
        class_uid="2001", class_name="'Security Finding'", category_uid=FINDINGS[0], category_name=FINDINGS[1],
        activity_id="1", activity_name=f"coalesce({jstr(doc, 'Title')}, 'Finding')",
        severity_id=severity_id_from_label(jstr(doc, "Severity", "Label")),
        time=f"coalesce({jtime(doc, 'UpdatedAt')}, {jtime(doc, 'CreatedAt')}, {now})",
        type_name="'SecurityHub'", message=jstr(doc, "Description"),
        status=f"coalesce({jstr(doc, 'Compliance', 'Status')}, 'UNKNOWN')", source_id=jstr(doc, "Id"),
        target_name=jstr(doc, "GeneratorId"), **_product("AWS Security Hub", "AWS"),
    )


def windows(doc: str, now: str) -> dict[str, str]:
    """Windows event."""
    event_id = f"coalesce({jfirst(doc, 'EventID', 'Id')}, '0')"
    failed = f"{event_id} = '4625'"
    return dict(
        **_choose(f"{event_id} IN ('4624', '4625', '4648')", ("3002", "'Authentication'", *IAM), ("1007", "'Process Activity'", *SYSTEM)),
        activity_id=f"IF({failed}, 2, 1)", activity_name=f"coalesce({jstr(doc, 'Task')}, concat('EventID ', {event_id}))",
        severity_id=f"IF({failed}, 3, 1)", time=f"coalesce({jtime(doc, 'TimeCreated')}, {now})",
        type_name="'WindowsEvent'", message=jstr(doc, "Message"), status=f"IF({failed}, 'Failure', 'Success')",
        source_id=event_id, actor_user_name=jfirst(doc, "TargetUserName", "SubjectUserName"),
        src_endpoint_ip=jstr(doc, "IpAddress"), target_name=jstr(doc, "Computer"),
        **_product("Windows Event Log", "Microsoft"),
    )


def sysmon(doc: str, now: str) -> dict[str, str]:
    """Sysmon event."""
    event_id = f"coalesce({jfirst(doc, 'EventID', 'Id')}, '1')"
    names = {"1": "Process Creation", "3": "Network Connection", "11": "File Create"}
    return dict(
        class_uid="1007", class_name="'Process Activity'", category_uid=SYSTEM[0], category_name=SYSTEM[1],
        activity_id=f"IF({event_id} = '1', 1, 2)", activity_name=lookup(event_id, names, f"concat('Sysmon ', {event_id})"),
        severity_id="2", time=f"coalesce({jtime(doc, 'UtcTime')}, {now})", type_name="'Sysmon'",
        message=jfirst(doc, "Image", "CommandLine"), status="'Success'", source_id=event_id,
        actor_user_name=jstr(doc, "User"), src_endpoint_ip=jstr(doc, "SourceIp"),
        target_name=jfirst(doc, "DestinationIp", "TargetFilename"), **_product("Sysmon", "Microsoft"),
    )


def syslog(doc: str, now: str) -> dict[str, str]:
    """Linux syslog record."""
    message = f"coalesce({jfirst(doc, 'message', 'MESSAGE')}, '')"
    failed = f"({contains_ci(message, 'Failed password')} OR {contains_ci(message, 'authentication failure')})"
    return dict(
        **_choose(failed, ("3002", "'Authentication'", *IAM), ("1001", "'System Activity'", *SYSTEM)),
        activity_id=f"IF({failed}, 2, 1)", activity_name=f"coalesce({jfirst(doc, 'appname', 'SYSLOG_IDENTIFIER')}, 'syslog')",
        severity_id=f"IF({failed}, 3, 1)", time=f"coalesce({jtime(doc, 'timestamp')}, {jtime(doc, '__REALTIME_TIMESTAMP')}, {now})",
        type_name="'LinuxSyslog'", message=truncate(message, 512), status=f"IF({failed}, 'Failure', 'Unknown')",
        source_id=jstr(doc, "hostname"), actor_user_name=jstr(doc, "user"), src_endpoint_ip=jstr(doc, "source_ip"),
        target_name=jstr(doc, "hostname"), **_product("Linux Syslog", "Linux"),
    )


def vendor(type_name: str, product: str, vendor_name: str) -> Mapper:
    """Generic vendor finding; an unknown severity counts as medium."""

    def mapper(doc: str, now: str) -> dict[str, str]:
        label = jfirst(doc, "severity", ("Severity", "Label"), "Severity")
        times = ", ".join(jtime(doc, name) for name in ("timestamp", "time", "createdAt"))
        return dict(
            class_uid="2001", class_name="'Security Finding'", category_uid=FINDINGS[0], category_name=FINDINGS[1],
            activity_id="1", activity_name=f"coalesce({jfirst(doc, 'title', 'Title', 'type')}, {lit(product)})",
            severity_id=let("sid", severity_id_from_label(label), "IF(sid = 0, 3, sid)"),
            time=f"coalesce({times}, {now})", type_name=lit(type_name), message=jfirst(doc, "description", "message"),
            status=f"coalesce({jstr(doc, 'status')}, 'Unknown')", source_id=jfirst(doc, "id", "Id"),
            actor_user_name=jfirst(doc, "user", ("actor", "user")), src_endpoint_ip=jfirst(doc, "src_ip", "sourceIp"),
            target_name=jfirst(doc, "target", "hostname"), **_product(product, vendor_name),
        )

    return mapper


# Source kind to mapper; the envelope kind decodes a whole envelope and is handled apart.
MAPPERS: Mapping[str, Mapper] = {
    "CloudTrail": cloudtrail,
    "GuardDuty": guardduty,
    "SecurityHub": securityhub,
    "WindowsEvent": windows,
    "Sysmon": sysmon,
    "LinuxSyslog": syslog,
    "CrowdStrike": vendor("CrowdStrike", "CrowdStrike", "CrowdStrike"),
    "DefenderXdr": vendor("DefenderXdr", "Microsoft Defender XDR", "Microsoft"),
    "PaloAlto": vendor("PaloAlto", "Palo Alto Networks", "Palo Alto Networks"),
    "Fortinet": vendor("Fortinet", "Fortinet", "Fortinet"),
    "MicrosoftSentinel": vendor("MicrosoftSentinel", "Microsoft Sentinel", "Microsoft"),
}
ENVELOPE_KIND = "Envelope"
ENVELOPE_PRODUCT = "telemill"


def register_mapper(mappers: Mapping[str, Mapper], kind: str, mapper: Mapper) -> dict[str, Mapper]:
    """A mapper set with one more kind."""
    if kind in mappers or kind == ENVELOPE_KIND:
        raise ValueError(f"source kind already mapped: {kind}")
    return {**mappers, kind: mapper}


def _event(members: dict[str, str]) -> str:
    members = dict(members)
    record = members.pop("_bind_rec", None)
    values = {name: f"cast(NULL AS {kind})" for name, kind in OCSF_FIELDS.items()}
    values |= {k: f"cast({v} AS {OCSF_FIELDS[k]})" for k, v in members.items()}
    values["severity_id"], values["severity"] = "sev", severity_name("sev")
    values["metadata_version"] = lit(MAPPING_VERSION)
    body = let("sev", f"cast({members['severity_id']} AS int)", struct(**values))
    return body if record is None else let("rec", record, body)


def _envelope_event(e: str) -> str:
    auth = contains_ci(f"{e}.eventCategory", "auth")
    members = dict(
        **_choose(auth, ("3002", "'Authentication'", *IAM), ("1001", "'Security Finding'", *SYSTEM)),
        activity_id=f"IF({e}.eventResult = 'failure', 2, 1)", activity_name=f"{e}.eventAction",
        severity_id=severity_id_from_event(f"{e}.eventSeverity"), time=f"{e}.timeGenerated", type_name=f"{e}.eventType",
        message=f"{e}.eventOutcomeReason", status=lookup(f"{e}.eventResult", RESULT_NAMES, f"{e}.eventResult"),
        source_id=f"coalesce({e}.eventOriginalId, {e}.eventId)",
        actor_user_name=f"coalesce({e}.actor.username, {e}.actor.userId)", src_endpoint_ip=f"{e}.source.ipAddress",
        target_name=f"coalesce({e}.target.name, {e}.target.id)", unmapped=f"{e}.labels",
        **_product(ENVELOPE_PRODUCT, ENVELOPE_PRODUCT),
    )
    return _event(members)


def _failure(raw: str, doc: str, known: str) -> str:
    return when(
        [
            (f"{raw} IS NULL OR trim({raw}) = ''", "'empty-payload'"),
            (f"NOT ({known})", "'unsupported-source'"),
            (f"{doc} IS NULL", "'invalid-json'"),
        ]
    )


def _result(event: str, failure: str, kind: str) -> str:
    return struct(
        succeeded=f"({failure}) IS NULL", event=event, mapping_version=lit(MAPPING_VERSION), source_kind=kind,
        warnings="cast(array() AS array<string>)", failure_code=failure,
    )


def _document(column: str) -> str:
    return f"try_parse_json({column})"


def normalise(
    df: DataFrame, kind: str, now: str, column: str = "raw", output: str = "ocsf", mappers: Mapping[str, Mapper] = MAPPERS
) -> DataFrame:
    """Adds the normalisation result of documents of one kind."""
    if kind == ENVELOPE_KIND:
        return normalise_mixed(df.withColumn("_kind", F.lit(ENVELOPE_KIND)), "_kind", now, column, output, {}).drop("_kind")
    if kind not in mappers:
        raise ValueError(f"unsupported source kind: {kind}")
    mapped = f"IF(bad IS NULL, cast({_event(mappers[kind]('doc', now))} AS {OCSF_EVENT}), NULL)"
    body = let("bad", _failure(column, "doc", "true"), _result(mapped, "bad", lit(kind)))
    return df.transform(once, output, let("doc", _document(column), body))


def normalise_mixed(
    df: DataFrame, kind_column: str, now: str, column: str = "raw", output: str = "ocsf", mappers: Mapping[str, Mapper] = MAPPERS
) -> DataFrame:
    """Adds the normalisation result of documents whose kind is in a column (one pass, no union)."""
    known = f"{kind_column} IN ({', '.join(lit(k) for k in (*mappers, ENVELOPE_KIND))})"
    cases = [(f"{kind_column} = {lit(k)}", f"cast({_event(m('doc', now))} AS {OCSF_EVENT})") for k, m in mappers.items()]
    # Only envelope rows are decoded as envelopes.
    decoded = decode_envelope(
        df.withColumn("_text", F.expr(f"IF({kind_column} = {lit(ENVELOPE_KIND)}, {column}, NULL)")),
        "_text", "_event", "_decode",
    )
    cases.append(("_event IS NOT NULL", f"cast({_envelope_event('_event')} AS {OCSF_EVENT})"))
    failure = f"coalesce({_failure(column, 'doc', known)}, _decode)"
    body = let("bad", failure, _result(f"IF(bad IS NULL, {when(cases)}, NULL)", "bad", kind_column))
    return decoded.transform(once, output, let("doc", _document(column), body)).drop("_text", "_event", "_decode")
