"""Typed decoding and validation of event envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill import schema as S
from telemill.functions.jsonread import parse_instant
from telemill.functions.sqltext import let, lit, lits, once, struct, when
from telemill.functions.text import present

# Read form: instants and enumerations as text, so that a bad one can be told from a missing one.
_RAW_FIELDS = {
    **S.ENVELOPE_FIELDS,
    "timeGenerated": "string",
    "timeObserved": "string",
    "collector": S.COLLECTOR.replace("receivedAt:timestamp", "receivedAt:string"),
}
_CORRUPT = "_malformed"

# Required members must be there and must be texts.
REQUIRED_TEXTS = (
    "schemaVersion",
    "eventId",
    "timeGenerated",
    "eventCategory",
    "eventType",
    "eventAction",
    "eventResult",
    "application.name",
    "application.environment",
)


def decode_envelope(df: DataFrame, column: str = "json", output: str = "event", failure: str = "decode_failure") -> DataFrame:
    """Adds the typed envelope struct and ``schema-invalid`` where the JSON does not fit.

    ``from_json`` alone is too lenient: missing members, numbers in place of texts, values outside the
    enumerations and malformed instants are checked on top.
    """
    ddl = ", ".join(f"{name} {kind}" for name, kind in _RAW_FIELDS.items()) + f", {_CORRUPT} string"
    parsed = f"from_json({column}, {lit(ddl)}, map('columnNameOfCorruptRecord', {lit(_CORRUPT)}))"
    texts = " AND ".join(
        "coalesce(schema_of_variant(try_variant_get(doc, "
        + lit("$" + "".join(f"['{k}']" for k in path.split(".")))
        + ", 'variant')) = 'STRING', false)"
        for path in REQUIRED_TEXTS
    )

    def member_of(value: str, allowed: tuple[str, ...]) -> str:
        return f"({value} IS NULL OR lower({value}) IN ({lits([a.lower() for a in allowed])}))"

    def enum(value: str, allowed: tuple[str, ...]) -> str:
        return when([(f"lower({value}) = {lit(a.lower())}", lit(a)) for a in allowed])

    fits = " AND ".join(
        [
            "raw_event IS NOT NULL",
            f"raw_event.{_CORRUPT} IS NULL",
            let("doc", f"try_parse_json({column})", texts),
            f"{parse_instant('raw_event.timeGenerated')} IS NOT NULL",
            f"(raw_event.timeObserved IS NULL OR {parse_instant('raw_event.timeObserved')} IS NOT NULL)",
            member_of("raw_event.eventResult", S.EVENT_RESULTS),
            member_of("raw_event.eventSeverity", S.EVENT_SEVERITIES),
            member_of("raw_event.actor.type", S.ACTOR_TYPES),
            member_of("raw_event.security.decision", S.DECISIONS),
            "(raw_event.target IS NULL OR raw_event.target.type IS NOT NULL)",
        ]
    )
    actor = struct(
        userId="raw_event.actor.userId",
        username="raw_event.actor.username",
        displayName="raw_event.actor.displayName",
        type=f"coalesce({enum('raw_event.actor.type', S.ACTOR_TYPES)}, 'human')",
        role="raw_event.actor.role",
    )
    collector = struct(
        id="raw_event.collector.id",
        version="raw_event.collector.version",
        sourceAdapter="raw_event.collector.sourceAdapter",
        configurationHash="raw_event.collector.configurationHash",
        batchId="raw_event.collector.batchId",
        receivedAt=parse_instant("raw_event.collector.receivedAt"),
    )
    values = {name: f"raw_event.{name}" for name in S.ENVELOPE_FIELDS}
    values |= {
        "timeGenerated": parse_instant("raw_event.timeGenerated"),
        "timeObserved": parse_instant("raw_event.timeObserved"),
        "eventResult": enum("raw_event.eventResult", S.EVENT_RESULTS),
        "eventSeverity": f"coalesce({enum('raw_event.eventSeverity', S.EVENT_SEVERITIES)}, 'medium')",
        "actor": f"IF(raw_event.actor IS NULL, NULL, {actor})",
        "collector": f"IF(raw_event.collector IS NULL, NULL, {collector})",
    }
    typed = struct(**values)
    decoded = let(
        "raw_event",
        parsed,
        let("good", fits, struct(event=f"IF(good, {typed}, NULL)", failure="IF(good, NULL, 'schema-invalid')")),
    )
    ok = f"IF({column} IS NULL, NULL, {decoded})"
    return (
        df.transform(once, "_decoded", ok)
        .withColumn(output, F.col("_decoded.event"))
        .withColumn(failure, F.col("_decoded.failure"))
        .drop("_decoded")
    )


# Texts of the validation failures.
BAD_VERSION = "Unsupported schemaVersion"
BAD_ID = "eventId is required and must not exceed 128 characters"
BAD_KIND = "eventType, eventCategory and eventAction are required"
BAD_APPLICATION = "application.name and application.environment are required"
BAD_TIME = "timeGenerated is outside allowed range"


def time_allowed(ts: str, now: str) -> str:
    """Not older than five years and not more than five minutes ahead."""
    return f"coalesce({ts} BETWEEN {now} - INTERVAL 5 YEARS AND {now} + INTERVAL 5 MINUTES, false)"


def validation_failures(event: str, now: str) -> str:
    """Array of failure texts; empty for a valid envelope."""
    rules = [
        (f"coalesce({event}.schemaVersion = {lit(S.SCHEMA_VERSION)}, false)", BAD_VERSION),
        (f"{present(event + '.eventId')} AND length({event}.eventId) <= 128", BAD_ID),
        (
            " AND ".join(present(f"{event}.{name}") for name in ("eventType", "eventCategory", "eventAction")),
            BAD_KIND,
        ),
        (f"{present(event + '.application.name')} AND {present(event + '.application.environment')}", BAD_APPLICATION),
        (time_allowed(f"{event}.timeGenerated", now), BAD_TIME),
    ]
    checks = ", ".join(f"IF({test}, NULL, {lit(text)})" for test, text in rules)
    return f"array_compact(array({checks}))"


# Published limits that the checks above leave out; ``strict`` adds them.
STRICT_PATTERNS = {"eventType": r"^[a-z][a-z0-9_]{2,127}$"}
STRICT_LABELS = 64


def strict_failures(event: str) -> str:
    """Further failures under the published JSON schema."""
    rules = [
        (f"{event}.eventCategory IN ({lits(S.EVENT_CATEGORIES)})", "eventCategory is not a known category"),
        (f"{event}.eventType RLIKE {lit(STRICT_PATTERNS['eventType'])}", "eventType has an invalid form"),
        (f"coalesce(size({event}.labels), 0) <= {STRICT_LABELS}", "too many labels"),
    ]
    checks = ", ".join(f"IF(coalesce({test}, false), NULL, {lit(text)})" for test, text in rules)
    return f"array_compact(array({checks}))"


def now_literal(now: str) -> str:
    """A fixed clock as SQL; every operator takes the clock as a parameter."""
    return f"timestamp{lit(now)}"


def validate_envelope(df: DataFrame, now: str, event: str = "event", output: str = "failures", strict: bool = False) -> DataFrame:
    """Adds the array of validation failures; ``now`` is a SQL timestamp expression."""
    failures = validation_failures(event, now)
    if strict:
        failures = f"concat({failures}, {strict_failures(event)})"
    return df.withColumn(output, F.expr(f"IF({event} IS NULL, array(), {failures})"))
