"""Sigma-style detection: rules compiled to predicates over event envelopes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.fingerprint import RESULT_NAMES
from telemill.functions.sqltext import let, lit, lits, lookup, opaque, struct, when

# The named fields a rule can look at, in lookup order.
HAYSTACK_FIELDS = {
    "EventType": "eventType",
    "EventAction": "eventAction",
    "EventCategory": "eventCategory",
    "EventResult": "eventResult",
    "EventOutcomeReason": "eventOutcomeReason",
    "ActorUsername": "actor.username",
    "ActorUserId": "actor.userId",
    "SourceIp": "source.ipAddress",
    "TargetName": "target.name",
    "TargetType": "target.type",
    "Application": "application.name",
}
# Risk score by level.
RISK_SCORES = {"informational": 10, "low": 25, "medium": 50, "high": 75, "critical": 95}
DEFAULT_RISK = 40
CONDITION_WORDS = {"or", "and", "not", "1", "of", "them"}


@dataclass(frozen=True)
class DetectionRule:
    """One rule; ``selections`` maps group names to flattened selections."""

    id: str
    title: str
    selections: Mapping[str, str]
    condition: str = "selection"
    level: str = "medium"
    version: str = "1.0.0"
    techniques: tuple[str, ...] = ()
    false_positives: tuple[str, ...] = ()
    log_sources: tuple[str, ...] = ()
    status: str = "experimental"
    hash: str = field(default="")

    def __post_init__(self) -> None:
        if not self.id.strip() or not self.title.strip() or not self.selections:
            raise ValueError("a rule needs an id, a title and a selection")
        if not self.hash:
            text = json.dumps([self.id, self.title, dict(self.selections), self.condition, self.level, self.version])
            object.__setattr__(self, "hash", hashlib.sha256(text.encode()).hexdigest())

    @classmethod
    def from_document(cls, doc: Mapping) -> DetectionRule:
        """A rule from a parsed rule document."""
        detection = dict(doc.get("detection") or {})
        condition = next((str(v) for k, v in detection.items() if k.lower() == "condition"), "selection")
        selections = {k: flatten_selection(v) for k, v in detection.items() if k.lower() != "condition"}
        source = doc.get("logsource") or {}
        return cls(
            id=str(doc.get("id") or ""),
            title=str(doc.get("title") or ""),
            selections=selections,
            condition=condition,
            level=str(doc.get("level") or "medium").lower(),
            version=str(doc.get("version") or doc.get("date") or "1.0.0"),
            techniques=tuple(technique_tags(doc.get("tags") or ())),
            false_positives=tuple(str(f) for f in doc.get("falsepositives") or ()),
            log_sources=tuple(str(source[k]) for k in ("product", "service", "category") if source.get(k)),
            status=str(doc.get("status") or "experimental").lower(),
        )


def flatten_selection(node) -> str:
    """``field:v1|v2;field2:v3`` text of a selection node."""
    if isinstance(node, Mapping):
        return ";".join(f"{k}:{flatten_selection(v)}" for k, v in node.items())
    if isinstance(node, (list, tuple)):
        return "|".join(str(v) for v in node)
    return "" if node is None else str(node)


def technique_tags(tags: Iterable[str]) -> list[str]:
    """Technique ids among the tags (``attack.t1110`` or ``T1110``)."""
    found = []
    for tag in map(str, tags):
        lowered = tag.lower()
        if lowered.startswith("attack.t"):
            found.append(tag[len("attack.") :].upper())
        elif len(tag) >= 5 and lowered[0] == "t" and tag[1:].isdigit():
            found.append(tag.upper())
    return found


def haystack_value(event: str, name: str) -> str:
    """Value of a named field, overridden by a label of that name in any case."""
    path = HAYSTACK_FIELDS[name]
    own = lookup(f"{event}.{path}", RESULT_NAMES, f"{event}.{path}") if name == "EventResult" else f"{event}.{path}"
    return f"coalesce(lbl[{lit(name.lower())}], {own}, '')"


def haystack_text(event: str) -> str:
    """All values joined by blanks: the named fields, then the other labels."""
    named = ", ".join(haystack_value(event, n) for n in HAYSTACK_FIELDS)
    known = lits([n.lower() for n in HAYSTACK_FIELDS])
    rest = f"map_values(map_filter(lbl, (k, v) -> k NOT IN ({known})))"
    return f"array_join(concat(array({named}), {rest}), ' ')"


def lowered_labels(event: str) -> str:
    """Labels with lower-cased keys; of keys that differ only by case the last stays."""
    entries = f"map_entries(coalesce({event}.labels, cast(map() AS map<string,string>)))"
    add = "map_concat(map_filter(acc, (k, v) -> k <> lower(e.key)), map(lower(e.key), e.value))"
    return f"aggregate({entries}, cast(map() AS map<string,string>), (acc, e) -> {add})"


def _field_matches(event: str, name: str, options: Sequence[str]) -> str:
    """Any option is contained in the field's value; an unknown field uses the first key it ends."""

    def contains(value: str) -> str:
        return "(" + " OR ".join(f"contains(lower({value}), {lit(o.lower())})" for o in options) + ")" if options else "false"

    lowered = name.lower()
    exact = next((n for n in HAYSTACK_FIELDS if n.lower() == lowered), None)
    if exact:
        return contains(haystack_value(event, exact))
    suffix = next((n for n in HAYSTACK_FIELDS if n.lower().endswith(lowered)), None)
    if suffix:
        fallback = haystack_value(event, suffix)
    else:
        fallback = f"get(map_values(map_filter(lbl, (k, v) -> endswith(k, {lit(lowered)}))), 0)"
    return f"coalesce({contains(f'coalesce(lbl[{lit(lowered)}], {fallback})')}, false)"


def compile_selection(event: str, selection: str, strict: bool = False) -> tuple[str, list[str]]:
    """Predicate of a selection and the field names it reports when it holds.

    ``strict`` understands the modifier ``field|contains``; otherwise a modified field matches nothing.
    """
    clauses = [c.strip() for c in selection.split(";") if c.strip()] or [selection]
    tests, fields = [], []
    for clause in clauses:
        name, colon, pattern = clause.partition(":")
        if not colon or not name:
            tests.append(f"contains(lower({haystack_text(event)}), {lit(clause.lower())})")
            fields.append("payload")
            continue
        name = name.strip().rstrip("|*")
        if strict and "|" in name:
            name = name.split("|")[0]
        options = [o.strip() for o in pattern.split("|") if o.strip()]
        tests.append(_field_matches(event, name, options))
        fields.append(name)
    return "(" + " AND ".join(tests) + ")", fields


def compile_rule(event: str, rule: DetectionRule, strict: bool = False) -> str:
    """``struct<fired, fields>`` of a rule.

    Groups are joined by *or* when the condition says ``or`` or ``1 of them``, else by *and*; an unknown
    group is false. ``not`` is ignored, unless ``strict`` negates the group behind it.
    """
    words = rule.condition.split()
    by_name = {k.lower(): v for k, v in rule.selections.items()}
    groups, negate = [], False
    for word in words:
        if word.lower() in CONDITION_WORDS:
            negate = strict and word.lower() == "not"
            continue
        groups.append((word, negate))
        negate = False
    if not groups:
        groups = [(name, False) for name in rule.selections]
    either = " or " in rule.condition.lower() or "1 of them" in rule.condition.lower()
    tests, reported = [], []
    for name, inverted in groups:
        selection = by_name.get(name.lower())
        if selection is None:
            tests.append("false")
            continue
        test, fields = compile_selection(event, selection, strict)
        tests.append(f"(NOT {test})" if inverted else test)
        reported.append(f"IF({test}, array({lits(fields)}), array())")
    fired = "(" + (" OR " if either else " AND ").join(tests) + ")"
    found = f"concat({', '.join(reported)})" if reported else "array()"
    return struct(fired=f"coalesce({fired}, false)", fields=f"cast({found} AS array<string>)")


def risk_score(level: str) -> str:
    """Risk score of a level."""
    return when([(f"lower({level}) = {lit(k)}", str(v)) for k, v in RISK_SCORES.items()], str(DEFAULT_RISK))


def detect(
    df: DataFrame,
    rules: Sequence[DetectionRule],
    detected_at: str,
    suppressed: Iterable[str] = (),
    event: str = "event",
    strict: bool = False,
) -> DataFrame:
    """One alert row per event and rule that fires. Suppressed rules are left out of the plan."""
    skip = {s.lower() for s in suppressed}
    active = [r for r in rules if r.id.lower() not in skip]
    if not active:
        active_sql = "cast(array() AS array<struct<rule_id:string,title:string,version:string,hash:string,level:string,risk:int,techniques:array<string>,hit:struct<fired:boolean,fields:array<string>>>>)"
    else:
        items = ", ".join(
            struct(
                rule_id=lit(r.id), title=lit(r.title), version=lit(r.version), hash=lit(r.hash), level=lit(r.level),
                risk=str(RISK_SCORES.get(r.level.lower(), DEFAULT_RISK)),
                techniques=f"cast(array({lits(r.techniques)}) AS array<string>)", hit=compile_rule(event, r, strict),
            )
            for r in active
        )
        active_sql = let("lbl", lowered_labels(event), f"array({items})")
    fired = df.withColumn("_hits", F.expr(opaque(f"filter({active_sql}, r -> r.hit.fired)"))).withColumn("_hit", F.explode("_hits"))
    e = event
    return fired.select(
        F.expr(f"concat('alert-', left(sha2(concat_ws(':', _hit.rule_id, {e}.eventId, _hit.hash), 256), 32))").alias("alert_id"),
        F.col("_hit.rule_id").alias("rule_id"),
        F.col("_hit.title").alias("rule_title"),
        F.col("_hit.version").alias("rule_version"),
        F.col("_hit.hash").alias("rule_hash"),
        F.col("_hit.level").alias("level"),
        F.col("_hit.risk").alias("risk_score"),
        F.expr(detected_at).alias("detected_at"),
        F.col(f"{e}.eventId").alias("event_id"),
        F.col(f"{e}.eventType").alias("event_type"),
        F.expr(f"coalesce({e}.actor.username, {e}.actor.userId)").alias("actor"),
        F.col(f"{e}.source.ipAddress").alias("source_ip"),
        F.col("_hit.techniques").alias("techniques"),
        F.col("_hit.hit.fields").alias("matched_fields"),
        F.expr(f"concat(_hit.title, ' matched event ', {e}.eventType, ' (', {e}.eventAction, ')')").alias("summary"),
    )


def suppressed_rules(rules: Sequence[DetectionRule], suppressed: Iterable[str]) -> list[str]:
    """Ids of the rules that a suppression list takes out, once each."""
    skip = {s.lower() for s in suppressed}
    return list({r.id.lower(): r.id for r in rules if r.id.lower() in skip}.values())


# The rule every deployment starts with.
AUTHENTICATION_FAILURE_RULE = DetectionRule(
    id="auth-failure-001",
    title="Authentication Failure Observed",
    selections={"selection": "EventType:authentication_failure;EventResult:Failure"},
    level="medium",
    techniques=("T1110",),
    status="stable",
)
