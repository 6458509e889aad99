"""Assessment of data-collection-rule documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.jsonread import child, jarray, jobject
from telemill.functions.sqltext import let, lit, lits, once, struct
from telemill.functions.text import contains_ci

# Recommended event ids and score weights.
SECURITY_EVENT_IDS = ("4624", "4625", "4648", "4672", "4688", "4720", "4728", "4732", "1102")
SYSMON_EVENT_IDS = ("1", "3", "11")
PENALTIES = {"critical": 30, "high": 15, "medium": 8, "low": 3}
DUPLICATE_SAVING = 0.05
BROAD_SAVING = 0.25

SOURCE = "struct<name:string,kind:string,streams:array<string>,xpaths:array<string>,enabled:boolean>"


def _text(value: str, *keys: str) -> str:
    """Text of a member; containers are printed as JSON."""
    return f"try_variant_get({child(value, *keys)}, '$', 'string')"


def _texts(value: str, *keys: str) -> str:
    """Non-blank texts of an array member, an empty array otherwise."""
    return f"filter(transform(coalesce({jarray(value, *keys)}, array()), t -> {_text('t')}), t -> trim(t) <> '')"


def _source(item: str, fallback: str) -> str:
    xpaths = _texts(item, "xPathQueries")
    return struct(
        name=f"coalesce({_text(item, 'name')}, {_text(item, 'streams')}, 'source')",
        kind=f"coalesce({_text(item, 'kind')}, {_text(item, 'type')}, {fallback}, 'unknown')",
        streams=_texts(item, "streams"),
        xpaths=f"IF(size({xpaths}) > 0, {xpaths}, {_texts(item, 'xpathQueries')})",
        enabled=f"coalesce(NOT (schema_of_variant({child(item, 'enabled')}) = 'BOOLEAN' AND {_text(item, 'enabled')} = 'false'), true)",
    )


def parse_rules(df: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``id, name, workspace_id, sources, destinations`` of a collection-rule document."""
    as_list = f"transform({jarray('doc', 'dataSources')}, item -> {_source('item', 'NULL')})"
    groups = f"map_entries({jobject('doc', 'dataSources')})"
    as_groups = (
        f"flatten(transform({groups}, g -> transform(coalesce({jarray('g.value')}, array()), item -> {_source('item', 'g.key')})))"
    )
    destinations = (
        f"filter(transform(coalesce({jarray('doc', 'destinations')}, array()), "
        f"t -> coalesce({_text('t', 'name')}, {_text('t')})), t -> trim(t) <> '')"
    )
    destination_groups = f"map_keys(coalesce({jobject('doc', 'destinations')}, map()))"
    parsed = struct(
        id=f"coalesce({_text('doc', 'id')}, {_text('doc', 'name')}, 'unknown')",
        name=f"coalesce({_text('doc', 'name')}, {_text('doc', 'id')}, 'unknown')",
        workspace_id=f"coalesce({_text('doc', 'workspaceId')}, {_text('doc', 'destinations', 'logAnalytics', 'workspaceResourceId')})",
        sources=f"cast(coalesce({as_list}, {as_groups}, array()) AS array<{SOURCE}>)",
        destinations=f"IF({jobject('doc', 'destinations')} IS NULL, {destinations}, {destination_groups})",
    )
    return df.transform(once, "_rule", let("doc", f"try_parse_json({column})", parsed)).select(
        *[c for c in df.columns if c != column], "_rule.*"
    )


def rule_sources(parsed: DataFrame) -> DataFrame:
    """One row per data source of a parsed document."""
    return parsed.select("id", F.explode("sources").alias("s")).select("id", "s.*")


def rule_duplicates(parsed: DataFrame) -> DataFrame:
    """Data source names that occur more than once in a document, case ignored."""
    return (
        rule_sources(parsed)
        .groupBy("id", F.lower("name").alias("name_key"))
        .agg(F.min("name").alias("name"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def _finding(code: str, severity: str, title: str, detail: str, saved: str = "cast(NULL AS double)") -> str:
    return struct(code=lit(code), severity=lit(severity), title=lit(title), detail=detail, saved_gb=saved)


def _any_source(test: str) -> str:
    return f"exists(sources, s -> {test})"


def _any_text(list_name: str, needle: str) -> str:
    return f"exists(s.{list_name}, t -> {contains_ci('t', needle)})"


def rule_facts(parsed: DataFrame) -> DataFrame:
    """Adds what the findings and scores are built from (one narrow pass, no grouping)."""
    facts = {
        "has_windows": _any_source(f"{contains_ci('s.kind', 'windows')} OR {_any_text('streams', 'WindowsEvent')}"),
        "is_broad": _any_source(
            f"{_any_text('xpaths', 'Security!*')} OR " + _any_text("xpaths", "*[System[(EventID='*')]]")
        ),
        "has_sysmon": _any_source(
            f"{contains_ci('s.name', 'sysmon')} OR {_any_text('xpaths', 'Sysmon')} OR {_any_text('streams', 'Sysmon')}"
        ),
        "has_defender": _any_source(
            f"{contains_ci('s.name', 'defender')} OR {_any_text('streams', 'Microsoft-Windows-Windows Defender')}"
        ),
        "has_iis": _any_source(f"{contains_ci('s.name', 'iis')} OR {_any_text('streams', 'IIS')}"),
        "has_disabled": _any_source("NOT s.enabled"),
        "has_destination": "size(destinations) > 0",
        "all_xpaths": "array_join(flatten(transform(sources, s -> s.xpaths)), ' ')",
    }
    with_facts = parsed.withColumns({k: F.expr(v) for k, v in facts.items()})
    missing_sysmon = f"""filter(array({lits(SYSMON_EVENT_IDS)}), i -> NOT contains(lower(all_xpaths), concat('eventid=', i))
        AND NOT contains(lower(all_xpaths), concat('eventid=\\'', i, '\\'')))"""
    return with_facts.withColumns(
        {
            "missing_ids": F.expr(f"filter(array({lits(SECURITY_EVENT_IDS)}), i -> NOT contains(all_xpaths, i))"),
            "missing_sysmon": F.expr(missing_sysmon),
            "_names": F.expr("transform(sources, s -> lower(s.name))"),
        }
    )


def assess_rules(parsed: DataFrame, monthly_gb: str | None = None) -> DataFrame:
    """Adds ``recommendations``, ``health_score``, ``coverage_score`` and ``savings_gb``.

    ``monthly_gb`` is a column or SQL expression with the ingestion per month.
    """
    gb = "cast(NULL AS double)" if monthly_gb is None else f"cast({monthly_gb} AS double)"
    copies = "size(filter(_names, n -> n = d))"
    first_name = "element_at(filter(sources, s -> lower(s.name) = d), 1).name"
    duplicates = (
        f"transform(filter(array_distinct(_names), d -> {copies} > 1), d -> "
        + _finding(
            "duplicate-source", "medium", "Duplicate collection sources",
            f"concat('Data source name \\'', {first_name}, '\\' appears ', {copies}, ' times.')", f"{gb} * {DUPLICATE_SAVING}D",
        )
        + ")"
    )
    listed = ", ".join(SYSMON_EVENT_IDS)
    singles = [
        ("is_broad", _finding(
            "broad-security-events", "high", "Replace Security Event * with targeted Event IDs",
            lit("Broad Security channel collection inflates ingestion. Prefer targeted Event IDs."), f"{gb} * {BROAD_SAVING}D")),
        ("has_windows AND size(missing_ids) > 0", _finding(
            "missing-security-event-ids", "medium", "Missing high-value Windows Event IDs",
            "concat('Consider collecting Event IDs: ', array_join(missing_ids, ', '), '.')")),
        ("NOT has_sysmon", _finding(
            "missing-sysmon", "high", "Missing Sysmon configuration",
            lit("Collect Sysmon Event IDs 1, 3 and 11 for process, network and file visibility."))),
        ("has_sysmon AND size(missing_sysmon) > 0", _finding(
            "incomplete-sysmon", "medium", "Incomplete Sysmon Event IDs", lit(f"Ensure Sysmon Event IDs {listed} are collected."))),
        ("NOT has_defender", _finding(
            "missing-defender", "medium", "Disabled or missing Defender telemetry",
            lit("Enable Defender / XDR connector or collect Defender operational channels."))),
        ("NOT has_iis", _finding(
            "missing-iis", "low", "Missing IIS logs", lit("If web workloads exist, collect IIS W3C logs with path filters."))),
        ("has_disabled", _finding(
            "disabled-sources", "medium", "Disabled data sources present",
            lit("Review disabled sources for accidental coverage gaps or stale configuration."))),
        ("NOT has_destination", _finding(
            "missing-destination", "critical", "No destinations configured",
            lit("DCR has no Log Analytics / destination association."))),
    ]
    checks = ", ".join(f"IF({test}, {finding}, NULL)" for test, finding in singles)
    penalty = " + ".join(
        f"{points} * size(filter(recommendations, r -> r.severity = {lit(severity)}))" for severity, points in PENALTIES.items()
    )
    coverage = (
        "IF(has_windows, 30, 0) + IF(has_sysmon, 30, 0) + IF(has_defender, 20, 0) + IF(has_iis, 10, 0) + IF(has_destination, 10, 0)"
    )
    saved = "aggregate(recommendations, 0D, (total, r) -> total + coalesce(r.saved_gb, 0D))"
    facts = rule_facts(parsed)
    helpers = [c for c in facts.columns if c not in parsed.columns]
    return (
        facts.withColumn("recommendations", F.expr(f"concat({duplicates}, array_compact(array({checks})))"))
        .withColumn("health_score", F.expr(f"greatest(0, least(100, 100 - ({penalty})))"))
        .withColumn("coverage_score", F.expr(coverage))
        .withColumn("savings_gb", F.expr(f"nullif({saved}, 0D)"))
        .drop(*helpers)
    )


def rule_recommendations(assessed: DataFrame) -> DataFrame:
    """One row per recommendation."""
    return assessed.select("id", F.explode("recommendations").alias("r")).select("id", "r.*")
