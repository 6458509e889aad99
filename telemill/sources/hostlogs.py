"""Host and companion-agent log lines to event envelopes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill import schema as S
from telemill.functions.sqltext import lit, struct, when
from telemill.functions.text import contains_ci, drop_nulls, merge_labels, present, short_hash, truncate
from telemill.operators.ordinals import index_within

# Event type by host log kind; other kinds are custom.
HOST_TYPES = {
    "WindowsEvent": "host_windows_event",
    "Sysmon": "host_sysmon",
    "PowerShell": "host_powershell",
    "Syslog": "host_syslog",
    "Journald": "host_journald",
    "Auditd": "host_auditd",
    "Auth": "host_auth",
    "Docker": "host_docker",
}
# Usual sources per platform as (id, kind, path).
DEFAULT_SOURCES = {
    "linux": (
        ("syslog", "Syslog", "/var/log/syslog"),
        ("auth", "Auth", "/var/log/auth.log"),
        ("auditd", "Auditd", "/var/log/audit/audit.log"),
        ("docker", "Docker", "/var/lib/docker/containers"),
    ),
    "windows": (
        ("windows-security", "WindowsEvent", "Security"),
        ("sysmon", "Sysmon", "Microsoft-Windows-Sysmon/Operational"),
        ("powershell", "PowerShell", "Microsoft-Windows-PowerShell/Operational"),
    ),
}
HOST_SOURCE = "id string, kind string, path string, enabled boolean"
HOST_METADATA = (
    "source_id string, instance_id string, account_id string, region string, availability_zone string, vpc_id string, "
    "subnet_id string, ami_id string, security_groups array<string>, auto_scaling_group string, ecs_cluster string, "
    "eks_cluster string, tags map<string,string>"
)


def host_category(kind: str, line: str) -> str:
    """Event category by kind and keyword."""
    return when(
        [
            (f"{contains_ci(line, 'Failed password')} OR contains({line}, '4625') OR {kind} = 'Auth'", "'authentication'"),
            (f"{kind} = 'Auditd'", "'administrative-activity'"),
        ],
        "'application-security'",
    )


def host_type(kind: str) -> str:
    """Event type by kind."""
    return when([(f"{kind} = {lit(k)}", lit(t)) for k, t in HOST_TYPES.items()], "'host_custom'")


def host_action(kind: str, line: str) -> str:
    """Event action by keyword, else by kind."""
    return f"IF({contains_ci(line, 'Failed password')}, 'authentication.failure', concat(lower({kind}), '.event'))"


def host_result(line: str) -> str:
    """Result by keyword."""
    return when(
        [
            (f"{contains_ci(line, 'failed')} OR {contains_ci(line, 'denied')} OR contains({line}, '4625')", "'failure'"),
            (f"{contains_ci(line, 'accepted')} OR contains({line}, '4624')", "'success'"),
        ],
        "'unknown'",
    )


def host_severity(line: str) -> str:
    """Severity by keyword."""
    return when(
        [
            (contains_ci(line, "critical"), "'critical'"),
            (f"{contains_ci(line, 'failed')} OR {contains_ci(line, 'error')}", "'medium'"),
        ],
        "'low'",
    )


def host_labels(m: str) -> str:
    """Labels from instance metadata; absent values are left out."""
    pairs = {
        "aws.instanceId": "instance_id",
        "aws.accountId": "account_id",
        "aws.region": "region",
        "aws.availabilityZone": "availability_zone",
        "aws.vpcId": "vpc_id",
        "aws.subnetId": "subnet_id",
        "aws.amiId": "ami_id",
        "aws.autoScalingGroup": "auto_scaling_group",
        "aws.ecsCluster": "ecs_cluster",
        "aws.eksCluster": "eks_cluster",
    }
    fixed = ", ".join(f"{lit(k)}, {m}.{c}" for k, c in pairs.items())
    groups = f"nullif(array_join(coalesce({m}.security_groups, array()), ','), '')"
    tags = f"transform_keys(coalesce({m}.tags, cast(map() AS map<string,string>)), (k, v) -> concat('aws.tag.', k))"
    return merge_labels(drop_nulls(f"map({fixed}, 'aws.securityGroups', {groups})"), tags)


@dataclass(frozen=True)
class LineOptions:
    """Settings shared by the line sources."""

    agent_id: str
    application_name: str
    environment: str = "production"
    max_line_bytes: int | None = None


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each line in its split; a task reads its splits one after another, each in order."""
    current, at = None, 0
    for batch in batches:
        places = []
        for split in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist()):
            if split != current:
                current, at = split, 0
            places.append(at)
            at += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``file``, ``line_no`` (from 0), ``line``; a line may end with a carriage return.

    Files of any size are read by splits. Lines are counted within each split, and the counts of the splits before
    it give the number of a split's first line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"
    )
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    # A row for each split.
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n"))
    starts = counts.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = lines.mapInArrow(_positions, "file string, split bigint, value string, place bigint").join(starts, ["file", "split"])
    return placed.select("file", (F.col("first") + F.col("place")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def _numbered(lines: DataFrame, key: str) -> DataFrame:
    """The non-blank lines with their place among those of their source, before any join."""
    return index_within(lines.filter(F.expr(present("line"))), [key], "line_no", "_index")


def _line_events(numbered: DataFrame, key: str, build: str, options: LineOptions) -> DataFrame:
    """Builds the envelopes of numbered lines."""
    original = short_hash(f"concat_ws({lit(chr(31))}, {key}, cast(_index AS string), line)", 24)
    limit = options.max_line_bytes
    failure = "cast(NULL AS string)" if limit is None else f"IF(octet_length(line) > {limit}, 'line-too-large', NULL)"
    return (
        numbered.withColumn("_original", F.expr(original))
        .withColumn("failure_code", F.expr(failure))
        .withColumn("event", F.expr(f"IF(failure_code IS NULL, {build}, NULL)"))
        .withColumnRenamed("_index", "line_index")
    )


def _envelope(values: dict[str, str]) -> str:
    full = {name: f"cast(NULL AS {kind})" for name, kind in S.ENVELOPE_FIELDS.items()}
    cast_values = {name: f"cast({value} AS {S.ENVELOPE_FIELDS[name]})" for name, value in values.items()}
    return struct(**(full | cast_values))


def _collector(options: LineOptions, adapter: str, observed: str) -> str:
    return struct(
        id=lit(options.agent_id),
        version="'0.1.0'",
        sourceAdapter=lit(adapter),
        configurationHash="left(_original, 16)",
        batchId="NULL",
        receivedAt=observed,
    )


def map_host_lines(
    lines: DataFrame, sources: DataFrame, options: LineOptions, observed: str, metadata: DataFrame | None = None
) -> DataFrame:
    """``source_id, line_no, line`` to ``event``; lines of unknown or disabled sources give nothing.

    ``sources`` is configuration (one row per log source) and ``metadata`` one row per source's host;
    both join by key, and Spark broadcasts them when they are measured as small.
    """
    enabled = sources.filter("enabled").select(F.col("id").alias("source_id"), "kind", "path")
    joined = _numbered(lines, "source_id").join(enabled, "source_id")
    if metadata is None:
        described = joined.withColumn("host", F.expr(f"cast(NULL AS struct<{HOST_METADATA.replace(' ', ':').replace(',:', ',')}>)"))
    else:
        hosts = metadata.select("source_id", F.struct(*metadata.columns).alias("host"))
        described = joined.join(hosts, "source_id", "left")
    own = (
        "map('host.sourceId', source_id, 'host.kind', kind, 'host.path', path, "
        f"'host.linePreview', {truncate('line', 256)})"
    )
    labels = f"IF(host IS NULL, {own}, {merge_labels(own, host_labels('host'))})"
    build = _envelope(
        {
            "schemaVersion": lit(S.SCHEMA_VERSION),
            "eventId": "concat('host-', _original)",
            "eventOriginalId": "_original",
            "timeGenerated": observed,
            "timeObserved": observed,
            "eventCategory": host_category("kind", "line"),
            "eventType": host_type("kind"),
            "eventAction": host_action("kind", "line"),
            "eventResult": host_result("line"),
            "eventSeverity": host_severity("line"),
            "application": struct(
                name=lit(options.application_name), version="NULL", environment=lit(options.environment),
                instance="host.instance_id", tenantId="host.account_id",
            ),
            "source": struct(ipAddress="NULL", hostname="host.instance_id", port="NULL"),
            "target": struct(type="'host-log'", id="NULL", name="path"),
            "collector": _collector(options, "aws.ec2-agent", observed),
            "labels": labels,
        }
    )
    return _line_events(described, "source_id", build, options).drop("kind", "path", "host", "_original")


def map_custom_log_lines(lines: DataFrame, targets: DataFrame, options: LineOptions, observed: str) -> DataFrame:
    """``target_id, line_no, line`` of companion-agent files to ``event``."""
    enabled = targets.filter("enabled").select(F.col("id").alias("target_id"), "path", "format")
    labels = f"map('ama.targetId', target_id, 'ama.format', format, 'ama.linePreview', {truncate('line', 256)})"
    build = _envelope(
        {
            "schemaVersion": lit(S.SCHEMA_VERSION),
            "eventId": "concat('custom-', _original)",
            "eventOriginalId": "_original",
            "timeGenerated": observed,
            "timeObserved": observed,
            "eventCategory": "'application-security'",
            "eventType": "'ama_custom_log'",
            "eventAction": "'log.append'",
            "eventResult": "'unknown'",
            "eventSeverity": "'medium'",
            "application": struct(
                name=lit(options.application_name), version="NULL", environment=lit(options.environment),
                instance="NULL", tenantId="NULL",
            ),
            "target": struct(type="'file'", id="NULL", name="path"),
            "collector": _collector(options, "ama.companion", observed),
            "labels": labels,
        }
    )
    return _line_events(_numbered(lines, "target_id").join(enabled, "target_id"), "target_id", build, options).drop("path", "format", "_original")
