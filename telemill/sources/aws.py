"""AWS telemetry documents to event envelopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill import schema as S
from telemill.functions.jsonread import child, jarray, jfirst, jnum, jstr, jtime
from telemill.functions.sqltext import let, lit, once, struct, when
from telemill.functions.text import drop_nulls, instant_text, joined_parts, prefixed_id, truncate

# Source kinds and the names used inside fingerprints.
KIND_NAMES = {
    "cloudtrail": "CloudTrail",
    "guardduty": "GuardDuty",
    "securityhub": "SecurityHub",
    "cloudwatch": "CloudWatchLogs",
    "vpcflow": "VpcFlowLogs",
    "route53": "Route53Resolver",
}
LIST_MEMBERS = {"cloudtrail": "Records", "cloudwatch": "logEvents"}
NETWORK_TYPES = {"vpcflow": "vpc_flow", "route53": "route53_resolver"}


@dataclass(frozen=True)
class AwsOptions:
    """Settings of one AWS source."""

    source_id: str
    account_id: str | None = None
    region: str | None = None
    environment: str = "production"
    application_name: str = "aws-security"
    # None: any size. A breach rejects the single record or the document, as rows of rejected_aws.
    max_record_bytes: int | None = None
    max_batch_events: int | None = None

    def __post_init__(self) -> None:
        if not self.source_id.strip() or len(self.source_id) > 128:
            raise ValueError("source_id must have 1 to 128 characters")
        if self.max_record_bytes is not None and self.max_record_bytes < 1_024:
            raise ValueError("max_record_bytes must be 1 KiB or more")
        if self.max_batch_events is not None and self.max_batch_events < 1:
            raise ValueError("max_batch_events must be 1 or more")
        if self.account_id is not None and not (len(self.account_id) == 12 and self.account_id.isascii() and self.account_id.isdigit()):
            raise ValueError("account_id must be 12 digits")


def records_sql(document: str, kind: str) -> str:
    """Records of a parsed document: the kind's list, a top-level array, or the document itself."""
    choices = [jarray(document, LIST_MEMBERS[kind])] if kind in LIST_MEMBERS else []
    choices += [jarray(document), f"array({document})"]
    return f"coalesce({', '.join(choices)})"


def aws_limits(df: DataFrame, kind: str, options: AwsOptions, column: str = "raw") -> DataFrame:
    """Adds ``records`` (array of VARIANT) and ``failure_code``; with limits, a breach rejects the document.

    Limits are off unless the options set them. The decision is taken before the records are exploded, so
    no grouping is needed for it.
    """
    record, events = options.max_record_bytes, options.max_batch_events
    limit = record * events if record and events else None
    cases = [(f"{column} IS NULL OR trim({column}) = ''", "'empty-payload'")]
    cases += [(f"octet_length({column}) > {limit}", "'document-too-large'")] if limit else []
    cases.append(("doc IS NULL", "'invalid-json'"))
    cases += [(f"size(recs) > {events}", "'batch-too-large'")] if events else []
    cases += [(f"exists(recs, r -> octet_length(to_json(r)) > {record})", "'record-too-large'")] if record else []
    failure = when(cases)
    document = f"IF(octet_length({column}) <= {limit}, try_parse_json({column}), NULL)" if limit else f"try_parse_json({column})"
    body = let("doc", document, let("recs", records_sql("doc", kind), struct(records="recs", failure=failure)))
    return (
        df.transform(once, "_aws", body)
        .withColumn("failure_code", F.col("_aws.failure"))
        .withColumn("records", F.expr("IF(_aws.failure IS NULL, _aws.records, NULL)"))
        .drop("_aws")
    )


def expand_aws(df: DataFrame, kind: str, options: AwsOptions, column: str = "raw") -> DataFrame:
    """One row per record (``record`` VARIANT) of the documents that keep the limits."""
    return aws_limits(df, kind, options, column).select(
        *[c for c in df.columns if c != column], F.explode("records").alias("record")
    )


def rejected_aws(df: DataFrame, kind: str, options: AwsOptions, column: str = "raw") -> DataFrame:
    """The documents that :func:`expand_aws` gives no record of, with their ``failure_code``."""
    return aws_limits(df, kind, options, column).where("failure_code IS NOT NULL").drop("records")


def severity_from_number(value: str) -> str:
    """Finding severity by number."""
    return when(
        [(f"{value} IS NULL", "'medium'"), (f"{value} <= 3.9D", "'low'"), (f"{value} <= 6.9D", "'medium'"), (f"{value} <= 8.9D", "'high'")],
        "'critical'",
    )


def severity_from_label(label: str) -> str:
    """Finding severity by label; anything unknown is medium."""
    return f"IF(lower({label}) IN ('informational', 'low', 'medium', 'high', 'critical'), lower({label}), 'medium')"


def _mapping(kind: str, o: AwsOptions, r: str, observed: str) -> dict[str, str]:
    """Per-kind members of the envelope, as fragments over the record ``r``."""
    raw_text = f"to_json({r})"
    account, region = lit(o.account_id), lit(o.region)
    none = "cast(NULL AS string)"
    base = dict(
        severity="'medium'", result="'unknown'", reason=none, username=none, actor_type="'unknown'",
        source_ip=none, account=f"cast({account} AS string)", region=f"cast({region} AS string)",
    )
    if kind == "cloudtrail":
        event_name = f"coalesce({jstr(r, 'eventName')}, 'Unknown')"
        service = f"coalesce({jstr(r, 'eventSource')}, 'unknown.amazonaws.com')"
        return base | dict(
            id=f"coalesce({jfirst(r, 'eventID', 'eventId')}, {prefixed_id('cloudtrail', raw_text)})",
            time=f"coalesce({jtime(r, 'eventTime')}, {observed})",
            category="'administrative-activity'",
            type="'aws_cloudtrail'",
            action=event_name,
            result=f"IF({jstr(r, 'errorCode')} IS NULL, 'success', 'failure')",
            reason=jstr(r, "errorCode"),
            username=jfirst(r, ("userIdentity", "userName"), ("userIdentity", "principalId")),
            actor_type="'service'",
            target_type="'aws-api'",
            target_name=service,
            source_ip=jstr(r, "sourceIPAddress"),
            account=f"coalesce({jfirst(r, 'recipientAccountId', ('userIdentity', 'accountId'))}, {account})",
            region=f"coalesce({jstr(r, 'awsRegion')}, {region})",
            labels=f"map('aws.service', {service}, 'aws.eventName', {event_name}, 'aws.source', 'cloudtrail')",
        )
    if kind == "guardduty":
        finding = f"coalesce({jstr(r, 'type')}, 'Unknown')"
        number = jnum(r, "severity")
        shown = f"coalesce(regexp_replace(cast({number} AS string), '[.]0$', ''), 'unknown')"
        return base | dict(
            id=f"coalesce({jfirst(r, 'id', 'Arn')}, {prefixed_id('guardduty', raw_text)})",
            time=f"coalesce({jtime(r, 'updatedAt')}, {jtime(r, 'createdAt')}, {observed})",
            category="'application-security'",
            type="'aws_guardduty'",
            action=finding,
            result="'failure'",
            reason=f"coalesce({jfirst(r, 'title', 'type')}, 'GuardDutyFinding')",
            target_type="'finding'",
            target_name=finding,
            account=f"coalesce({jfirst(r, 'accountId', ('resource', 'accountId'))}, {account})",
            region=f"coalesce({jstr(r, 'region')}, {region})",
            labels=f"map('aws.source', 'guardduty', 'aws.findingType', {finding}, 'aws.severity', {shown})",
            severity=severity_from_number(number),
        )
    if kind == "securityhub":
        product = f"coalesce({jstr(r, 'ProductArn')}, 'securityhub')"
        compliance = f"coalesce({jstr(r, 'Compliance', 'Status')}, 'UNKNOWN')"
        return base | dict(
            id=f"coalesce({jfirst(r, 'Id', 'id')}, {prefixed_id('securityhub', raw_text)})",
            time=f"coalesce({jtime(r, 'UpdatedAt')}, {jtime(r, 'CreatedAt')}, {observed})",
            category="'application-security'",
            type="'aws_security_hub'",
            action=f"coalesce({jfirst(r, 'Title', 'GeneratorId')}, 'SecurityHubFinding')",
            result=f"IF(upper({compliance}) = 'FAILED', 'failure', 'success')",
            reason=compliance,
            target_type="'finding'",
            target_name=product,
            account=f"coalesce({jstr(r, 'AwsAccountId')}, {account})",
            region=f"coalesce({jstr(r, 'Region')}, {region})",
            labels=f"map('aws.source', 'securityhub', 'aws.productArn', {product}, 'aws.compliance', {compliance})",
            severity=severity_from_label(jstr(r, "Severity", "Label")),
        )
    if kind == "cloudwatch":
        message = f"coalesce({jstr(r, 'message')}, '')"
        millis = f"IF(schema_of_variant({child(r, 'timestamp')}) = 'STRING', NULL, try_variant_get({r}, '$.timestamp', 'bigint'))"
        return base | dict(
            id=f"coalesce({jstr(r, 'id')}, {prefixed_id('cloudwatch', raw_text)})",
            time=f"coalesce(timestamp_millis({millis}), {observed})",
            category="'application-security'",
            type="'aws_cloudwatch_logs'",
            action="'log_event'",
            target_type="'log'",
            target_name=lit(o.source_id),
            labels=f"map('aws.source', 'cloudwatch-logs', 'aws.messagePreview', {truncate(message, 256)})",
        )
    name = NETWORK_TYPES[kind]
    return base | dict(
        id=f"coalesce({jstr(r, 'id')}, {prefixed_id(name, raw_text)})",
        time=f"coalesce({jtime(r, 'eventTime')}, {jtime(r, 'start')}, {observed})",
        category="'api-security'",
        type=lit(name),
        action=lit(name),
        target_type="'network'",
        target_name=lit(name),
        source_ip=jfirst(r, "srcAddr", "sourceIPAddress", "query_name"),
        labels=f"map('aws.source', {lit(name)})",
    )


def aws_envelope(kind: str, o: AwsOptions, record: str, observed: str) -> str:
    """Envelope struct of one record; ids are derived from the fingerprint, so a replay repeats them."""
    m = _mapping(kind, o, record, observed)
    print_parts = joined_parts(lit(o.source_id), lit(KIND_NAMES[kind]), "m.id", instant_text("m.time"))
    own = f"map('aws.sourceId', {lit(o.source_id)}, 'event.fingerprint', fp)"
    optional = drop_nulls("map('aws.region', nullif(trim(m.region), ''), 'aws.accountId', nullif(trim(m.account), ''))")
    values = {
        "schemaVersion": lit(S.SCHEMA_VERSION),
        "eventId": "concat_ws('-', substring(fp, 1, 8), substring(fp, 9, 4), substring(fp, 13, 4), substring(fp, 17, 4), substring(fp, 21, 12))",
        "eventOriginalId": "m.id",
        "timeGenerated": "m.time",
        "timeObserved": observed,
        "eventCategory": "m.category",
        "eventType": "m.type",
        "eventAction": "m.action",
        "eventResult": "m.result",
        "eventSeverity": "m.severity",
        "eventOutcomeReason": "m.reason",
        "application": f"cast({struct(name=lit(o.application_name), version='NULL', environment=lit(o.environment), instance='NULL', tenantId='m.account')} AS {S.APPLICATION})",
        "actor": f"IF(m.username IS NULL, NULL, cast({struct(userId='NULL', username='m.username', displayName='NULL', type='m.actor_type', role='NULL')} AS {S.ACTOR}))",
        "target": f"cast({struct(type='m.target_type', id='NULL', name='m.target_name')} AS {S.TARGET})",
        "source": f"IF(m.source_ip IS NULL, NULL, cast({struct(ipAddress='m.source_ip', hostname='NULL', port='NULL')} AS {S.SOURCE}))",
        "request": f"cast(NULL AS {S.REQUEST})",
        "change": f"cast(NULL AS {S.CHANGE})",
        "security": f"cast(NULL AS {S.SECURITY})",
        "collector": f"cast({struct(id=lit(o.source_id), version=lit('0.1.0'), sourceAdapter=lit('aws.' + KIND_NAMES[kind].lower()), configurationHash='left(fp, 16)', batchId='NULL', receivedAt=observed)} AS {S.COLLECTOR})",
        "labels": f"map_concat(m.labels, {own}, {optional})",
        "attributes": f"map('aws.raw', {record})",
        "privacy": f"cast(NULL AS {S.PRIVACY})",
    }
    return let("m", struct(**m), let("fp", f"sha2({print_parts}, 256)", struct(**values)))


def map_aws(df: DataFrame, kind: str, options: AwsOptions, observed: str, column: str = "raw") -> DataFrame:
    """Documents of one kind to ``event`` envelopes, one row per record."""
    if kind not in KIND_NAMES:
        raise ValueError(f"unknown AWS source kind: {kind}")
    return expand_aws(df, kind, options, column).transform(once, "event", aws_envelope(kind, options, "record", observed))
