"""Registered queries over sources: AWS documents, host lines, semantic rows, incremental scans."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.plans.inputs import NOW, numbered_events, table
from telemill.sources import aws, hostlogs, incremental, semantic

OPTIONS = aws.AwsOptions("src-1", account_id="123456789012", region="ap-southeast-2")
T = "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z')"
TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
E = "e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"

# Kind: (document per event as Spark SQL, expected members as DuckDB SQL over e: original id, time, category,
# type, action, result, severity, reason, actor, target, ip, account, region).
AWS_DOCUMENTS = {
    "cloudtrail": (
        f"named_struct('Records', array(named_struct('eventID', concat('e', event_id), 'eventTime', {T}, 'eventName', event_type, 'eventSource', 'svc', 'errorCode', IF(k % 2 = 0, 'Denied', NULL), 'sourceIPAddress', IF(k % 3 = 0, '1.2.3.4', NULL), 'awsRegion', IF(k % 5 = 0, 'us-east-1', NULL), 'userIdentity', named_struct('userName', IF(k > 50, concat('u', user_id), NULL), 'accountId', '999988887777'))))",
        ("'e' || event_id", TIME, "'administrative-activity'", "'aws_cloudtrail'", "event_type", "CASE WHEN k % 2 = 0 THEN 'failure' ELSE 'success' END", "'medium'", "CASE WHEN k % 2 = 0 THEN 'Denied' ELSE '-' END", "CASE WHEN k > 50 THEN 'u' || user_id ELSE '-' END", "'svc'", "CASE WHEN k % 3 = 0 THEN '1.2.3.4' ELSE '-' END", "'999988887777'", "CASE WHEN k % 5 = 0 THEN 'us-east-1' ELSE 'ap-southeast-2' END"),
    ),
    "guardduty": (
        f"named_struct('id', concat('g', event_id), 'type', event_type, 'title', concat('T', k), 'severity', IF(k < 5, NULL, k / 10), 'createdAt', {T}, 'region', 'r1', 'accountId', '111122223333')",
        ("'g' || event_id", TIME, "'application-security'", "'aws_guardduty'", "event_type", "'failure'", "CASE WHEN k < 5 THEN 'medium' WHEN k <= 39 THEN 'low' WHEN k <= 69 THEN 'medium' WHEN k <= 89 THEN 'high' ELSE 'critical' END", "'T' || k", "'-'", "event_type", "'-'", "'111122223333'", "'r1'"),
    ),
    "securityhub": (
        f"named_struct('Id', concat('h', event_id), 'Title', event_type, 'ProductArn', 'arn', 'AwsAccountId', '111122223333', 'Region', 'r2', 'UpdatedAt', {T}, 'Severity', named_struct('Label', CASE k % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'odd' ELSE 'INFORMATIONAL' END), 'Compliance', named_struct('Status', IF(k % 2 = 0, 'FAILED', 'PASSED')))",
        ("'h' || event_id", TIME, "'application-security'", "'aws_security_hub'", "event_type", "CASE WHEN k % 2 = 0 THEN 'failure' ELSE 'success' END", "CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'informational' END", "CASE WHEN k % 2 = 0 THEN 'FAILED' ELSE 'PASSED' END", "'-'", "'arn'", "'-'", "'111122223333'", "'r2'"),
    ),
    "cloudwatch": (
        "named_struct('logEvents', array(named_struct('id', concat('w', event_id), 'timestamp', unix_seconds(ts) * 1000, 'message', concat('m', k)), named_struct('id', concat('x', event_id), 'timestamp', unix_seconds(ts) * 1000, 'message', repeat('y', 300))))",
        ("w || event_id", TIME, "'application-security'", "'aws_cloudwatch_logs'", "'log_event'", "'unknown'", "'medium'", "'-'", "'-'", "'src-1'", "'-'", "'123456789012'", "'ap-southeast-2'"),
    ),
    "vpcflow": (
        f"array(named_struct('id', concat('v', event_id), 'srcAddr', IF(k % 2 = 0, '10.0.0.1', NULL), 'sourceIPAddress', '10.0.0.2', 'start', {T}))",
        ("'v' || event_id", TIME, "'api-security'", "'vpc_flow'", "'vpc_flow'", "'unknown'", "'medium'", "'-'", "'-'", "'vpc_flow'", "CASE WHEN k % 2 = 0 THEN '10.0.0.1' ELSE '10.0.0.2' END", "'123456789012'", "'ap-southeast-2'"),
    ),
    "route53": (
        f"named_struct('id', concat('q', event_id), 'query_name', concat('h', k, '.example'), 'eventTime', {T})",
        ("'q' || event_id", TIME, "'api-security'", "'route53_resolver'", "'route53_resolver'", "'unknown'", "'medium'", "'-'", "'-'", "'route53_resolver'", "'h' || k || '.example'", "'123456789012'", "'ap-southeast-2'"),
    ),
}
_NAMES = ("original_id", "time", "category", "type", "action", "result", "severity", "reason", "actor", "target", "ip", "account", "region")


def _aws_raw(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return numbered_events(spark, sf_dir).select("event_id", F.expr(f"to_json({AWS_DOCUMENTS[kind][0]})").alias("raw"))


def aws_query(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an AWS document of one kind, mapped to envelopes."""
    mapped = aws.map_aws(_aws_raw(spark, sf_dir, kind), kind, OPTIONS, NOW)
    dash = F.lit("-")
    e = "event"
    return mapped.select(
        "event_id",
        F.col(f"{e}.eventOriginalId").alias("original_id"),
        F.date_format(f"{e}.timeGenerated", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.col(f"{e}.eventCategory").alias("category"),
        F.col(f"{e}.eventType").alias("type"),
        F.col(f"{e}.eventAction").alias("action"),
        F.col(f"{e}.eventResult").alias("result"),
        F.col(f"{e}.eventSeverity").alias("severity"),
        F.coalesce(f"{e}.eventOutcomeReason", dash).alias("reason"),
        F.coalesce(f"{e}.actor.username", dash).alias("actor"),
        F.col(f"{e}.target.name").alias("target"),
        F.coalesce(f"{e}.source.ipAddress", dash).alias("ip"),
        F.col(f"{e}.labels")["aws.accountId"].alias("account"),
        F.col(f"{e}.labels")["aws.region"].alias("region"),
        F.col(f"{e}.labels")["event.fingerprint"].alias("fingerprint"),
        F.length(F.coalesce(F.col(f"{e}.labels")["aws.messagePreview"], F.lit(""))).cast("bigint").alias("preview_chars"),
    )


def aws_oracle(kind: str) -> str:
    """Expected envelopes of one kind."""
    members = AWS_DOCUMENTS[kind][1]
    source = "e" if kind != "cloudwatch" else "(SELECT *, unnest(['w', 'x']) AS w FROM e)"
    columns = ", ".join(f"CAST({m} AS VARCHAR) AS {n}" for n, m in zip(_NAMES, members))
    preview = "CASE w WHEN 'w' THEN length('m' || k) ELSE 256 END" if kind == "cloudwatch" else "0"
    return f"""
        WITH {E}
        SELECT event_id, {columns},
          sha256(concat_ws(chr(31), 'src-1', '{aws.KIND_NAMES[kind]}', {members[0]}, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.0000000+00:00')) AS fingerprint,
          CAST({preview} AS BIGINT) AS preview_chars
        FROM {source}
    """


def aws_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document limits: records too large, batches too large, bad JSON."""
    small = aws.AwsOptions("src-1", max_record_bytes=1_024, max_batch_events=3)
    raw = """CASE WHEN k % 5 = 0 THEN '{oops' WHEN k % 5 = 1 THEN to_json(array(named_struct('a', 1), named_struct('a', 2), named_struct('a', 3), named_struct('a', 4)))
        WHEN k % 5 = 2 THEN to_json(named_struct('title', repeat('x', 2000))) WHEN k % 5 = 3 THEN repeat(' {}', 1200) ELSE to_json(named_struct('id', event_id)) END"""
    docs = numbered_events(spark, sf_dir).withColumn("raw", F.expr(raw))
    return aws.aws_limits(docs, "guardduty", small).groupBy(F.coalesce("failure_code", F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


AWS_LIMITS_SQL = f"""
    WITH {E} SELECT CASE k % 5 WHEN 0 THEN 'invalid-json' WHEN 1 THEN 'batch-too-large' WHEN 2 THEN 'record-too-large' WHEN 3 THEN 'document-too-large' ELSE 'ok' END AS code, count(*) AS n FROM e GROUP BY 1
"""

LINE = """CASE WHEN k % 10 = 0 THEN '   ' WHEN k % 10 = 1 THEN concat('Failed password for u', user_id) WHEN k % 10 = 2 THEN concat('ACCEPTED key ', k)
    WHEN k % 10 = 3 THEN concat('critical error code ', k) WHEN k % 10 = 4 THEN concat('access Denied ', event_id) ELSE concat('line ', event_id) END"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_events(spark, sf_dir).select(F.col("event_type").alias("source_id"), F.col("event_id").alias("line_no"), F.expr(LINE).alias("line"), "event_id")


def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of five hosts, one source switched off, with host metadata."""
    rows = table(spark, sf_dir, "events").select("event_type").distinct()
    kind = "CASE event_type WHEN 'error' THEN 'Auth' WHEN 'click' THEN 'Auditd' WHEN 'view' THEN 'Sysmon' ELSE 'Custom' END"
    sources = rows.select(
        F.col("event_type").alias("id"), F.expr(kind).alias("kind"), F.concat(F.lit("/var/log/"), "event_type").alias("path"),
        F.expr("event_type <> 'signup'").alias("enabled"),
    )
    none = F.lit(None).cast("string")
    metadata = rows.filter("event_type <> 'view'").select(
        F.col("event_type").alias("source_id"), F.concat(F.lit("i-"), "event_type").alias("instance_id"), F.lit("123").alias("account_id"), F.lit("r1").alias("region"),
        F.lit("az").alias("availability_zone"), F.lit("vpc").alias("vpc_id"), none.alias("subnet_id"), none.alias("ami_id"), F.array(F.lit("a"), F.lit("b")).alias("security_groups"),
        none.alias("auto_scaling_group"), none.alias("ecs_cluster"), none.alias("eks_cluster"), F.create_map(F.lit("env"), F.lit("x")).alias("tags"),
    )
    done = hostlogs.map_host_lines(_lines(spark, sf_dir), sources, hostlogs.LineOptions("agent", "hosts"), NOW, metadata)
    return done.select(
        "event_id", "line_index", F.col("event.eventOriginalId").alias("original_id"), F.col("event.eventCategory").alias("category"),
        F.col("event.eventType").alias("type"), F.col("event.eventAction").alias("action"), F.col("event.eventResult").alias("result"),
        F.col("event.eventSeverity").alias("severity"), F.coalesce("event.source.hostname", F.lit("-")).alias("host"),
        F.size("event.labels").cast("bigint").alias("labels"), F.coalesce(F.expr("event.labels['aws.securityGroups']"), F.lit("-")).alias("groups"),
    )


_LINES_CTE = f"""
    {E}, l AS (SELECT *, {LINE} AS line FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM l WHERE trim(line) <> '')
"""
HOST_LINES_SQL = f"""
    WITH {_LINES_CTE}, x AS (SELECT *, CASE event_type WHEN 'error' THEN 'Auth' WHEN 'click' THEN 'Auditd' WHEN 'view' THEN 'Sysmon' ELSE 'Custom' END AS kind FROM n WHERE event_type <> 'signup')
    SELECT event_id, idx AS line_index, substr(sha256(event_type || chr(31) || idx || chr(31) || line), 1, 24) AS original_id,
      CASE WHEN k % 10 = 1 OR contains(line, '4625') OR kind = 'Auth' THEN 'authentication' WHEN kind = 'Auditd' THEN 'administrative-activity' ELSE 'application-security' END AS category,
      CASE kind WHEN 'Auth' THEN 'host_auth' WHEN 'Auditd' THEN 'host_auditd' WHEN 'Sysmon' THEN 'host_sysmon' ELSE 'host_custom' END AS type,
      CASE WHEN k % 10 = 1 THEN 'authentication.failure' ELSE lower(kind) || '.event' END AS action,
      CASE WHEN k % 10 IN (1, 4) OR contains(line, '4625') THEN 'failure' WHEN k % 10 = 2 OR contains(line, '4624') THEN 'success' ELSE 'unknown' END AS result,
      CASE k % 10 WHEN 3 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN event_type = 'view' THEN '-' ELSE 'i-' || event_type END AS host,
      CAST(CASE WHEN event_type = 'view' THEN 4 ELSE 11 END AS BIGINT) AS labels, CASE WHEN event_type = 'view' THEN '-' ELSE 'a,b' END AS groups
    FROM x
"""


def custom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companion-agent lines; lines over the limit carry a failure."""
    targets = table(spark, sf_dir, "events").select("event_type").distinct().select(
        F.col("event_type").alias("id"), F.concat(F.lit("/f/"), "event_type").alias("path"), F.lit("json").alias("format"), F.lit(True).alias("enabled")
    )
    options = hostlogs.LineOptions("agent", "files", max_line_bytes=20)
    done = hostlogs.map_custom_log_lines(_lines(spark, sf_dir).withColumnRenamed("source_id", "target_id"), targets, options, NOW)
    return done.select(
        "event_id", F.coalesce("failure_code", F.lit("-")).alias("code"), F.coalesce("event.eventOriginalId", F.lit("-")).alias("original_id"),
        F.coalesce("event.target.name", F.lit("-")).alias("path"), F.coalesce(F.expr("event.labels['ama.linePreview']"), F.lit("-")).alias("preview"),
    )


CUSTOM_LINES_SQL = f"""
    WITH {_LINES_CTE}, x AS (SELECT *, length(line) > 20 AS big FROM n)
    SELECT event_id, CASE WHEN big THEN 'line-too-large' ELSE '-' END AS code,
      CASE WHEN big THEN '-' ELSE substr(sha256(event_type || chr(31) || idx || chr(31) || line), 1, 24) END AS original_id,
      CASE WHEN big THEN '-' ELSE '/f/' || event_type END AS path, CASE WHEN big THEN '-' ELSE line END AS preview
    FROM x
"""

APP = semantic.ApplicationInfo("shop", "test")


def authentication_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed sign-ins from the error events."""
    rows = numbered_events(spark, sf_dir).filter("event_type = 'error'").selectExpr(
        "event_id", "IF(k < 10, ' ', concat('user', user_id)) AS username", "concat('u', user_id) AS user_id", "'bad password' AS failure_reason",
        "concat('c', event_id) AS correlation_id", "IF(k % 2 = 0, '10.0.0.1', NULL) AS source_ip", "concat('o', event_id) AS original_event_id",
    )
    done = semantic.authentication_failed(rows, APP, NOW)
    return done.select(
        "event_id", F.array_join("rejects", ",").alias("rejects"), F.coalesce("event.eventType", F.lit("-")).alias("type"),
        F.coalesce("event.actor.username", F.lit("-")).alias("actor"), F.coalesce("event.source.ipAddress", F.lit("-")).alias("ip"),
        F.coalesce("event.eventResult", F.lit("-")).alias("result"),
    )


AUTH_SQL = f"""
    WITH {E} SELECT event_id, CASE WHEN k < 10 THEN 'username' ELSE '' END AS rejects, CASE WHEN k < 10 THEN '-' ELSE 'authentication_failure' END AS type,
      CASE WHEN k < 10 THEN '-' ELSE 'user' || user_id END AS actor, CASE WHEN k >= 10 AND k % 2 = 0 THEN '10.0.0.1' ELSE '-' END AS ip,
      CASE WHEN k < 10 THEN '-' ELSE 'failure' END AS result FROM e WHERE event_type = 'error'
"""


def role_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role changes from the sign-ups."""
    rows = numbered_events(spark, sf_dir).filter("event_type = 'signup'").selectExpr(
        "event_id", "concat('u', user_id) AS actor_user_id", "concat('t', k) AS target_user_id", "'admin' AS role", "IF(k % 2 = 0, 'added', 'removed') AS change",
        "'why' AS reason", "concat('c', event_id) AS correlation_id",
    )
    done = semantic.role_membership_changed(rows, APP, NOW)
    dash = F.lit("-")
    return done.select(
        "event_id", F.col("event.eventAction").alias("action"), F.coalesce("event.change.previousValue", dash).alias("before"),
        F.coalesce("event.change.newValue", dash).alias("after"), F.col("event.target.id").alias("target"),
    )


ROLES_SQL = f"""
    WITH {E} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'role.add' ELSE 'role.remove' END AS action, CASE WHEN k % 2 = 0 THEN '-' ELSE 'admin' END AS before,
      CASE WHEN k % 2 = 0 THEN 'admin' ELSE '-' END AS after, 't' || k AS target FROM e WHERE event_type = 'signup'
"""


def data_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data exports from the purchases; a negative count is refused."""
    rows = numbered_events(spark, sf_dir).filter("event_type = 'purchase'").selectExpr(
        "event_id", "concat('u', user_id) AS actor_user_id", "concat('x', event_id) AS export_id", "'PII' AS data_classification", "'csv' AS export_format",
        "k - 5 AS record_count", "concat('c', event_id) AS correlation_id",
    )
    done = semantic.sensitive_data_exported(rows, APP, NOW)
    return done.select(
        "event_id", F.array_join("rejects", ",").alias("rejects"), F.coalesce(F.expr("event.labels['dataClassification']"), F.lit("-")).alias("label"),
        F.coalesce(F.expr("cast(event.attributes['recordCount'] AS bigint)"), F.lit(-1)).alias("records"), F.coalesce("event.eventOriginalId", F.lit("-")).alias("original_id"),
    )


EXPORTS_SQL = f"""
    WITH {E} SELECT event_id, CASE WHEN k < 5 THEN 'record_count' ELSE '' END AS rejects, CASE WHEN k < 5 THEN '-' ELSE 'PII' END AS label,
      CAST(CASE WHEN k < 5 THEN -1 ELSE k - 5 END AS BIGINT) AS records, CASE WHEN k < 5 THEN '-' ELSE 'x' || event_id END AS original_id FROM e WHERE event_type = 'purchase'
"""

# ---- incremental scans ---------------------------------------------------------------------------

CURSOR = incremental.Cursor(400, datetime(1997, 6, 1, tzinfo=timezone.utc))
BATCH = 1000
ORDER_COLUMNS = dict(sequence="o_orderkey", event_time="o_orderdate")
_AFTER = {
    "incrementing": ("o_orderkey > 400", "o_orderkey"),
    "timestamp": ("o_orderdate >= TIMESTAMP '1997-06-01' - INTERVAL 3 DAYS", "o_orderdate, o_orderkey"),
    "composite": ("(o_orderdate, o_orderkey) > (TIMESTAMP '1997-06-01', 400)", "o_orderdate, o_orderkey"),
}


def _scan(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return incremental.incremental_scan(orders, kind, CURSOR, BATCH, overlap=timedelta(days=3), **ORDER_COLUMNS)


def scan_query(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of an incremental scan over the orders."""
    return _scan(kind, spark, sf_dir).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def scan_oracle(kind: str) -> str:
    """The batch by filter, order and limit."""
    where, order = _AFTER[kind]
    return f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT * FROM orders WHERE {where} ORDER BY {order} LIMIT {BATCH})"


def cursors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next cursor and guards of a batch of every kind."""
    reports = []
    for kind in incremental.KINDS:
        report = incremental.batch_report(
            _scan(kind, spark, sf_dir), kind, CURSOR, BATCH, 60, timedelta(days=3), **ORDER_COLUMNS
        )
        reports.append(
            report.select(
                F.lit(kind).alias("kind"), "rows", "advanced", "sequence", F.date_format("event_time", "yyyy-MM-dd").alias("day"), "saturated", "oversized"
            )
        )
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


CURSORS_SQL = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{kind}' AS kind, count(*) OVER () AS rows, true AS advanced, o_orderkey AS sequence, strftime(o_orderdate, '%Y-%m-%d') AS day, false AS saturated, true AS oversized
    FROM (SELECT * FROM orders WHERE {where} ORDER BY {order} LIMIT {BATCH}) ORDER BY {", ".join(c + " DESC" for c in order.split(", "))} LIMIT 1)"""
    for kind, (where, order) in _AFTER.items()
)


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as audit rows."""
    columns = {"sequence": "o_orderkey", "event_time": "o_orderdate", "username": "o_orderpriority", "action": "o_orderstatus"}
    done = incremental.map_audit_rows(table(spark, sf_dir, "orders"), columns, "orders-db")
    return done.select("sequence", "original_id", "username", "action", F.coalesce("target_id", F.lit("-")).alias("target"), "fingerprint")


AUDIT_SQL = """
    SELECT o_orderkey AS sequence, CAST(o_orderkey AS VARCHAR) AS original_id, o_orderpriority AS username, o_orderstatus AS action, '-' AS target,
      sha256(concat_ws(chr(31), 'orders-db', o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.0000000+00:00')) AS fingerprint FROM orders
"""


def cursor_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor per customer from an append-only log, and one proposal each; stale ones are refused."""
    orders = table(spark, sf_dir, "orders")
    log = orders.select(
        F.concat(F.lit("s"), "o_custkey").alias("source_id"), F.col("o_orderkey").cast("string").alias("value"), (F.col("o_orderkey") + 1).alias("version"),
        F.col("o_orderdate").alias("updated_at"),
    )
    current = incremental.current_cursors(log)
    proposals = table(spark, sf_dir, "customer").join(
        orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("top")), F.col("c_custkey") == F.col("o_custkey"), "left"
    ).select(
        F.concat(F.lit("s"), "c_custkey").alias("source_id"), F.expr("IF(c_custkey % 3 = 0, 0, coalesce(top + 1, 0))").alias("expected_version"),
        F.lit("next").alias("value"), F.current_timestamp().alias("updated_at"),
    )
    advanced, refused = incremental.advance_cursors(current, proposals)
    return advanced.select("source_id", "version", F.lit("advanced").alias("outcome")).unionByName(
        refused.select("source_id", F.col("expected_version").alias("version"), F.lit("conflict").alias("outcome"))
    )


CURSOR_ADVANCE_SQL = """
    WITH t AS (SELECT o_custkey, max(o_orderkey) + 1 AS v FROM orders GROUP BY 1),
    p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE coalesce(v, 0) END AS expected, coalesce(v, 0) AS cur FROM customer LEFT JOIN t ON o_custkey = c_custkey)
    SELECT 's' || c_custkey AS source_id, CASE WHEN expected = cur THEN expected + 1 ELSE expected END AS version, CASE WHEN expected = cur THEN 'advanced' ELSE 'conflict' END AS outcome FROM p
"""


def build() -> dict:
    """Query name to (callable, oracle SQL or None)."""
    found = {f"aws_{kind}": (partial(aws_query, kind), aws_oracle(kind)) for kind in AWS_DOCUMENTS}
    found |= {f"scan_{kind}": (partial(scan_query, kind), scan_oracle(kind)) for kind in incremental.KINDS}
    return found | {
        "aws_limits": (aws_limits, AWS_LIMITS_SQL),
        "host_lines": (host_lines, HOST_LINES_SQL),
        "custom_log_lines": (custom_lines, CUSTOM_LINES_SQL),
        "authentication_failed": (authentication_failed, AUTH_SQL),
        "role_membership_changed": (role_changes, ROLES_SQL),
        "sensitive_data_exported": (data_exports, EXPORTS_SQL),
        "next_cursor": (cursors_query, CURSORS_SQL),
        "audit_rows": (audit_rows, AUDIT_SQL),
        "cursor_advance": (cursor_advance, CURSOR_ADVANCE_SQL),
    }
