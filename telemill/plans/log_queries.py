"""Registered queries over log lines in four formats, all made from the events table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators import logs
from telemill.plans.inputs import numbered_events, table

TS = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
OTS = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
E = "e AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"

# Format: (line as Spark SQL, file has a header line).
LINES = {
    "json": f"to_json(named_struct('timestamp', {TS}, 'user', concat('u', user_id), 'source_ip', concat('10.0.0.', k), 'count', event_id, 'ok', k > 50, 'note', IF(k % 2 = 0, 'even', NULL), 'token', 'secret', 'net', named_struct('port', k, 'deep', named_struct('zone', event_type)), 'list', array(1)))",
    "csv": f"concat_ws(',', {TS}, concat('\"', 'name, ', user_id, '\"'), concat('10.0.0.', k), event_id, IF(k > 50, 'true', 'False'), 'pw')",
    "keyvalue": f"concat('timestamp=', {TS}, ' user=\"u ', user_id, '\" count=', event_id, ' password=x action=', event_type, ' action=', event_type, '2')",
    "regex": f"concat({TS}, ' ', IF(k % 2 = 0, 'ERROR', 'INFO'), ' user ', user_id, ' did ', event_type)",
    "http": "concat('10.0.0.', k, ' - user', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), '] \"GET /p/', event_type, ' HTTP/1.1\" ', 200 + k % 5, ' ', IF(k % 2 = 0, '-', cast(event_id AS string)))",
    "syslog": "concat('<13>', date_format(ts, 'MMM dd HH:mm:ss'), ' host', k % 7, ' sshd', IF(k % 2 = 0, concat('[', event_id, ']'), ''), ': user ', user_id)",
}
HEADER = "timestamp,username,src_ip,count,ok,password"
CONFIGS = {
    "json": logs.LogConfig("json"),
    "csv": logs.LogConfig("csv", delimiter=",", headers=tuple(HEADER.split(","))),
    "keyvalue": logs.LogConfig("keyvalue", separator="="),
    "regex": logs.LogConfig("regex", pattern=logs.LINE_PATTERNS["timestamp-severity"][0], groups=logs.LINE_PATTERNS["timestamp-severity"][1]),
    "http": logs.LogConfig("regex", pattern=logs.LINE_PATTERNS["http-access"][0], groups=logs.LINE_PATTERNS["http-access"][1]),
    "syslog": logs.LogConfig("regex", pattern=logs.LINE_PATTERNS["syslog"][0], groups=logs.LINE_PATTERNS["syslog"][1]),
}

# What each format yields per event in DuckDB SQL: field name to value (NULL: absent).
VALUES = {
    "json": {"timestamp": OTS, "user": "'u' || user_id", "source_ip": "'10.0.0.' || k", "count": "event_id", "ok": "CASE WHEN k > 50 THEN 'true' ELSE 'false' END", "note": "CASE WHEN k % 2 = 0 THEN 'even' END", "net.port": "k", "net.deep.zone": "event_type"},
    "csv": {"timestamp": OTS, "username": "'name, ' || user_id", "src_ip": "'10.0.0.' || k", "count": "event_id", "ok": "CASE WHEN k > 50 THEN 'true' ELSE 'False' END"},
    "keyvalue": {"timestamp": OTS, "user": "'u ' || user_id", "count": "event_id", "action": "event_type || '2'"},
    "regex": {"timestamp": OTS, "severity": "CASE WHEN k % 2 = 0 THEN 'ERROR' ELSE 'INFO' END", "message": "'user ' || user_id || ' did ' || event_type"},
    "http": {"source_ip": "'10.0.0.' || k", "identity": "'user' || user_id", "timestamp": "strftime(ts, '%d/%b/%Y:%H:%M:%S')", "method": "'GET'", "path": "'/p/' || event_type", "status": "200 + k % 5", "bytes": "CASE WHEN k % 2 = 0 THEN '-' ELSE CAST(event_id AS VARCHAR) END"},
    "syslog": {"timestamp": "strftime(ts, '%b %d %H:%M:%S')", "host": "'host' || (k % 7)", "application": "'sshd'", "process_id": "CASE WHEN k % 2 = 0 THEN event_id END", "message": "'user ' || user_id"},
}
# Field rows expected of schema inference.
SCHEMAS = {
    "json": (("timestamp", "DateTime", True), ("user", "Text", True), ("source_ip", "IpAddress", True), ("count", "WholeNumber", True), ("ok", "Boolean", True), ("note", "Text", False), ("net.port", "WholeNumber", True), ("net.deep.zone", "Text", True)),
    "csv": (("timestamp", "DateTime", True), ("username", "Text", True), ("src_ip", "IpAddress", True), ("count", "WholeNumber", True), ("ok", "Boolean", True)),
}


def lines(fmt: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line_no, line``: one file per event type, with a header line where the format has one."""
    events = numbered_events(spark, sf_dir)
    body = events.select(F.col("event_type").alias("file"), (F.col("event_id") + 1).alias("line_no"), F.expr(LINES[fmt]).alias("line"))
    if fmt != "csv":
        return body
    heads = events.select(F.col("event_type").alias("file"), F.lit(0).cast("bigint").alias("line_no"), F.lit(HEADER).alias("line")).distinct()
    return body.unionByName(heads)


def parsed(fmt: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines parsed by their configuration."""
    return logs.parse_logs(lines(fmt, spark, sf_dir), CONFIGS[fmt])


def parse_query(fmt: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of all lines."""
    entries = "array_join(transform(array_sort(map_keys(fields)), n -> concat(n, '=', fields[n])), '|')"
    return parsed(fmt, spark, sf_dir).select(
        "file", "line_no", F.coalesce("failure_code", F.lit("-")).alias("code"), F.coalesce(F.expr(entries), F.lit("-")).alias("fields")
    )


def parse_oracle(fmt: str) -> str:
    """The same straight from the events."""
    fields = ", ".join(f"'{n}=' || CAST({v} AS VARCHAR)" for n, v in sorted(VALUES[fmt].items()))
    return f"WITH {E} SELECT event_type AS file, event_id + 1 AS line_no, '-' AS code, array_to_string(list_filter([{fields}], lambda x: x IS NOT NULL), '|') AS fields FROM e"


def infer_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format of every line set, each inferred over all its lines."""
    rows = [logs.infer_log_format(lines(f, spark, sf_dir)).select(F.lit(f).alias("input"), "*") for f in LINES]
    mixed = lines("json", spark, sf_dir).unionByName(lines("regex", spark, sf_dir))
    rows.append(logs.infer_log_format(mixed).select(F.lit("mixed").alias("input"), "*"))
    first = rows[0]
    for other in rows[1:]:
        first = first.unionByName(other)
    dash = F.lit("-")
    return first.select(
        "input", "lines", F.coalesce("format", dash).alias("format"), F.coalesce(F.col("confidence").cast("string"), dash).alias("confidence"),
        F.coalesce("delimiter", dash).alias("delimiter"), F.coalesce("separator", dash).alias("separator"), F.coalesce("pattern_name", dash).alias("pattern"),
    )


FORMATS_SQL = """
    WITH n AS (SELECT count(*) AS n, count(DISTINCT event_type) AS files FROM events)
    SELECT input, n * CASE input WHEN 'mixed' THEN 2 ELSE 1 END + CASE input WHEN 'csv' THEN files ELSE 0 END AS lines, format, confidence, delimiter, separator, pattern FROM n, (VALUES
      ('json', 'json', '1.0', '-', '-', '-'), ('csv', 'csv', '0.95', ',', '-', '-'), ('keyvalue', 'keyvalue', '0.9', '-', '=', '-'),
      ('regex', 'regex', '0.8', '-', '-', 'timestamp-severity'), ('http', 'regex', '0.8', '-', '-', 'http-access'), ('syslog', 'regex', '0.8', '-', '-', 'syslog'),
      ('mixed', '-', '-', '-', '-', '-')) AS t(input, format, confidence, delimiter, separator, pattern)
"""


def schema_query(fmt: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred fields: type, presence, mappings."""
    dash = F.lit("-")
    return logs.infer_schema(parsed(fmt, spark, sf_dir)).select(
        "name", "type", "required", "values", F.coalesce("ocsf_path", dash).alias("ocsf"), F.coalesce("asim_field", dash).alias("asim"), "sensitive"
    )


_MAPPED = {a: (o, s, x) for aliases, o, s, x in logs.FIELD_ALIASES for a in aliases}


def schema_oracle(fmt: str) -> str:
    """Expected field rows, their value counts from the events."""
    rows = []
    for name, kind, required in SCHEMAS[fmt]:
        ocsf, asim, sensitive = _MAPPED.get(name.replace("_", "").replace(".", ""), ("-", "-", True))
        rows.append(
            f"SELECT '{name}' AS name, '{kind}' AS type, {str(required).lower()} AS required, count({VALUES[fmt][name]}) AS values, '{ocsf}' AS ocsf, '{asim}' AS asim, {str(sensitive).lower()} AS sensitive FROM e"
        )
    return f"WITH {E} " + " UNION ALL ".join(rows)


def _schema_rows(fmt: str) -> list[dict]:
    rows = []
    for name, kind, required in SCHEMAS[fmt]:
        ocsf, asim, sensitive = _MAPPED.get(name.replace("_", "").replace(".", ""), (None, None, True))
        rows.append(dict(name=name, type=kind, required=required, ocsf_path=ocsf, asim_field=asim, sensitive=sensitive))
    return rows


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines as typed columns."""
    typed = logs.apply_schema(parsed("csv", spark, sf_dir), _schema_rows("csv"))
    return typed.select(
        "line_no", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"), "username", "src_ip", F.col("count").alias("n"), "ok"
    )


TYPED_SQL = f"""
    WITH {E} SELECT event_id + 1 AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, 'name, ' || user_id AS username, '10.0.0.' || k AS src_ip, event_id AS n, k > 50 AS ok FROM e
"""


def type_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines against a stricter schema: the user name has to be a number."""
    rows = [dict(r, type="WholeNumber") if r["name"] == "count" else dict(r, type="Boolean") if r["name"] == "src_ip" else r for r in _schema_rows("csv")]
    bad = parsed("csv", spark, sf_dir).withColumn("fields", F.expr("IF(line_no % 3 = 0, map_concat(map_filter(fields, (n, v) -> n <> 'src_ip'), map('src_ip', 'TRUE')), fields)"))
    return logs.validate_types(bad, rows).groupBy("file", F.coalesce("failure_code", F.lit("-")).alias("code")).agg(F.count("*").alias("n"))


TYPE_CHECKS_SQL = f"""
    WITH {E} SELECT event_type AS file, CASE WHEN (event_id + 1) % 3 = 0 THEN '-' ELSE 'type-mismatch' END AS code, count(*) AS n FROM e GROUP BY ALL
"""


def preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty rows with sensitive values hidden (a top-k report) beside the counts."""
    counts, rows = logs.preview(parsed("json", spark, sf_dir), _schema_rows("json"))
    entries = "array_join(transform(array_sort(map_keys(fields)), n -> concat(n, '=', fields[n])), '|')"
    return rows.crossJoin(counts).select("file", "line_no", F.expr(entries).alias("fields"), "parsed", "rejected")


PREVIEW_SQL = f"""
    WITH {E}, n AS (SELECT count(*) AS n FROM e), f AS (SELECT * FROM e ORDER BY event_type, event_id LIMIT 20)
    SELECT event_type AS file, event_id + 1 AS line_no,
      array_to_string(list_filter(['count=[redacted]', 'net.deep.zone=[redacted]', 'net.port=[redacted]', CASE WHEN k % 2 = 0 THEN 'note=[redacted]' END, 'ok=[redacted]',
        'source_ip=[redacted:ip]', 'timestamp=' || {OTS}, 'user=[redacted]'], lambda x: x IS NOT NULL), '|') AS fields, n AS parsed, CAST(0 AS BIGINT) AS rejected
    FROM f, n
"""


def expectation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-quality rows over JSON lines."""
    return logs.expectations(parsed("json", spark, sf_dir), _schema_rows("json"))


EXPECTATIONS_SQL = """
    SELECT unnest(['parses representative record', 'rejects malformed record', 'does not emit prohibited fields']) AS name, unnest([n > 0, n = n, n > 0]) AS holds
    FROM (SELECT count(*) AS n FROM events)
"""


def excluded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prohibited names among all property names of the raw JSON lines."""
    raw = lines("json", spark, sf_dir).select(F.explode(F.expr("json_object_keys(line)")).alias("name"))
    return logs.excluded_names(raw)


# Five lines for an event: a document with brackets and quotes in strings, broken where k is 7.
DOCUMENT_LINES = """inline(array(
  named_struct('j', 0, 'line', concat(IF(event_id % 2 = 0, ',', ''), '{"id": ', event_id, ',')),
  named_struct('j', 1, 'line', '  "note": "a ] \\\\" { \\\\\\\\",'),
  named_struct('j', 2, 'line', '  "net": {"zone": "}",'),
  named_struct('j', 3, 'line', concat('    "port": ', IF(k = 7, 'oops', cast(k AS string)), '},')),
  named_struct('j', 4, 'line', concat('  "type": "', event_type, '"}'))))"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents over several lines: arrays of the events of even ids, plain documents of the others."""
    events = numbered_events(spark, sf_dir).withColumn("file", F.concat(F.when(F.col("event_id") % 2 == 0, "array-").otherwise("plain-"), "event_type"))
    body = events.select("file", "event_id", F.expr(DOCUMENT_LINES)).select("file", (F.col("event_id") * 5 + F.col("j") + 5).alias("line_no"), "line")
    arrays = events.where("event_id % 2 = 0").select("file").distinct()
    ends = arrays.select("file", F.expr("inline(array(named_struct('line_no', 1L, 'line', '[ {\"id\": -1}'), named_struct('line_no', 9000000000000L, 'line', ']')))"))
    return body.unionByName(ends)


def json_document_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of all documents."""
    entries = "array_join(transform(array_sort(map_keys(fields)), n -> concat(n, '=', fields[n])), '|')"
    return logs.parse_json_documents(document_lines(spark, sf_dir)).select(
        "file", "line_no", F.coalesce("failure_code", F.lit("-")).alias("code"), F.coalesce(F.expr(entries), F.lit("-")).alias("fields")
    )


JSON_DOCUMENTS_SQL = f"""
    WITH {E}, f AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'array-' ELSE 'plain-' END || event_type AS file FROM e)
    SELECT file, event_id * 5 + 5 AS line_no, CASE WHEN k = 7 THEN 'not-json' ELSE '-' END AS code, CASE WHEN k = 7 THEN '-' ELSE
      'id=' || event_id || '|net.port=' || k || '|net.zone=}}|note=a ] " {{ \\|type=' || event_type END AS fields FROM f
    UNION ALL SELECT DISTINCT file, 1, '-', 'id=-1' FROM f WHERE event_id % 2 = 0
"""


def mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format of each file of a folder of files of different formats; arrays in lines are JSON, too."""
    rows = lines("json", spark, sf_dir).select(F.concat(F.lit("json-"), "file").alias("file"), "line_no", "line")
    for fmt in ("csv", "keyvalue", "regex", "http", "syslog"):
        rows = rows.unionByName(lines(fmt, spark, sf_dir).select(F.concat(F.lit(f"{fmt}-"), "file").alias("file"), "line_no", "line"))
    arrays = lines("json", spark, sf_dir).select(F.lit("arrays").alias("file"), "line_no", F.expr("IF(line_no % 3 = 0, concat('[', line, ', ', line, ']'), line)").alias("line"))
    numbers = lines("json", spark, sf_dir).select(F.lit("numbers").alias("file"), "line_no", F.expr("IF(line_no % 3 = 0, '[1, 2]', line)").alias("line"))
    dash = F.lit("-")
    return logs.infer_log_format(rows.unionByName(arrays).unionByName(numbers), by=["file"]).select(
        "file", "lines", F.coalesce("format", dash).alias("format"), F.coalesce("delimiter", "separator", "pattern_name", dash).alias("detail")
    )


MIXED_FORMATS_SQL = f"""
    WITH {E}, t AS (SELECT event_type AS type, count(*) AS n FROM e GROUP BY 1)
    SELECT fmt || '-' || type AS file, n + CASE fmt WHEN 'csv' THEN 1 ELSE 0 END AS lines, CASE WHEN fmt IN ('http', 'syslog') THEN 'regex' ELSE fmt END AS format,
      CASE fmt WHEN 'json' THEN '-' WHEN 'csv' THEN ',' WHEN 'keyvalue' THEN '=' WHEN 'regex' THEN 'timestamp-severity' WHEN 'http' THEN 'http-access' ELSE 'syslog' END AS detail
    FROM t, (VALUES ('json'), ('csv'), ('keyvalue'), ('regex'), ('http'), ('syslog')) AS f(fmt)
    UNION ALL SELECT 'arrays', count(*), 'json', '-' FROM e
    UNION ALL SELECT 'numbers', count(*), '-', '-' FROM e
"""

# Forms of a date, and whether they are one.
DATE_TEXTS = (
    ("date_format(o_orderdate, 'yyyy-MM-dd')", True), ("date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", True),
    ("date_format(o_orderdate, 'MM/dd/yyyy HH:mm:ss')", True), ("date_format(o_orderdate, 'M/d/yyyy')", True),
    ("date_format(o_orderdate, 'yyyy/MM/dd HH:mm:ss')", True), ("concat(' ', date_format(o_orderdate, 'yyyy/MM/dd'), ' ')", True),
    ("concat(date_format(o_orderdate, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT')", True), ("date_format(o_orderdate, 'dd MMM yyyy')", True),
    ("date_format(o_orderdate, '13/32/yyyy')", False), ("date_format(o_orderdate, 'yyyyMMdd')", False),
    ("concat('Xyz, ', date_format(o_orderdate, 'dd MMM yyyy HH:mm:ss'), ' GMT')", False), ("concat('on ', date_format(o_orderdate, 'yyyy-MM-dd'))", False),
)


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in twelve forms: how many of each count as dates."""
    cases = " ".join(f"WHEN {i} THEN {text}" for i, (text, _) in enumerate(DATE_TEXTS))
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % len(DATE_TEXTS)).alias("form"), F.expr(f"CASE o_orderkey % {len(DATE_TEXTS)} {cases} END").alias("value")
    )
    return orders.groupBy("form").agg(F.count("*").alias("n"), F.expr(f"count_if({logs.is_datetime('value')})").alias("dates"))


DATE_FORMS_SQL = f"""
    SELECT o_orderkey % {len(DATE_TEXTS)} AS form, count(*) AS n, count(*) FILTER ([{", ".join(str(good).lower() for _, good in DATE_TEXTS)}][o_orderkey % {len(DATE_TEXTS)} + 1]) AS dates
    FROM orders GROUP BY 1
"""


def build() -> dict:
    """Query name to (callable, oracle SQL or None)."""
    found = {f"parse_{f}": (partial(parse_query, f), parse_oracle(f)) for f in LINES}
    found |= {f"infer_schema_{f}": (partial(schema_query, f), schema_oracle(f)) for f in SCHEMAS}
    return found | {
        "infer_log_format": (infer_formats, FORMATS_SQL),
        "infer_format_mixed": (mixed_formats, MIXED_FORMATS_SQL),
        "parse_json_documents": (json_document_query, JSON_DOCUMENTS_SQL),
        "date_forms": (date_forms, DATE_FORMS_SQL),
        "apply_schema": (typed_rows, TYPED_SQL),
        "validate_types": (type_checks, TYPE_CHECKS_SQL),
        "log_preview": (preview_query, PREVIEW_SQL),
        "log_expectations": (expectation_query, EXPECTATIONS_SQL),
        "excluded_names": (excluded_query, "SELECT CAST(count(DISTINCT 'token') AS BIGINT) AS excluded FROM events"),
    }
