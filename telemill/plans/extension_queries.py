"""Registered queries that use what a deployment brings along: names, mappers, policies, rules, SQL functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators import envelope, ingest, normalise, policy, rulematch
from telemill.operators.privacy import jsonwalk
from telemill.plans.event_queries import COLLECTOR, JUDGED_CTE, POLICIES
from telemill.plans.inputs import CANDIDATE, CANDIDATE_CTE, NOW, candidates, numbered_events, spread, table


def own_field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose property ``plain`` is a secret by its name, and ``password`` is not."""
    done = jsonwalk.redact_json(candidates(spark, sf_dir), "raw", detectors=(), field_names=("plain",))
    return done.select(
        "event_id", F.array_join("redaction.removed_paths", ",").alias("removed"),
        F.coalesce(F.get_json_object("redaction.json", "$.attributes.password"), F.lit("-")).alias("password"),
        F.coalesce(F.get_json_object("redaction.json", "$.attributes.plain"), F.lit("-")).alias("plain"),
    )


OWN_FIELD_NAMES_SQL = f"""
    WITH {CANDIDATE_CTE}
    SELECT event_id, CASE WHEN failure_code IS NULL THEN '$.attributes.plain' ELSE '' END AS removed,
      CASE WHEN failure_code IS NULL AND has_password THEN 'never-store' ELSE '-' END AS password, '-' AS plain FROM c
"""


def own_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets made from the orders through a mapper of the user's, beside a kind that is not mapped."""
    def ticket(doc: str, now: str) -> dict[str, str]:
        members = normalise.vendor("Ticket", "Help Desk", "Own")(doc, now)
        return {**members, "class_uid": "2004", "class_name": "'Detection Finding'", "message": f"try_variant_get({doc}, '$.summary', 'string')"}

    mappers = normalise.register_mapper(normalise.MAPPERS, "Ticket", ticket)
    raw = "to_json(named_struct('id', concat('t', o_orderkey), 'title', o_orderpriority, 'severity', IF(o_orderkey % 2 = 0, 'HIGH', 'odd'), 'summary', concat('order ', o_orderkey), 'user', concat('c', o_custkey)))"
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 7 = 0, 'Unknown', 'Ticket') AS kind", f"IF(o_orderkey % 11 = 0, '{{', {raw}) AS raw")
    done = normalise.normalise_mixed(rows, "kind", NOW, mappers=mappers)
    dash = F.lit("-")
    return done.select(
        "o_orderkey", F.coalesce("ocsf.failure_code", dash).alias("failure"), F.coalesce("ocsf.event.message", dash).alias("message"),
        F.coalesce(F.col("ocsf.event.class_uid").cast("bigint"), F.lit(0)).alias("class_uid"), F.coalesce("ocsf.event.severity", dash).alias("severity"),
        F.coalesce("ocsf.event.metadata_product_name", dash).alias("product"), F.coalesce("ocsf.event.activity_name", dash).alias("activity"),
    )


OWN_MAPPER_SQL = """
    WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'unsupported-source' WHEN o_orderkey % 11 = 0 THEN 'invalid-json' END AS bad FROM orders)
    SELECT o_orderkey, coalesce(bad, '-') AS failure, CASE WHEN bad IS NULL THEN 'order ' || o_orderkey ELSE '-' END AS message,
      CAST(CASE WHEN bad IS NULL THEN 2004 ELSE 0 END AS BIGINT) AS class_uid, CASE WHEN bad IS NOT NULL THEN '-' WHEN o_orderkey % 2 = 0 THEN 'High' ELSE 'Medium' END AS severity,
      CASE WHEN bad IS NULL THEN 'Help Desk' ELSE '-' END AS product, CASE WHEN bad IS NULL THEN o_orderpriority ELSE '-' END AS activity FROM o
"""


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies read from documents, one of each event type, over all events that decode."""
    events = numbered_events(spark, sf_dir)
    # A document for each event type: configuration, as few as there are types.
    documents = events.select("event_type").distinct().where("event_type <> 'view'").select(F.to_json(F.expr(
        """named_struct('apiVersion', 'example/security/v1', 'kind', 'TelemetryPolicy', 'metadata', named_struct('id', concat('DOC-', upper(event_type)), 'version', '3'),
        'match', named_struct('eventTypes', array(IF(event_type = 'error', 'authentication_failure', event_type))),
        'requirements', named_struct('requiredFields', array('eventId', 'actor.userId')),
        'decision', named_struct('action', IF(event_type = 'click', 'quarantine', 'accept'), 'minimumValueScore', 10))"""
    )).alias("document")).collect()
    policies = [policy.TelemetryPolicy.from_document(json.loads(r.document)) for r in sorted(documents, key=lambda r: r.document)]
    decoded = envelope.decode_envelope(candidates(spark, sf_dir), "raw").filter("event IS NOT NULL")
    judged = policy.evaluate_policies(decoded, policies)
    return judged.groupBy(F.col("decision.policyId").alias("policy_id"), F.col("decision.action").alias("action")).agg(F.count("*").alias("n"))


POLICY_DOCUMENTS_SQL = f"""
    {JUDGED_CTE}
    SELECT CASE WHEN event_type = 'view' THEN 'BWR-POL-DEFAULT-DENY' ELSE 'DOC-' || upper(event_type) END AS policy_id,
      CASE WHEN event_type = 'view' THEN 'reject' WHEN NOT has_actor THEN 'quarantine' WHEN event_type = 'click' THEN 'quarantine' ELSE 'accept' END AS action, count(*) AS n
    FROM d WHERE decodes GROUP BY ALL
"""


def rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from documents, one of each part; documents without a title are told."""
    documents = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.expr(
        """to_json(named_struct('id', concat('doc', p_partkey), 'title', IF(p_partkey % 9 = 0, '', p_name), 'level', IF(p_partkey % 2 = 0, 'HIGH', 'Low'),
        'tags', array(concat('attack.t', p_partkey), 'other'), 'detection', named_struct(
          'selection', named_struct('ActorUsername', array(concat('USER', p_partkey % 150), 'nobody'), 'EventType', 'click'), 'condition', 'selection')))"""
    ).alias("document"))
    rules = rulematch.rules_from_documents(documents, "document")
    decoded = envelope.decode_envelope(candidates(spark, sf_dir), "raw").filter("event IS NOT NULL")
    found = rulematch.alert_totals(decoded, rules.where("failure IS NULL"))
    alerts = found.groupBy("rule_id").agg(F.sum("alerts").alias("alerts"), F.min("risk_score").cast("bigint").alias("risk"), F.min(F.array_join("techniques", ",")).alias("techniques"))
    bad = rules.where("failure IS NOT NULL").agg(F.count("*").alias("alerts")).selectExpr("'refused' AS rule_id", "alerts", "0L AS risk", "'' AS techniques")
    return alerts.unionByName(bad)


RULE_DOCUMENTS_SQL = f"""
    {JUDGED_CTE}
    SELECT 'doc' || p_partkey AS rule_id, count(*) AS alerts, CAST(any_value(CASE WHEN p_partkey % 2 = 0 THEN 75 ELSE 25 END) AS BIGINT) AS risk, 'T' || p_partkey AS techniques
    FROM d JOIN part ON decodes AND has_actor AND event_type = 'click' AND contains('user' || user_id, 'user' || (p_partkey % 150)) AND p_partkey % 9 <> 0 GROUP BY p_partkey
    UNION ALL SELECT 'refused', count(*), 0, '' FROM part WHERE p_partkey % 9 = 0
"""

LONG_ID = "concat('event-', event_id, '-', repeat('x', 90))"


def long_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of events with ids of a hundred characters: their own ids are cut to 128."""
    raw = numbered_events(spark, sf_dir).select("event_id", "event_type", "k", F.expr(CANDIDATE.replace("concat('event-', event_id)", LONG_ID)).alias("raw"))
    done = ingest.process(raw, COLLECTOR, NOW, POLICIES).where("alert IS NOT NULL")
    # An id whose digits pass for a tax file number is masked in its event and alert, so the number is the candidate's own.
    return done.select(
        F.col("event_id").cast("bigint").alias("event_id"), F.length("alert.eventId").cast("bigint").alias("size"),
        F.sha2("alert.eventId", 256).alias("id"), F.length("alert.eventOriginalId").cast("bigint").alias("original_size"), F.sha2("alert.eventOriginalId", 256).alias("original"),
    )


LONG_EVENT_IDS_SQL = f"""
    {JUDGED_CTE},
    a AS (SELECT event_id, 'event-' || event_id || '-' || repeat('x', 90) AS id, worthy_ids FROM d WHERE decodes AND worthy),
    b AS (SELECT event_id, left('privacy-' || id || '-' || left(sha256(worthy_ids), 32), 128) AS alert, left(id || ':' || worthy_ids, 128) AS original FROM a)
    SELECT event_id, length(alert) AS size, sha256(alert) AS id, length(original) AS original_size, sha256(original) AS original FROM b
"""


def sql_more_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other SQL names over numbers and names made from every customer."""
    from telemill.functions.sql import register_sql

    register_sql(spark)
    table(spark, sf_dir, "customer").createOrReplaceTempView("telemill_customers")
    return spark.sql(
        """SELECT c_custkey, digits_only(concat('a-', c_custkey, ' b', c_custkey)) AS digits, valid_luhn(CAST(c_custkey AS STRING)) AS luhn,
        card_network(element_at(array('4111111111111111', '5111111111111111', '341111111111111', '9111111111111111'), CAST(c_custkey % 4 + 1 AS INT))) AS network,
        mask_email(concat(c_name, '@x.org')) AS mail, mask_digits(concat('n', 1000000 + c_custkey)) AS masked, field_key(concat('My_Field-', c_custkey)) AS key,
        safe_stem(concat('a/b:', c_custkey)) AS stem, risk_score(element_at(array('low', 'high', 'odd'), CAST(c_custkey % 3 + 1 AS INT))) + 0L AS risk,
        time_allowed(timestamp'2024-01-01 00:00:00Z' - make_interval(CAST(c_custkey % 8 AS INT)), timestamp'2024-01-01 00:00:00Z') AS allowed FROM telemill_customers"""
    )


SQL_MORE_SQL = """
    WITH c AS (SELECT c_custkey, c_name, CAST(c_custkey AS VARCHAR) AS s FROM customer),
    l AS (SELECT c_custkey, list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN (length(s) - i) % 2 = 1
      THEN CASE WHEN CAST(s[i] AS INT) * 2 > 9 THEN CAST(s[i] AS INT) * 2 - 9 ELSE CAST(s[i] AS INT) * 2 END ELSE CAST(s[i] AS INT) END)) AS total FROM c)
    SELECT c.c_custkey, s || s AS digits, total % 10 = 0 AS luhn, ['Visa', 'Mastercard', 'Amex', NULL][c.c_custkey % 4 + 1] AS network,
      left(c_name, 1) || '***@x.org' AS mail, '***' || right(CAST(1000000 + c.c_custkey AS VARCHAR), 4) AS masked, 'myfield' || s AS key, 'a_b_' || s AS stem,
      CAST([25, 75, 40][c.c_custkey % 3 + 1] AS BIGINT) AS risk, c.c_custkey % 8 <= 5 AS allowed
    FROM c JOIN l ON c.c_custkey = l.c_custkey
"""


def build() -> dict:
    """Query name to (callable, oracle SQL or None)."""
    return {
        "own_field_names": (own_field_names, OWN_FIELD_NAMES_SQL),
        "own_mapper": (own_mapper, OWN_MAPPER_SQL),
        "policy_documents": (policy_documents, POLICY_DOCUMENTS_SQL),
        "rule_documents": (rule_documents, RULE_DOCUMENTS_SQL),
        "long_event_ids": (long_event_ids, LONG_EVENT_IDS_SQL),
        "sql_more_functions": (sql_more_functions, SQL_MORE_SQL),
    }
