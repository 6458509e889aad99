"""Registered queries over ledgers, delivery, collection rules, fleets and streams."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators import dedupe, delivery, fleet, ledger, rules
from telemill.plans.inputs import table
from telemill.session import shared_dir
from telemill.sinks import spool

NOW = "timestamp'1998-01-01 00:00:00Z'"
NOW_SQL = "TIMESTAMP '1998-01-01'"

# An order as a ledger row.
LEDGER_COLUMNS = (
    "concat('o', o_orderkey) AS event_id", "concat('f', o_custkey, '-', o_orderstatus) AS fingerprint", "concat(o_orderpriority, ' ', o_orderkey) AS payload",
    "cast(length(concat(o_orderpriority, ' ', o_orderkey)) AS bigint) AS payload_bytes", "o_orderdate AS received_at", "cast(o_orderkey % 5 AS int) AS state",
    "cast(o_custkey % 12 AS int) AS delivery_attempts", "IF(o_orderkey % 5 = 1, o_orderdate + INTERVAL 30 DAYS, NULL) AS lease_until",
    "IF(o_orderkey % 5 = 2 AND o_custkey % 2 = 0, o_orderdate + INTERVAL 60 DAYS, NULL) AS next_attempt_at", "cast(NULL AS string) AS last_failure_code",
    "cast(NULL AS string) AS acknowledgement", "cast(NULL AS timestamp) AS delivered_at",
)
L = """
l AS (SELECT o_orderkey AS k, o_custkey AS c, 'o' || o_orderkey AS event_id, 'f' || o_custkey || '-' || o_orderstatus AS fingerprint, o_orderpriority || ' ' || o_orderkey AS payload,
  length(o_orderpriority || ' ' || o_orderkey) AS payload_bytes, o_orderdate AS received_at, o_orderkey % 5 AS state, o_custkey % 12 AS delivery_attempts,
  CASE WHEN o_orderkey % 5 = 1 THEN o_orderdate + INTERVAL 30 DAYS END AS lease_until,
  CASE WHEN o_orderkey % 5 = 2 AND o_custkey % 2 = 0 THEN o_orderdate + INTERVAL 60 DAYS END AS next_attempt_at FROM orders)
"""


def ledger_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a ledger row."""
    return table(spark, sf_dir, "orders").selectExpr(*LEDGER_COLUMNS, "o_orderkey", "o_custkey")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per state, bytes, oldest undelivered row."""
    return ledger.ledger_snapshot(ledger_of(spark, sf_dir)).withColumn(
        "oldest_undelivered", F.date_format("oldest_undelivered", "yyyy-MM-dd")
    )


SNAPSHOT_SQL = f"""
    WITH {L} SELECT count(*) FILTER (WHERE state = 0) AS queued, count(*) FILTER (WHERE state = 1) AS uploading, count(*) FILTER (WHERE state = 2) AS retrying,
      count(*) FILTER (WHERE state = 3) AS delivered, count(*) FILTER (WHERE state = 4) AS dead_lettered, CAST(sum(payload_bytes) AS BIGINT) AS total_bytes,
      strftime(min(received_at) FILTER (WHERE state IN (0, 1, 2)), '%Y-%m-%d') AS oldest_undelivered FROM l
"""


def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next rows to deliver, leased."""
    rows = ledger.due_for_delivery(ledger_of(spark, sf_dir), NOW, ledger.MAX_LEASE)
    return ledger.lease(rows, NOW, "INTERVAL 5 MINUTES").select("event_id", F.col("state").cast("bigint").alias("state"), F.col("delivery_attempts").cast("bigint").alias("attempts"))


DUE_SQL = f"""
    WITH {L} SELECT event_id, CAST(1 AS BIGINT) AS state, CAST(delivery_attempts + 1 AS BIGINT) AS attempts FROM (SELECT * FROM l
      WHERE state = 0 OR (state = 2 AND (next_attempt_at IS NULL OR next_attempt_at <= {NOW_SQL})) OR (state = 1 AND lease_until <= {NOW_SQL})
      ORDER BY received_at, event_id LIMIT {ledger.MAX_LEASE})
"""

MOVES = """inline(array(
  named_struct('seq', 1L, 'action', 'lease', 'at', timestamp'1998-01-01 00:00:00Z', 'lease_until', timestamp'1998-01-01 00:05:00Z', 'next_attempt_at', cast(NULL AS timestamp), 'failure_code', cast(NULL AS string), 'acknowledgement', cast(NULL AS string)),
  named_struct('seq', 2L, 'action', CASE o_custkey % 3 WHEN 0 THEN 'delivered' WHEN 1 THEN 'retrying' ELSE 'dead-lettered' END, 'at', timestamp'1998-01-01 00:01:00Z', 'lease_until', cast(NULL AS timestamp),
    'next_attempt_at', timestamp'1998-01-01 00:09:00Z', 'failure_code', 'http-500', 'acknowledgement', 'ack')))"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lease and a result for every ledger row."""
    return ledger_of(spark, sf_dir).selectExpr("event_id", MOVES)


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after the moves, and the refused ones, counted."""
    after, refused = ledger.ledger_apply(ledger_of(spark, sf_dir), transitions(spark, sf_dir))
    kept = after.groupBy(F.expr(ledger.state_name("state")).alias("what"), F.coalesce("last_failure_code", F.lit("-")).alias("detail")).agg(
        F.count("*").alias("n"), F.sum("delivery_attempts").alias("attempts")
    )
    lost = refused.groupBy(F.concat(F.lit("refused "), "action").alias("what"), F.col("from_state").cast("string").alias("detail")).agg(
        F.count("*").alias("n"), F.lit(0).cast("bigint").alias("attempts")
    )
    return kept.unionByName(lost)


APPLIED_SQL = f"""
    WITH {L}, m AS (SELECT *, (state = 0 OR (state = 2 AND (next_attempt_at IS NULL OR next_attempt_at <= {NOW_SQL})) OR (state = 1 AND lease_until <= {NOW_SQL})) AS leased FROM l),
    s AS (SELECT *, (leased OR state = 1) AS moved, CASE c % 3 WHEN 0 THEN 'delivered' WHEN 1 THEN 'retrying' ELSE 'dead-lettered' END AS act,
      CASE state WHEN 0 THEN 'queued' WHEN 1 THEN 'uploading' WHEN 2 THEN 'retrying' WHEN 3 THEN 'delivered' ELSE 'dead-lettered' END AS name FROM m)
    SELECT CASE WHEN moved THEN act ELSE name END AS what, CASE WHEN moved AND act <> 'delivered' THEN 'http-500' ELSE '-' END AS detail, count(*) AS n, CAST(sum(delivery_attempts + leased::INT) AS BIGINT) AS attempts FROM s GROUP BY ALL
    UNION ALL SELECT 'refused lease', CAST(state AS VARCHAR), count(*), 0 FROM s WHERE NOT leased GROUP BY ALL
    UNION ALL SELECT 'refused ' || act, CAST(state AS VARCHAR), count(*), 0 FROM s WHERE NOT moved GROUP BY ALL
"""


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last transition of every row."""
    return ledger.latest_state(transitions(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))


LATEST_SQL = f"WITH {L} SELECT CASE c % 3 WHEN 0 THEN 'delivered' WHEN 1 THEN 'retrying' ELSE 'dead-lettered' END AS action, count(*) AS n, CAST(2 AS BIGINT) AS seq FROM l GROUP BY 1"


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_of(spark, sf_dir).filter("o_orderkey % 3 <> 0")
    status = "CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 408 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 400 ELSE 413 END"
    return delivery.classify_delivery(rows.select("event_id", F.expr(status).alias("status")))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures with their next state and waiting time."""
    done = delivery.route_failures(_failures(spark, sf_dir), ledger_of(spark, sf_dir), NOW)
    wait = f"unix_seconds(next_attempt_at) - unix_seconds({NOW})"
    return done.select("event_id", "code", "next_state", F.expr(f"coalesce({wait}, -1L)").alias("wait"))


ROUTED_SQL = f"""
    WITH {L}, f AS (SELECT *, CASE c % 6 WHEN 1 THEN 408 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 400 WHEN 5 THEN 413 END AS status FROM l WHERE k % 3 <> 0)
    SELECT event_id, CASE WHEN status IS NULL THEN 'azure-upload-failed' ELSE 'azure-http-' || status END AS code,
      CASE WHEN c % 6 < 4 THEN 'retrying' ELSE 'dead-lettered' END AS next_state, CAST(CASE WHEN c % 6 < 4 THEN least(300, 2 ** least(delivery_attempts, 8)) ELSE -1 END AS BIGINT) AS wait FROM f
"""


def acked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the batch without a failure, and failures found again by their payload."""
    batch = ledger_of(spark, sf_dir)
    good = delivery.acknowledged(batch, _failures(spark, sf_dir)).select("event_id", F.lit("acknowledged").alias("how"))
    returned = batch.filter("o_orderkey % 7 = 0").select("payload", F.lit("x").alias("reason"))
    matched = delivery.match_failures(returned, batch).select("event_id", F.lit("matched").alias("how"))
    return good.unionByName(matched)


ACKED_SQL = f"WITH {L} SELECT event_id, 'acknowledged' AS how FROM l WHERE k % 3 = 0 UNION ALL SELECT event_id, 'matched' FROM l WHERE k % 7 = 0"


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First order per fingerprint (customer and status)."""
    return dedupe.dedupe_first(ledger_of(spark, sf_dir)).select("event_id", "fingerprint")


DEDUPED_SQL = f"WITH {L} SELECT event_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY received_at, event_id) AS r FROM l) WHERE r = 1"


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after the first fifth whose fingerprint is not known from the first fifth."""
    rows = ledger_of(spark, sf_dir)
    return dedupe.mark_duplicates(rows.filter("o_orderkey % 5 > 0"), rows.filter("o_orderkey % 5 = 0")).select("event_id")


NEW_ROWS_SQL = f"WITH {L} SELECT event_id FROM l WHERE k % 5 > 0 AND fingerprint NOT IN (SELECT fingerprint FROM l WHERE k % 5 = 0)"


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fit a ledger of 40,000 bytes, per order status."""
    rows = table(spark, sf_dir, "orders").selectExpr(*LEDGER_COLUMNS, "o_orderstatus AS ledger_id").select(
        "ledger_id", "event_id", "received_at", "payload_bytes"
    )
    return dedupe.admit_by_capacity(rows, 40_000, ["ledger_id"]).select("ledger_id", "event_id", "running_bytes", "admitted")


ADMITTED_SQL = f"""
    WITH {L}, x AS (SELECT split_part(fingerprint, '-', 2) AS ledger_id, event_id, CAST(sum(payload_bytes) OVER (PARTITION BY split_part(fingerprint, '-', 2) ORDER BY received_at, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_bytes FROM l)
    SELECT *, running_bytes <= 40000 AS admitted FROM x
"""


def _spool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_of(spark, sf_dir).selectExpr("concat('c', o_custkey % 3) AS collector_id", "'main' AS stream", "event_id", "received_at", "repeat(payload, 1 + o_orderkey % 9) AS payload")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spool files of at most 1,000 bytes per collector: rows and bytes per file."""
    good, _ = spool.split_oversize(_spool_rows(spark, sf_dir), 200)
    files = spool.pack_files(good, 1_000)
    return files.groupBy("collector_id", "batch_no", "file_no").agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("payload") + 1).cast("bigint").alias("bytes"), F.min("_pos").alias("first")
    ).select("collector_id", "batch_no", F.col("file_no").cast("bigint").alias("file_no"), "rows", "bytes", "first")


_SPOOL_CTE = f"""
    {L}, p AS (SELECT 'c' || (c % 3) AS collector_id, event_id, received_at, repeat(payload, CAST(1 + k % 9 AS INTEGER)) AS payload FROM l)
"""
# The greedy rule row by row: a file is full when the next row would not fit.
PACKED_SQL = f"""
    WITH RECURSIVE {_SPOOL_CTE},
    n AS (SELECT collector_id, length(payload) + 1 AS b, row_number() OVER (PARTITION BY collector_id ORDER BY received_at, event_id) AS pos FROM p WHERE length(payload) + 1 <= 200),
    q AS (SELECT *, (pos - 1) // 500 AS batch_no FROM n),
    g AS (
      SELECT collector_id, batch_no, pos, b, CAST(0 AS BIGINT) AS file_no, CAST(b AS BIGINT) AS used FROM q WHERE (pos - 1) % 500 = 0
      UNION ALL
      SELECT q.collector_id, q.batch_no, q.pos, q.b, CASE WHEN g.used + q.b > 1000 THEN g.file_no + 1 ELSE g.file_no END, CASE WHEN g.used + q.b > 1000 THEN q.b ELSE g.used + q.b END
      FROM g JOIN q ON q.collector_id = g.collector_id AND q.batch_no = g.batch_no AND q.pos = g.pos + 1
    )
    SELECT collector_id, batch_no, file_no, count(*) AS rows, CAST(sum(b) AS BIGINT) AS bytes, min(pos) AS first FROM g GROUP BY ALL
"""


def oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that no spool file can hold."""
    _, failures = spool.split_oversize(_spool_rows(spark, sf_dir), 100)
    return failures


OVERSIZE_SQL = f"WITH {_SPOOL_CTE} SELECT event_id, 'record-exceeds-ama-file-limit' AS code, false AS retryable FROM p WHERE length(payload) + 1 > 100"



def spool_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows written to spool files, the first third of them twice, and read back: rows and bytes of each file."""
    place = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    good, _ = spool.split_oversize(_spool_rows(spark, sf_dir), 200)
    files = spool.pack_files(good, 1_000)
    # A delivery that broke off and is run again.
    spool.write_delivery(files.where("batch_no % 3 = 0"), place, "d1")
    spool.write_delivery(files, place, "d1")
    lines = spool.read_delivered(spark, place)
    told = spool.acknowledgements(files, "d1").groupBy("acknowledgement").agg(F.count("*").alias("told"))
    read = lines.groupBy("file").agg(F.count("*").alias("rows"), F.sum(F.octet_length("value") + 1).cast("bigint").alias("bytes"))
    return read.join(told, F.concat(F.lit("spool:"), "file") == F.col("acknowledgement")).select("file", "rows", "bytes", "told")


SPOOL_ROUND_TRIP_SQL = f"""
    WITH RECURSIVE {PACKED_SQL.split("WITH RECURSIVE")[1].rsplit("SELECT collector_id", 1)[0]}
    SELECT collector_id || '-main-d1-' || lpad(CAST(batch_no AS VARCHAR), 10, '0') || '-' || lpad(CAST(file_no AS VARCHAR), 6, '0') AS file,
      count(*) AS rows, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS told FROM g GROUP BY ALL
"""


def _destination(batches):
    """A destination that knows ids: it refuses some rows, and tells some to wait."""
    for batch in batches:
        ids = batch.column("event_id").to_pylist()
        kinds = [int(i[1:]) % 5 for i in ids]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.string()), pa.array([k < 2 for k in kinds]), pa.array([f"ack-{i}" if k < 2 else None for i, k in zip(ids, kinds)], pa.string()),
                pa.array([None if k < 2 else f"http-{400 + k}" for k in kinds], pa.string()), pa.array([k in (2, 3) for k in kinds]),
                pa.array([datetime(1998, 1, 1, 1, tzinfo=timezone.utc) if k == 2 else None for k in kinds], pa.timestamp("us", "UTC")),
            ],
            names=["event_id", "acknowledged", "acknowledgement", "code", "retryable", "retry_after"],
        )


def output_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All due rows leased and sent through an adapter of the user's, and the ledger after its results."""
    rows = ledger_of(spark, sf_dir)
    due = rows.filter(F.expr(ledger.is_due(NOW)))
    sent = ledger.lease(due, NOW, "INTERVAL 5 MINUTES")
    results = delivery.deliver(sent.select("event_id", "payload"), _destination)
    kept = rows.join(due.select("event_id"), "event_id", "left_anti").unionByName(sent)
    after, refused = delivery.settle(kept, results, NOW)
    wait = f"unix_seconds(next_attempt_at) - unix_seconds({NOW})"
    return after.select(
        F.expr(ledger.state_name("state")).alias("state"), F.coalesce("last_failure_code", F.lit("-")).alias("code"),
        F.when(F.expr(f"state = {ledger.RETRYING} AND last_failure_code IS NOT NULL"), F.expr(wait)).otherwise(-1).alias("wait"), F.col("acknowledgement").isNotNull().alias("acked"),
    ).groupBy("state", "code", "wait", "acked").agg(F.count("*").alias("n")).unionByName(
        refused.groupBy().agg(F.count("*").alias("n")).selectExpr("'refused' AS state", "'-' AS code", "-1L AS wait", "false AS acked", "n")
    )


OUTPUT_RESULTS_SQL = f"""
    WITH {L}, d AS (SELECT *, (state = 0 OR (state = 2 AND (next_attempt_at IS NULL OR next_attempt_at <= {NOW_SQL})) OR (state = 1 AND lease_until <= {NOW_SQL})) AS due FROM l)
    SELECT CASE WHEN due THEN CASE WHEN k % 5 < 2 THEN 'delivered' WHEN k % 5 < 4 THEN 'retrying' ELSE 'dead-lettered' END
        ELSE CASE state WHEN 0 THEN 'queued' WHEN 1 THEN 'uploading' WHEN 2 THEN 'retrying' WHEN 3 THEN 'delivered' ELSE 'dead-lettered' END END AS state,
      CASE WHEN due AND k % 5 >= 2 THEN 'http-' || (400 + k % 5) ELSE '-' END AS code,
      CAST(CASE WHEN due AND k % 5 = 2 THEN 3600 WHEN due AND k % 5 = 3 THEN least(300, 2 ** least(delivery_attempts + 1, 8)) ELSE -1 END AS BIGINT) AS wait,
      due AND k % 5 < 2 AS acked, count(*) AS n
    FROM d GROUP BY ALL UNION ALL SELECT 'refused', '-', -1, false, 0
"""

# ---- collection rules ----------------------------------------------------------------------------

RULE_DOCUMENT = """to_json(named_struct('id', concat('r', c_custkey), 'name', c_name,
  'dataSources', array(
    named_struct('name', 'Events', 'kind', IF(c_custkey % 2 = 0, 'windowsEventLogs', 'other'), 'streams', array('S1'), 'xPathQueries',
      array(IF(c_custkey % 3 = 0, 'Security!*', 'Application!*[System[(EventID=4624 or EventID=4625)]]')), 'enabled', c_custkey % 5 <> 0),
    named_struct('name', IF(c_custkey % 7 = 0, 'EVENTS', 'sysmon-src'), 'kind', 'x', 'streams', array(IF(c_custkey % 4 = 0, 'iis-W3C', 'S2')), 'xPathQueries',
      array(IF(c_custkey % 11 = 0, 'EventID=1 or EventID=3 or EventID=11', 'none')), 'enabled', true)),
  'destinations', IF(c_custkey % 13 = 0, array(), array(named_struct('name', 'd1')))))"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "customer").select("c_custkey", F.expr(RULE_DOCUMENT).alias("raw"))
    return rules.assess_rules(rules.parse_rules(documents), "100D")


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health, coverage and savings of one collection-rule document per customer."""
    return _assessed(spark, sf_dir).select(
        "c_custkey", F.col("health_score").cast("bigint").alias("health"), F.col("coverage_score").cast("bigint").alias("coverage"),
        F.expr("coalesce(cast(round(savings_gb) AS bigint), -1L)").alias("savings"),
    )


_RULES_CTE = """
    f AS (SELECT c_custkey AS c, c_custkey % 2 = 0 AS win, c_custkey % 3 = 0 AS broad, c_custkey % 7 = 0 AS dup, c_custkey % 7 <> 0 AS sysmon_name, c_custkey % 4 = 0 AS iis,
      c_custkey % 11 = 0 AS ids, c_custkey % 5 = 0 AS off, c_custkey % 13 = 0 AS nodest FROM customer),
    g AS (SELECT *, sysmon_name AND NOT ids AS incomplete FROM f)
"""
RULE_SCORES_SQL = f"""
    WITH {_RULES_CTE}
    SELECT c AS c_custkey, CAST(greatest(0, 100 - (30 * nodest::INT + 15 * (broad::INT + (NOT sysmon_name)::INT) + 8 * (dup::INT + win::INT + incomplete::INT + 1 + off::INT) + 3 * (NOT iis)::INT)) AS BIGINT) AS health,
      CAST(30 * win::INT + 30 * sysmon_name::INT + 10 * iis::INT + 10 * (NOT nodest)::INT AS BIGINT) AS coverage,
      CAST(CASE WHEN dup OR broad THEN 5 * dup::INT + 25 * broad::INT ELSE -1 END AS BIGINT) AS savings FROM g
"""


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations by code and severity."""
    found = rules.rule_recommendations(_assessed(spark, sf_dir))
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"), F.min("detail").alias("detail"))


RULE_FINDINGS_SQL = f"""
    WITH {_RULES_CTE}, r AS (
      SELECT unnest(['duplicate-source', 'broad-security-events', 'missing-security-event-ids', 'missing-sysmon', 'incomplete-sysmon', 'missing-defender', 'missing-iis', 'disabled-sources', 'missing-destination']) AS code,
        unnest(['medium', 'high', 'medium', 'high', 'medium', 'medium', 'low', 'medium', 'critical']) AS severity,
        unnest([dup, broad, win, NOT sysmon_name, incomplete, true, NOT iis, off, nodest]) AS hit,
        unnest(['Data source name ''Events'' appears 2 times.', 'Broad Security channel collection inflates ingestion. Prefer targeted Event IDs.',
          CASE WHEN broad THEN 'Consider collecting Event IDs: 4624, 4625, 4648, 4672, 4688, 4720, 4728, 4732, 1102.' ELSE 'Consider collecting Event IDs: 4648, 4672, 4688, 4720, 4728, 4732, 1102.' END,
          'Collect Sysmon Event IDs 1, 3 and 11 for process, network and file visibility.', 'Ensure Sysmon Event IDs 1, 3, 11 are collected.',
          'Enable Defender / XDR connector or collect Defender operational channels.', 'If web workloads exist, collect IIS W3C logs with path filters.',
          'Review disabled sources for accidental coverage gaps or stale configuration.', 'DCR has no Log Analytics / destination association.']) AS detail FROM g)
    SELECT code, severity, count(*) AS n, min(detail) AS detail FROM r WHERE hit GROUP BY ALL
"""


def rule_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data source names that repeat inside a document."""
    documents = table(spark, sf_dir, "customer").select(F.expr(RULE_DOCUMENT).alias("raw"))
    return rules.rule_duplicates(rules.parse_rules(documents)).select("id", "name_key", "copies")


RULE_DUPLICATES_SQL = "SELECT 'r' || c_custkey AS id, 'events' AS name_key, CAST(2 AS BIGINT) AS copies FROM customer WHERE c_custkey % 7 = 0"

# ---- fleet ---------------------------------------------------------------------------------------

FLEET_NOW = "timestamp'2024-01-01 00:10:00Z'"
FLEET_EVENTS = """inline(array(
  named_struct('seq', 1L, 'kind', 'register', 'at', timestamp'2024-01-01 00:00:00Z', 'principal', concat('p', c_custkey), 'version', '1', 'queue_depth', 0L, 'delivery_status', cast(NULL AS string), 'action', cast(NULL AS string), 'target_status', cast(NULL AS string), 'reason', cast(NULL AS string)),
  named_struct('seq', 2L, 'kind', 'heartbeat', 'at', timestamp'2024-01-01 00:01:00Z', 'principal', concat('p', c_custkey), 'version', '2', 'queue_depth', 7L, 'delivery_status', 'healthy', 'action', cast(NULL AS string), 'target_status', cast(NULL AS string), 'reason', cast(NULL AS string)),
  named_struct('seq', 3L, 'kind', 'decide', 'at', timestamp'2024-01-01 00:02:00Z', 'principal', 'admin', 'version', cast(NULL AS string), 'queue_depth', cast(NULL AS bigint), 'delivery_status', cast(NULL AS string),
    'action', IF(c_custkey % 4 = 0, 'rejected', 'approved'), 'target_status', IF(c_custkey % 4 = 0, 'Revoked', 'Approved'), 'reason', IF(c_custkey % 5 = 0, ' ', 'fine')),
  named_struct('seq', 4L, 'kind', 'heartbeat', 'at', timestamp'2024-01-01 00:03:00Z' - IF(c_custkey % 6 = 0, INTERVAL 1 HOUR, INTERVAL 0 HOUR), 'principal', IF(c_custkey % 7 = 0, 'thief', concat('p', c_custkey)), 'version', '3', 'queue_depth', cast(c_custkey % 10 AS bigint),
    'delivery_status', IF(c_custkey % 3 = 0, 'Degraded', 'HEALTHY'), 'action', cast(NULL AS string), 'target_status', cast(NULL AS string), 'reason', cast(NULL AS string)),
  named_struct('seq', 5L, 'kind', 'register', 'at', timestamp'2024-01-01 00:04:00Z', 'principal', IF(c_custkey % 2 = 0, 'thief', concat('p', c_custkey)), 'version', '4', 'queue_depth', 0L, 'delivery_status', cast(NULL AS string), 'action', cast(NULL AS string), 'target_status', cast(NULL AS string), 'reason', cast(NULL AS string))))"""


def fleet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five life-cycle events for a collector per customer."""
    raw = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS collector_id", FLEET_EVENTS)
    return raw.withColumns(
        {"machine_name": F.lit("m"), "environment": F.lit("test"), "configuration_hash": F.lit("ch"), "policy_hash": F.lit("ph")}
    )


FLEET_CTE = """
    b AS (SELECT c_custkey AS c, c_custkey % 5 = 0 AS no_reason FROM customer),
    s AS (SELECT *, CASE WHEN no_reason THEN 'Pending' WHEN c % 4 = 0 THEN 'Revoked' ELSE 'Approved' END AS decided FROM b),
    t AS (SELECT *, decided = 'Approved' AND c % 7 <> 0 AS beat FROM s),
    w AS (SELECT *, CASE WHEN beat THEN 'Active' ELSE decided END AS status, c % 2 <> 0 AS again FROM t),
    fl AS (SELECT 'c' || c AS collector_id, c, status, CASE WHEN beat THEN CASE WHEN c % 3 = 0 THEN 'Degraded' ELSE 'HEALTHY' END ELSE 'unknown' END AS delivery_status,
      CASE WHEN beat THEN c % 10 ELSE 0 END AS queue_depth, CASE WHEN again THEN '4' WHEN beat THEN '3' ELSE '1' END AS version,
      CASE WHEN again THEN TIMESTAMP '2024-01-01 00:04:00' WHEN beat THEN TIMESTAMP '2024-01-01 00:03:00' - CASE WHEN c % 6 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_seen_at,
      beat, decided, no_reason, again FROM w)
"""


def _fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.fleet_fold(fleet_events(spark, sf_dir))


def fleet_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state of every collector."""
    return fleet.fleet_state(_fleet(spark, sf_dir)).select(
        "collector_id", "status", "version", "queue_depth", "delivery_status", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm").alias("seen")
    )


FLEET_STATE_SQL = f"WITH {FLEET_CTE} SELECT collector_id, status, version, CAST(queue_depth AS BIGINT) AS queue_depth, delivery_status, strftime(last_seen_at, '%Y-%m-%d %H:%M') AS seen FROM fl"


def fleet_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes per event kind, and the audit rows."""
    folded = _fleet(spark, sf_dir)
    outcomes = fleet.fleet_outcomes(folded).groupBy(F.concat_ws(" ", F.col("seq").cast("string"), "kind", "outcome").alias("what")).agg(F.count("*").alias("n"))
    audit = fleet.fleet_audit(folded).groupBy(F.col("event").alias("what")).agg(F.count("*").alias("n"))
    return outcomes.unionByName(audit)


FLEET_OUTCOMES_SQL = f"""
    WITH {FLEET_CTE}, x AS (
      SELECT '1 register ok' AS what FROM fl UNION ALL SELECT '2 heartbeat state-conflict' FROM fl
      UNION ALL SELECT CASE WHEN no_reason THEN '3 decide reason-required' ELSE '3 decide ok' END FROM fl
      UNION ALL SELECT CASE WHEN c % 7 = 0 THEN '4 heartbeat unknown-collector' WHEN decided = 'Approved' THEN '4 heartbeat ok' ELSE '4 heartbeat state-conflict' END FROM fl
      UNION ALL SELECT CASE WHEN again THEN '5 register ok' ELSE '5 register identity-conflict' END FROM fl
      UNION ALL SELECT 'collector.registered' FROM fl UNION ALL SELECT 'collector.registered' FROM fl WHERE again
      UNION ALL SELECT CASE WHEN c % 4 = 0 THEN 'collector.rejected' ELSE 'collector.approved' END FROM fl WHERE NOT no_reason)
    SELECT what, count(*) AS n FROM x GROUP BY 1
"""


def _source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey) AS collector_id", "cast(o_orderkey AS string) AS source_id", "IF(o_orderstatus = 'F', 'Healthy', 'late') AS status")


def fleet_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet counters."""
    return fleet.fleet_overview(fleet.fleet_state(_fleet(spark, sf_dir)), _source_rows(spark, sf_dir), FLEET_NOW)


FLEET_OVERVIEW_SQL = f"""
    WITH {FLEET_CTE} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'Pending') AS pending, count(*) FILTER (WHERE status IN ('Suspended', 'Revoked') OR lower(delivery_status) <> 'healthy') AS unhealthy,
      count(*) FILTER (WHERE last_seen_at < TIMESTAMP '2024-01-01 00:10:00' - INTERVAL 15 MINUTES) AS stale, CAST(sum(queue_depth) AS BIGINT) AS queue_depth,
      (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS healthy_sources, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS degraded_sources FROM fl
"""


def fleet_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions (top 12), active collectors, latest approvals (top 250) and audit rows (top 500)."""
    states = fleet.fleet_state(_fleet(spark, sf_dir))
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderdate AS occurred_at", "lpad(cast(o_orderkey AS string), 12, '0') AS id")
    parts = [
        fleet.fleet_exceptions(states, FLEET_NOW).selectExpr("'exception' AS list", "collector_id AS item"),
        fleet.list_collectors(states, "Active").selectExpr("'active' AS list", "collector_id AS item"),
        fleet.latest_approvals(orders).selectExpr("'approval' AS list", "id AS item"),
        fleet.latest_audit(orders).selectExpr("'audit' AS list", "id AS item"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


FLEET_LISTS_SQL = f"""
    WITH {FLEET_CTE}, o AS (SELECT o_orderdate, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id FROM orders)
    SELECT 'exception' AS list, collector_id AS item FROM (SELECT * FROM fl WHERE status IN ('Pending', 'Suspended', 'Revoked') OR last_seen_at < TIMESTAMP '2023-12-31 23:55:00' OR lower(delivery_status) <> 'healthy' ORDER BY last_seen_at DESC, collector_id LIMIT 12)
    UNION ALL SELECT 'active', collector_id FROM fl WHERE status = 'Active'
    UNION ALL SELECT 'approval', id FROM (SELECT * FROM o ORDER BY o_orderdate DESC, id LIMIT 250)
    UNION ALL SELECT 'audit', id FROM (SELECT * FROM o ORDER BY o_orderdate DESC, id LIMIT 500)
"""


def collector_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collectors with their source and output rows nested."""
    states = fleet.fleet_state(_fleet(spark, sf_dir))
    outputs = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").selectExpr("concat('c', c_custkey) AS collector_id", "c_mktsegment AS output_id", "'ok' AS status")
    details = fleet.collector_details(states, _source_rows(spark, sf_dir), outputs)
    return details.select(
        "collector_id", F.size("sources").cast("bigint").alias("sources"), F.array_join(F.expr("transform(sources, s -> s.source_id)"), ",").alias("ids"),
        F.array_join(F.expr("transform(outputs, o -> o.output_id)"), ",").alias("outputs"),
    )


DETAILS_SQL = """
    WITH s AS (SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS ids FROM orders GROUP BY 1)
    SELECT 'c' || c_custkey AS collector_id, coalesce(n, 0) AS sources, coalesce(ids, '') AS ids, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS outputs FROM customer LEFT JOIN s ON o_custkey = c_custkey
"""


def current_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows of the last accepted report of every collector."""
    report = "array(named_struct('source_id', concat('s', seq), 'type', 'file', 'status', 'ok', 'lag_seconds', seq, 'last_event_at', at))"
    events = fleet_events(spark, sf_dir).withColumn("sources", F.expr(report))
    return fleet.current_reports(fleet.fleet_state(fleet.fleet_fold(events)), events, "sources").select("collector_id", "source_id", "lag_seconds")


REPORTS_SQL = f"WITH {FLEET_CTE}, q AS (SELECT collector_id, CASE WHEN again THEN 5 WHEN beat THEN 4 ELSE 1 END AS seq FROM fl) SELECT collector_id, 's' || seq AS source_id, CAST(seq AS BIGINT) AS lag_seconds FROM q"


def total_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total payload bytes, for the capacity check."""
    return ledger.ledger_bytes(ledger_of(spark, sf_dir))


BYTES_SQL = f"WITH {L} SELECT CAST(sum(payload_bytes) AS BIGINT) AS total_bytes FROM l"


def build() -> dict:
    """Query name to (callable, oracle SQL or None)."""
    return {
        "current_reports": (current_reports, REPORTS_SQL),
        "ledger_bytes": (total_bytes, BYTES_SQL),
        "ledger_snapshot": (snapshot, SNAPSHOT_SQL),
        "due_for_delivery": (due, DUE_SQL),
        "ledger_apply": (applied, APPLIED_SQL),
        "latest_state": (latest, LATEST_SQL),
        "route_failures": (routed, ROUTED_SQL),
        "acknowledged_and_matched": (acked, ACKED_SQL),
        "dedupe_first": (deduped, DEDUPED_SQL),
        "new_fingerprints": (new_rows, NEW_ROWS_SQL),
        "admit_by_capacity": (admitted, ADMITTED_SQL),
        "pack_files": (packed, PACKED_SQL),
        "spool_round_trip": (spool_round_trip, SPOOL_ROUND_TRIP_SQL),
        "output_results": (output_results, OUTPUT_RESULTS_SQL),
        "split_oversize": (oversize, OVERSIZE_SQL),
        "rule_scores": (rule_scores, RULE_SCORES_SQL),
        "rule_recommendations": (rule_findings, RULE_FINDINGS_SQL),
        "rule_duplicates": (rule_duplicates, RULE_DUPLICATES_SQL),
        "fleet_state": (fleet_state, FLEET_STATE_SQL),
        "fleet_outcomes": (fleet_outcomes, FLEET_OUTCOMES_SQL),
        "fleet_overview": (fleet_overview, FLEET_OVERVIEW_SQL),
        "fleet_lists": (fleet_lists, FLEET_LISTS_SQL),
        "collector_details": (collector_details, DETAILS_SQL),
    }
