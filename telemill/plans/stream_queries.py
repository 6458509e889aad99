"""Registered streaming queries: whole tables through Structured Streaming, read back as tables.

Each writes its input to a fresh place in the shared folder, runs a stream over it until all is read,
and returns what the stream wrote.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemill.operators import detect, envelope
from telemill.plans import event_queries, state_queries
from telemill.plans.inputs import NOW, candidates, spread, table
from telemill.session import configure, shared_dir
from telemill.sources import polling
from telemill.streaming import ingest as streaming
from telemill.streaming.lifecycle import fleet_stream, ledger_stream, stale_stream, state_store


def _place(spark: SparkSession, name: str) -> str:
    configure(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _as_stream(df: DataFrame, place: str, files_per_trigger: int = 4) -> DataFrame:
    """The rows as a file stream with several micro-batches: as many as eight files would give, dealt over all cores."""
    spark = df.sparkSession
    # A file is one task to the stream, whose expressions are wide: more cores than files would wait.
    times = -(-spark.sparkContext.defaultParallelism // files_per_trigger)
    df.repartition(8 * times).write.parquet(f"{place}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger * times).parquet(f"{place}/in")


def _run(result: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """Runs the stream to its end and reads its output."""
    with state_store(result.sparkSession):
        query = (
            result.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/out")
            .option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{place}/out")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest pipeline as a stream into the lake; same outcomes as in batch."""
    place = _place(spark, "ingest")
    arriving = _as_stream(candidates(spark, sf_dir), place)
    done = streaming.process_stream(arriving, event_queries.COLLECTOR, NOW, event_queries.POLICIES)
    streaming.start_lake(done, f"{place}/lake", f"{place}/state", available_now=True).awaitTermination()
    lake = spark.read.option("basePath", f"{place}/lake").parquet(f"{place}/lake")
    return lake.groupBy("stream", "action").agg(F.count("*").alias("n"), F.count("alert").alias("alerts"), F.countDistinct("fingerprint").alias("fingerprints"))


STREAM_INGEST_SQL = f"""
    {event_queries.JUDGED_CTE},
    a AS (SELECT *, CASE WHEN NOT decodes OR invalid IS NOT NULL THEN 'quarantine' WHEN accepted THEN CASE WHEN n_removed + n_masked > 0 THEN 'redactAndAccept' ELSE 'accept' END ELSE verdict END AS action FROM d)
    SELECT CASE WHEN action IN ('accept', 'redactAndAccept') THEN 'accepted' WHEN action = 'reject' THEN 'rejected' ELSE 'quarantined' END AS stream, action, count(*) AS n,
      count(*) FILTER (WHERE decodes AND worthy) AS alerts, count(DISTINCT CASE WHEN accepted THEN {event_queries.FINGERPRINT_SQL} END) AS fingerprints FROM a GROUP BY ALL
"""


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate sent twice; the stream keeps one event per fingerprint."""
    place = _place(spark, "dedupe")
    once = candidates(spark, sf_dir)
    arriving = _as_stream(once.unionByName(once), place, files_per_trigger=8)
    done = streaming.process_stream(arriving, event_queries.COLLECTOR, NOW, event_queries.POLICIES)
    kept = _run(streaming.dedupe_stream(done, "60 days").select("event_type", "fingerprint"), place)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("fingerprint").alias("fingerprints"))


STREAM_DEDUPE_SQL = f"""
    {event_queries.JUDGED_CTE}, p AS (SELECT event_type, {event_queries.FINGERPRINT_SQL} AS fp FROM d WHERE accepted)
    SELECT event_type, count(DISTINCT fp) AS n, count(DISTINCT fp) AS fingerprints FROM p GROUP BY 1
"""


def stream_exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order sent twice, over several batches; one ledger row per fingerprint stays."""
    place = _place(spark, "exact")
    rows = state_queries.ledger_of(spark, sf_dir).select("event_id", "fingerprint", "received_at")
    arriving = _as_stream(rows.unionByName(rows), place)
    streaming.start_exact(arriving, f"{place}/ledger", f"{place}/state", available_now=True).awaitTermination()
    kept = spark.read.schema(rows.schema).option("basePath", f"{place}/ledger/rows").parquet(f"{place}/ledger/rows")
    return kept.groupBy(F.element_at(F.split("fingerprint", "-"), 2).alias("status")).agg(
        F.count("*").alias("n"), F.count_distinct("fingerprint").alias("fingerprints")
    )


STREAM_EXACT_SQL = f"""
    WITH {state_queries.L} SELECT split_part(fingerprint, '-', 2) AS status, count(DISTINCT fingerprint) AS n, count(DISTINCT fingerprint) AS fingerprints FROM l GROUP BY 1
"""


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted events sent twice through the rules; one alert per rule and event."""
    place = _place(spark, "alerts")
    once = candidates(spark, sf_dir)
    arriving = _as_stream(once.unionByName(once), place, files_per_trigger=8)
    done = streaming.process_stream(arriving, event_queries.COLLECTOR, NOW, event_queries.POLICIES)
    alerts = streaming.alert_stream(done, event_queries.RULES, "1 hour", NOW)
    kept = _run(alerts.select("rule_id", "event_id"), place)
    return kept.filter("rule_id <> 'off'").groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


STREAM_ALERTS_SQL = event_queries.DETECTIONS_SQL.rsplit("SELECT 'event-'", 1)[0] + """
    SELECT rule_id, count(*) AS n, count(*) AS events FROM a WHERE accepted GROUP BY 1
"""


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enqueue, lease and result moves of every order through keyed state."""
    place = _place(spark, "ledger")
    nothing = "'lease_until', cast(NULL AS timestamp), 'next_attempt_at', cast(NULL AS timestamp), 'failure_code', cast(NULL AS string), 'acknowledgement', cast(NULL AS string)"
    enqueue = f"inline(array(named_struct('seq', 0L, 'action', 'enqueue', 'at', received_at, {nothing})))"
    rows = state_queries.ledger_of(spark, sf_dir)
    moves = rows.selectExpr("event_id", enqueue).unionByName(state_queries.transitions(spark, sf_dir)).repartition(8, "event_id")
    # All moves of a row arrive in one file, in any order.
    moves.write.parquet(f"{place}/in")
    arriving = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 4).parquet(f"{place}/in")
    done = _run(ledger_stream(arriving, "20000 days"), place)
    return done.groupBy("action", "accepted", F.col("state").cast("bigint").alias("state"), F.coalesce("failure_code", F.lit("-")).alias("code")).agg(F.count("*").alias("n"))


STREAM_LEDGER_SQL = f"""
    WITH {state_queries.L}, m AS (SELECT 'enqueue' AS action, 0 AS state, '-' AS code FROM l UNION ALL SELECT 'lease', 1, '-' FROM l
      UNION ALL SELECT CASE c % 3 WHEN 0 THEN 'delivered' WHEN 1 THEN 'retrying' ELSE 'dead-lettered' END, CASE c % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 4 END, CASE c % 3 WHEN 0 THEN '-' ELSE 'http-500' END FROM l)
    SELECT action, true AS accepted, CAST(state AS BIGINT) AS state, code, count(*) AS n FROM m GROUP BY ALL
"""


def stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five moves of every order in files by their number, last ones first; some leases are lost.

    The stream stops when it has read the files, and goes on from its state when one more arrives, whose time lets
    the watermark pass the rest.
    """
    place = _place(spark, "disorder")
    moves = spread(state_queries.ledger_of(spark, sf_dir).select("event_id", "o_orderkey")).selectExpr("event_id", "o_orderkey", DISORDER).where("NOT (seq = 1 AND o_orderkey % 10 = 0)").drop("o_orderkey")
    for seq in (4, 2, 3, 0, 1):
        moves.where(F.col("seq") == seq).repartition(2).write.mode("append").parquet(f"{place}/in")

    def run() -> DataFrame:
        arriving = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 4).parquet(f"{place}/in")
        return _run(ledger_stream(arriving, "1 hour"), place)

    run()
    end = spark.range(1).selectExpr("'end' AS event_id", "0L AS seq", "'enqueue' AS action", "timestamp'1999-01-01 00:00:00Z' AS at")
    moves.where("false").unionByName(end, allowMissingColumns=True).write.mode("append").parquet(f"{place}/in")
    done = run().where("event_id <> 'end'")
    return done.groupBy(
        F.coalesce("seq", F.lit(-1)).alias("seq"), "action", "accepted", F.col("state").cast("bigint").alias("state"),
        F.col("attempts").cast("bigint").alias("attempts"), F.coalesce("failure_code", F.lit("-")).alias("code"),
    ).agg(F.count("*").alias("n"))


_MOVE = "named_struct('seq', {}L, 'action', {}, 'at', timestamp'1998-01-01 00:0{}:00Z', 'lease_until', {}, 'next_attempt_at', timestamp'1998-01-01 00:02:30Z', 'failure_code', 'http-500', 'acknowledgement', 'ack')"
_LEASED = "timestamp'1998-01-01 00:02:00Z'"
DISORDER = "inline(array(" + ", ".join([
    _MOVE.format(0, "'enqueue'", 0, "cast(NULL AS timestamp)"),
    _MOVE.format(1, "'lease'", 1, _LEASED),
    _MOVE.format(2, "'retrying'", 2, "cast(NULL AS timestamp)"),
    _MOVE.format(3, "'lease'", 3, "timestamp'1998-01-01 00:05:00Z'"),
    _MOVE.format(4, "CASE o_orderkey % 3 WHEN 0 THEN 'delivered' WHEN 1 THEN 'dead-lettered' ELSE 'unknown' END", 4, "cast(NULL AS timestamp)"),
]) + "))"
# Without its first lease a row is still queued: the retry is refused, the second lease is its first attempt.
STREAM_OUT_OF_ORDER_SQL = f"""
    WITH {state_queries.L}, x AS (SELECT k, k % 10 = 0 AS lost FROM l),
    m AS (
      SELECT 0 AS seq, 'enqueue' AS action, true AS accepted, 0 AS state, 0 AS attempts, '-' AS code FROM x
      UNION ALL SELECT 1, 'lease', true, 1, 1, '-' FROM x WHERE NOT lost
      UNION ALL SELECT 2, 'retrying', NOT lost, CASE WHEN lost THEN 0 ELSE 2 END, CASE WHEN lost THEN 0 ELSE 1 END, CASE WHEN lost THEN '-' ELSE 'http-500' END FROM x
      UNION ALL SELECT 3, 'lease', true, 1, CASE WHEN lost THEN 1 ELSE 2 END, CASE WHEN lost THEN '-' ELSE 'http-500' END FROM x
      UNION ALL SELECT 4, CASE k % 3 WHEN 0 THEN 'delivered' WHEN 1 THEN 'dead-lettered' ELSE 'unknown' END, k % 3 < 2, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 1 END,
        CASE WHEN lost THEN 1 ELSE 2 END, CASE WHEN k % 3 = 0 THEN '-' WHEN k % 3 = 1 OR NOT lost THEN 'http-500' ELSE '-' END FROM x
      -- The last lease of the others runs out.
      UNION ALL SELECT -1, 'lease-expired', true, 1, CASE WHEN lost THEN 1 ELSE 2 END, CASE WHEN lost THEN '-' ELSE 'http-500' END FROM x WHERE k % 3 = 2
    )
    SELECT CAST(seq AS BIGINT) AS seq, action, accepted, CAST(state AS BIGINT) AS state, CAST(attempts AS BIGINT) AS attempts, code, count(*) AS n FROM m GROUP BY ALL
"""


def stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the events as collectors: who is told stale at the end, by the time of the events."""
    place = _place(spark, "stale")
    contacts = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), "user_id").alias("collector_id"), F.col("ts").alias("at"))
    # In the order of time, as contacts arrive.
    slices = contacts.repartitionByRange(8, "at").sortWithinPartitions("at")
    slices.write.parquet(f"{place}/in")
    arriving = spark.readStream.schema(contacts.schema).option("maxFilesPerTrigger", 8).parquet(f"{place}/in")
    done = _run(stale_stream(arriving, "3 HOURS", "10 minutes"), place)
    return done.where("status = 'stale'").select("collector_id", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_seen"))


STREAM_STALE_SQL = """
    WITH c AS (SELECT 'c' || user_id AS collector_id, max(ts) AS seen FROM events GROUP BY 1)
    SELECT collector_id, strftime(seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM c
    WHERE epoch_ms(seen) + 3 * 3600000 <= (SELECT epoch_ms(max(ts) - INTERVAL 10 MINUTES) FROM events)
"""


#: Looks at an idle stream, or at batches without a new row, after which it is given up.
IDLE_LOOKS = 120


def _wait_for(query: StreamingQuery, expected: int, written: Callable[[], int], pause: float = 1.0) -> None:
    """Waits until the stream has written the rows, however long that takes, and stops it.

    Fails if the stream ends before, or brings no more rows though no batch is running.
    """
    told, since, last = -1, 0, None
    try:
        while True:
            time.sleep(pause)
            active, progress = query.isActive, query.lastProgress
            # Only a batch that was committed after the last look can have brought rows; one that runs may take long.
            if progress is not None and progress.batchId != last:
                last, rows = progress.batchId, written()
                if rows >= expected and not progress.numInputRows:
                    return
                told, since = (rows, 0) if rows > told else (told, since + 1)
            elif active and not query.status["isTriggerActive"]:
                since += 1
            if since > IDLE_LOOKS or not active:
                raise RuntimeError(f"the stream has told {max(told, 0)} of {expected} rows and brings no more") from query.exception()
    finally:
        query.stop()


def stream_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collectors of all fleet events, told stale by the machine's clock after the input has ended."""
    place = _place(spark, "silence")
    contacts = state_queries.fleet_events(spark, sf_dir).where("kind = 'heartbeat'").select("collector_id", "at")
    contacts.write.parquet(f"{place}/in")
    arriving = spark.readStream.schema(contacts.schema).parquet(f"{place}/in")
    result = stale_stream(arriving, "1 SECOND", clock="processing")
    schema, expected = result.schema, contacts.select("collector_id").distinct().count()
    with state_store(spark):
        query = (
            result.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out")
            .option("checkpointLocation", f"{place}/state").trigger(processingTime="500 milliseconds").start()
        )
    # No input comes after the first batch; timers alone bring the rows.
    _wait_for(query, expected, lambda: spark.read.schema(schema).parquet(f"{place}/out").count())
    done = spark.read.schema(schema).parquet(f"{place}/out")
    return done.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("collector_id").alias("collectors"), F.date_format(F.max("last_seen_at"), "yyyy-MM-dd HH:mm").alias("newest"))


STREAM_SILENCE_SQL = "SELECT 'stale' AS status, count(*) AS n, count(*) AS collectors, '2024-01-01 00:03' AS newest FROM customer"


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts per rule and hour from a stream of alerts; a last alert of a far day closes all windows."""
    place = _place(spark, "bursts")
    decoded = candidates(spark, sf_dir).transform(lambda df: envelope.decode_envelope(df, "raw")).filter("event IS NOT NULL")
    alerts = detect.detect(decoded, event_queries.RULES, "event.timeGenerated").select("rule_id", "detected_at")

    def run() -> DataFrame:
        arriving = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 8).parquet(f"{place}/in")
        return _run(streaming.burst_counts(arriving, "1 hour", "10 years"), place)

    alerts.repartition(8).write.parquet(f"{place}/in")
    run()
    spark.range(1).selectExpr("'off' AS rule_id", "timestamp'2100-01-01 00:00:00Z' AS detected_at").write.mode("append").parquet(f"{place}/in")
    return run().filter("rule_id <> 'off'").select(F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"), "rule_id", "alerts")


CUT = "timestamp'1996-01-01 00:00:00Z'"


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a table that is polled while it grows: some rows come late, within the overlap or beyond it.

    The first poll sees the orders up to a day but for one in ten; the second the rest. Rows that are read twice
    are dropped by their fingerprint.
    """
    place = _place(spark, "replay")
    orders = table(spark, sf_dir, "orders").selectExpr(
        "concat('o', o_orderkey) AS event_id", "concat('f', o_orderkey) AS fingerprint", "o_orderdate AS received_at", "o_orderkey AS sequence"
    )
    late = F.col("sequence") % 10 == 0
    early = (F.col("received_at") <= F.expr(CUT)) & ~late
    for rows in (orders.where(early), orders.where(~early)):
        rows.repartition(4).write.mode("append").parquet(f"{place}/table")
        polled = polling.poll_table(spark, f"{place}/table", orders.schema, "received_at", "sequence", timedelta(days=200))
        streaming.start_exact(polled, f"{place}/ledger", f"{place}/state", available_now=True).awaitTermination()
    kept = spark.read.schema(orders.schema).option("basePath", f"{place}/ledger/rows").parquet(f"{place}/ledger/rows")
    return kept.groupBy(F.year("received_at").cast("bigint").alias("year"), (F.col("sequence") % 10 == 0).alias("late")).agg(
        F.count("*").alias("n"), F.count_distinct("fingerprint").alias("fingerprints")
    )


# The cursor stands at the last order of the first poll.
STREAM_REPLAY_SQL = """
    WITH c AS (SELECT max(o_orderdate) AS top FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND o_orderkey % 10 <> 0)
    SELECT year(o_orderdate) AS year, o_orderkey % 10 = 0 AS late, count(*) AS n, count(*) AS fingerprints FROM orders, c
    WHERE o_orderkey % 10 <> 0 OR o_orderdate >= top - INTERVAL 200 DAYS GROUP BY ALL
"""


def stream_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet events of every customer through keyed state: outcome per event."""
    place = _place(spark, "fleet")
    events = state_queries.fleet_events(spark, sf_dir).repartition(8, "collector_id")
    events.write.parquet(f"{place}/in")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{place}/in")
    done = _run(fleet_stream(arriving, "2 hours"), place)
    outcomes = done.groupBy(F.concat_ws(" ", F.col("seq").cast("string"), "kind", "outcome").alias("what")).agg(F.count("*").alias("n"))
    states = done.filter("seq = 5").groupBy(F.concat_ws(" ", F.lit("final"), "status", "version").alias("what")).agg(F.count("*").alias("n"))
    return outcomes.unionByName(states)


STREAM_FLEET_SQL = (
    state_queries.FLEET_OUTCOMES_SQL.replace("UNION ALL SELECT 'collector.registered' FROM fl UNION ALL SELECT 'collector.registered' FROM fl WHERE again", "")
    .replace("UNION ALL SELECT CASE WHEN c % 4 = 0 THEN 'collector.rejected' ELSE 'collector.approved' END FROM fl WHERE NOT no_reason", "UNION ALL SELECT 'final ' || status || ' ' || version FROM fl")
)


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL names over numbers and names made from every customer."""
    from telemill.functions.sql import register_sql
    from telemill.plans.inputs import table

    register_sql(spark)
    table(spark, sf_dir, "customer").createOrReplaceTempView("telemill_customer")
    return spark.sql(
        """SELECT c_custkey, valid_tfn(lpad(CAST(c_custkey * 7919 + 100000001 AS STRING), 9, '0')) AS tfn, mask_middle(c_name) AS masked,
        sha256_token(c_name) AS token, count_digits(c_name) AS digits, quality_grade(CAST(c_custkey % 101 AS INT)) AS grade FROM telemill_customer"""
    ).withColumn("digits", F.col("digits").cast("bigint"))


_D = "lpad(CAST(c_custkey * 7919 + 100000001 AS VARCHAR), 9, '0')"
SQL_FUNCTIONS_SQL = f"""
    SELECT c_custkey, ({" + ".join(f"CAST(substr({_D}, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate((1, 4, 3, 7, 5, 8, 6, 9, 10), 1))}) % 11 = 0 AS tfn,
      substr(c_name, 1, 2) || repeat('*', CAST(length(c_name) - 4 AS INTEGER)) || right(c_name, 2) AS masked, 'sha256:' || sha256(c_name) AS token,
      length(regexp_replace(c_name, '[^0-9]', '', 'g')) AS digits,
      CASE WHEN c_custkey % 101 >= 90 THEN 'A' WHEN c_custkey % 101 >= 80 THEN 'B' WHEN c_custkey % 101 >= 70 THEN 'C' WHEN c_custkey % 101 >= 60 THEN 'D' ELSE 'F' END AS grade FROM customer
"""


def build() -> dict:
    """Query name to (callable, oracle SQL or None)."""
    return {
        "stream_ingest": (stream_ingest, STREAM_INGEST_SQL),
        "stream_dedupe": (stream_dedupe, STREAM_DEDUPE_SQL),
        "stream_exact_dedupe": (stream_exact_dedupe, STREAM_EXACT_SQL),
        "stream_alerts": (stream_alerts, STREAM_ALERTS_SQL),
        "stream_ledger": (stream_ledger, STREAM_LEDGER_SQL),
        "stream_out_of_order": (stream_out_of_order, STREAM_OUT_OF_ORDER_SQL),
        "stream_bursts": (stream_bursts, event_queries.BURSTS_SQL),
        "stream_replay": (stream_replay, STREAM_REPLAY_SQL),
        "stream_fleet": (stream_fleet, STREAM_FLEET_SQL),
        "stream_stale": (stream_stale, STREAM_STALE_SQL),
        "stream_silence": (stream_silence, STREAM_SILENCE_SQL),
        "sql_functions": (sql_functions, SQL_FUNCTIONS_SQL),
    }
