"""Logs, ledger, spool, quality, rules, fleet and streams."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from telemill.operators import dedupe, delivery, fleet, ledger, logs, quality, rules
from telemill.operators.ordinals import index_within

from telemill.sinks import spool

NOW = "timestamp'2026-07-26 02:14:19Z'"


def lines(spark, text, file="f"):
    return spark.createDataFrame([(file, i, t) for i, t in enumerate(text)], "file string, line_no int, line string")


@pytest.mark.parametrize(
    "text, fmt, detail",
    [
        (['{"timestamp":"2024-01-01T00:00:00Z","token":"x"}', '{"timestamp":"2024-01-01T00:00:00Z"}'], "json", None),
        (["timestamp,severity,username", '2024-01-01T00:00:00Z,high,"a, b"'], "csv", ","),
        (['timestamp=2024-01-01T00:00:00Z user="a b" action=x'], "keyvalue", None),
        (['203.0.113.1 - bob [01/Jan/2024:00:00:00 +0000] "GET /x HTTP/1.1" 200 12'], "regex", "http-access"),
        (["nothing to see"], None, None),
    ],
)
def test_format_inference(spark, text, fmt, detail):
    row = logs.infer_log_format(lines(spark, text)).first()
    assert row["format"] == fmt
    assert detail in (None, row["delimiter"], row["pattern_name"])


def test_unsupported_patterns_are_refused():
    with pytest.raises(ValueError):
        logs.LogConfig("regex", pattern="(?=x)y", groups=("a",))
    with pytest.raises(ValueError):
        logs.LogConfig("regex", pattern="x" * 3000, groups=("a",))


def test_delimited_cells(spark):
    rows = ['a,b', '"a,b",c', '"say ""hi""",x', '"open,x', ' a , b ']
    df = spark.createDataFrame([(r,) for r in rows], "line string")
    got = [r[0] for r in df.select(F.expr(logs.split_delimited("line", ","))).collect()]
    assert got == [["a", "b"], ["a,b", "c"], ['say "hi"', "x"], [], ["a", "b"]]


def test_json_flatten_skips_secrets_and_arrays(spark):
    raw = '{"a":{"b":{"c":1.0,"token":"x"}},"list":[1],"none":null,"bad name":1,"password":{"x":1}}'
    got = spark.range(1).select(F.expr(logs.flatten_json(f"try_parse_json('{raw}')"))).first()[0]
    assert got == {"a.b.c": "1"}


def test_preview_hides_and_counts(spark):
    parsed = logs.parse_logs(lines(spark, ['{"severity":"high","user":"bob","src_ip":"10.0.0.1"}', "{bad"]), logs.LogConfig("json"))
    schema = [r.asDict() for r in logs.infer_schema(parsed).collect()]
    counts, rows = logs.preview(parsed, schema)
    assert counts.first().asDict() == {"parsed": 1, "rejected": 1}
    assert rows.first()["fields"] == {"severity": "high", "user": "[redacted]", "src_ip": "[redacted:ip]"}


def test_ledger_moves(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = spark.createDataFrame([("a", 0, 0), ("b", 3, 1)], "event_id string, state int, delivery_attempts int")
    full = rows.selectExpr(
        "event_id", "'f' AS fingerprint", "'p' AS payload", "1L AS payload_bytes", "timestamp'2024-01-01' AS received_at", "state", "delivery_attempts",
        "cast(NULL AS timestamp) AS lease_until", "cast(NULL AS timestamp) AS next_attempt_at", "cast(NULL AS string) AS last_failure_code",
        "cast(NULL AS string) AS acknowledgement", "cast(NULL AS timestamp) AS delivered_at",
    )
    moves = spark.createDataFrame(
        [("a", 1, "delivered", at, None, None, None, "ack"), ("a", 2, "lease", at, at, None, None, None), ("a", 3, "delivered", at, None, None, None, "ack"),
         ("b", 1, "lease", at, at, None, None, None)],
        ledger.TRANSITION,
    )
    after, refused = ledger.ledger_apply(full, moves)
    got = {r["event_id"]: r for r in after.collect()}
    assert (got["a"]["state"], got["a"]["delivery_attempts"], got["a"]["acknowledgement"]) == (ledger.DELIVERED, 1, "ack")
    assert got["b"]["state"] == ledger.DELIVERED
    assert {(r["event_id"], r["seq"]) for r in refused.collect()} == {("a", 1), ("b", 1)}


def test_due_limit_is_checked(spark):
    with pytest.raises(ValueError):
        ledger.due_for_delivery(spark.range(1), NOW, 0)


def test_jitter_is_bounded(spark):
    batch = spark.range(200).selectExpr("cast(id AS string) AS event_id", "8 AS delivery_attempts")
    failed = batch.selectExpr("event_id", "'x' AS code", "true AS retryable")
    waits = delivery.route_failures(failed, batch, NOW, jitter_seed=1).selectExpr(f"cast(next_attempt_at AS double) - cast({NOW} AS double) AS w")
    low, high = waits.agg(F.min("w"), F.max("w")).first()
    assert 256 <= low <= high <= 266


def test_packing_equals_greedy(spark):
    rng = random.Random(3)
    sizes = [rng.randint(1, 60) for _ in range(700)]
    df = spark.createDataFrame([("c", "s", f"e{i:04d}", "x" * n) for i, n in enumerate(sizes)], "collector_id string, stream string, event_id string, payload string")
    packed = spool.pack_files(df.withColumn("received_at", F.lit(0)), 100, batch=250).collect()
    got = {r["event_id"]: (r["batch_no"], r["file_no"]) for r in packed}
    for i, n in enumerate(sizes):
        if i % 250 == 0:
            file_no, used = 0, 0
        if used and used + n + 1 > 100:
            file_no, used = file_no + 1, 0
        used += n + 1
        assert got[f"e{i:04d}"] == (i // 250, file_no)


def test_spool_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c/1", "s", "e1", '{"a":1}'), ("c/1", "s", "e2", '{"a":2}')], "collector_id string, stream string, event_id string, payload string")
    spool.write_spool(spool.pack_files(df.withColumn("received_at", F.lit(0))), str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").rglob("*.txt")]
    assert [p.read_text() for p in files] == ['{"a":1}\n{"a":2}\n']
    assert "collector_id=c_1" in str(files[0])


def test_packing_keeps_null_keys_and_equal_rows(spark):
    rows = [(None, "s", "e1", "x"), (None, "s", "e2", "y"), ("c", "s", "e3", "z"), ("c", "s", "e3", "z")]
    df = spark.createDataFrame(rows, "collector_id string, stream string, event_id string, payload string").withColumn("received_at", F.lit(0))
    packed = spool.pack_files(df, 100).collect()
    assert sorted((r.collector_id or "", r.event_id, r._pos) for r in packed) == [("", "e1", 1), ("", "e2", 2), ("c", "e3", 1), ("c", "e3", 2)]


def test_null_keys_are_no_duplicates(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "fp string, n int")
    assert sorted(r.n for r in dedupe.keep_first(df, "fp", ["n"]).collect()) == [1, 2, 3]


def test_capacity_goes_on_after_a_refused_row(spark):
    rows = [("l", 1, 10), ("l", 2, 50), ("l", 3, 5), (None, 1, 20), (None, 2, 1), ("l", 4, None)]
    df = spark.createDataFrame(rows, "ledger_id string, event_id int, payload_bytes int").withColumn("received_at", F.lit(0))
    got = sorted((r.ledger_id or "", r.event_id, r.admitted) for r in dedupe.admit_skipping(df, 20, ["ledger_id"]).collect())
    assert got == [("", 1, True), ("", 2, False), ("l", 1, True), ("l", 2, False), ("l", 3, True), ("l", 4, True)]
    prefix = dedupe.admit_by_capacity(df, 20, ["ledger_id"]).collect()
    assert len(prefix) == 6


def test_running_capacity_with_one_hot_ledger(spark):
    df = spark.range(5_000).selectExpr("'hot' AS ledger_id", "lpad(cast(id AS string), 6, '0') AS event_id", "timestamp'2024-01-01' AS received_at", "cast(id % 7 + 1 AS bigint) AS payload_bytes")
    rows = dedupe.admit_by_capacity(df, 1_000, ["ledger_id"]).orderBy("event_id").collect()
    total = 0
    for i, r in enumerate(rows):
        total += i % 7 + 1
        assert (r["running_bytes"], r["admitted"]) == (total, total <= 1_000)


def test_index_within_a_hot_group(spark):
    df = spark.range(1_000).selectExpr("'k' AS key", "id * 3 AS n")
    got = index_within(df, ["key"], "n", width=100).orderBy("n").collect()
    assert [r["index"] for r in got] == list(range(1_000))


def test_quality(spark):
    good = spark.sql(f"SELECT 's' AS source_id, 't' AS source_type, true AS healthy, {NOW} - INTERVAL 1 HOUR AS last_event_at, 10L AS events_observed, true AS required")
    fields = spark.sql("SELECT 'f' AS field_name, 95L AS present, 100L AS total, true AS required")
    events = spark.sql("SELECT named_struct('actor', named_struct('username', 'u', 'userId', NULL), 'target', 'x', 'request', named_struct('correlationId', 'c', 'traceId', NULL), 'eventAction', 'a') AS event")
    report = quality.quality_report(quality.quality_components(good, fields, events, NOW)).first()
    assert report["overall"] >= 85 and report["recommendations"] == [quality.GOOD_LINE]
    empty = quality.quality_report(quality.quality_components(good.limit(0), fields.limit(0), events.limit(0), NOW)).first()
    assert empty["grade"] == "F" and "coverage: Register required security sources." in empty["recommendations"]


def test_rules_object_form(spark):
    raw = '{"name":"n","dataSources":{"windowsEventLogs":[{"name":"w","streams":["Microsoft-WindowsEvent"],"xPathQueries":["Security!*"]}]},"destinations":{}}'
    row = rules.assess_rules(rules.parse_rules(spark.createDataFrame([(raw,)], "raw string")), "100D").first()
    assert row["sources"][0]["kind"] == "windowsEventLogs"
    codes = [r["code"] for r in row["recommendations"]]
    assert codes[0] == "broad-security-events" and "missing-destination" in codes and row["savings_gb"] == 25.0


def test_fleet_life_cycle(spark):
    base = dict(machine_name="m", environment="e", configuration_hash="c", policy_hash="p")
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def event(seq, kind, **more):
        row = dict(collector_id="c1", seq=seq, kind=kind, at=at, principal="p1", version="1", queue_depth=7, delivery_status="healthy", sources=None, outputs=None,
                   action=None, target_status=None, reason=None, actor_name=None, **base)
        return {**row, **more}

    approve = dict(action="approved", target_status="Approved", reason="ok", principal="admin")
    rows = [event(1, "register"), event(2, "heartbeat"), event(3, "decide", **approve), event(4, "heartbeat"), event(5, "decide", **approve), event(6, "register", principal="thief")]
    events = spark.createDataFrame([tuple(r[f.name] for f in spark.createDataFrame([], fleet.FLEET_EVENT).schema) for r in rows], fleet.FLEET_EVENT)
    folded = fleet.fleet_fold(events)
    state = fleet.fleet_state(folded).first()
    assert (state["status"], state["queue_depth"]) == ("Active", 7)
    outcomes = [r["outcome"] for r in fleet.fleet_outcomes(folded).orderBy("seq").collect()]
    assert outcomes == ["ok", "state-conflict", "ok", "ok", "state-conflict", "identity-conflict"]
    assert fleet.fleet_audit(folded).count() == 2
    # Folding in two parts gives the same state.
    first = fleet.fleet_fold(events.filter("seq <= 3")).select("collector_id", "state")
    assert fleet.fleet_state(fleet.fold_from(first, events.filter("seq > 3"))).first() == state


def test_no_local_checkpoint_and_no_limits_in_keys():
    from pathlib import Path

    for path in Path(spool.__file__).resolve().parents[1].rglob("*.py"):
        assert "localCheckpoint" not in path.read_text(), path
