"""Operators that cut hot groups, long texts and long histories into bounded pieces, against plain versions."""

from __future__ import annotations

import dataclasses
import pickle
import random
import re
import time
from collections import Counter
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_privacy import redact

from telemill.operators import dedupe, detect, fleet, rulematch
from telemill.operators.privacy import engine
from telemill.operators.privacy.detectors import PATTERNS
from telemill.plans.inputs import NOW
from telemill.streaming import lifecycle
from telemill.streaming.ingest import write_exact
from telemill.streaming.keyindex import KeyIndex, bloom, passes

START = datetime(2024, 1, 1, tzinfo=timezone.utc)

# ---- rules ---------------------------------------------------------------------------------------

EVENT = (
    "event struct<eventId:string,eventType:string,eventAction:string,eventCategory:string,eventResult:string,eventOutcomeReason:string,"
    "actor:struct<username:string,userId:string>,source:struct<ipAddress:string>,target:struct<name:string,type:string>,"
    "application:struct<name:string>,labels:map<string,string>>"
)


def some_events(rnd, n):
    word = lambda: rnd.choice(["alpha", "Beta", "gamma delta", "x", "", None])
    return [
        ((f"e{i}", word(), word(), word(), rnd.choice(["success", "failure"]), word(), (word(), word()) if rnd.random() < 0.8 else None,
          (word(),), (word(), word()), (word(),), {k: word() for k in rnd.sample(["tier", "Zone", "eventtype", "subzone"], rnd.randrange(4))} or None),)
        for i in range(n)
    ]


def some_rules(rnd, n):
    names = ["EventType", "eventaction", "username", "Type", "tier", "zone", "one", "nothing", "EventResult", "Action|contains", "SourceIp*"]
    values = ["alpha", "BETA", "a", "lph", "delta", "success", "x", "gamma delta"]
    clause = lambda: rnd.choice(values) if rnd.random() < 0.2 else f"{rnd.choice(names)}:{'|'.join(rnd.sample(values, rnd.randrange(4)))}"
    conditions = ["selection", "a and b", "a or b", "1 of them", "a or missing", "not a", "not a and b", "them", "a AND missing"]
    rules = []
    for i in range(n):
        groups = {g: ";".join(clause() for _ in range(rnd.randrange(1, 4))) for g in rnd.sample(["selection", "a", "B"], rnd.randrange(1, 4))}
        if rnd.random() < 0.05:
            groups["a"] = ""
        rules.append(detect.DetectionRule(f"r{i}", f"Rule {i}", groups, rnd.choice(conditions), rnd.choice(["low", "high", "odd"])))
    return rules


@pytest.mark.parametrize("strict", [False, True])
def test_rule_table_gives_the_alerts_of_compiled_rules(spark, strict):
    rnd = random.Random(11 + strict)
    events = spark.createDataFrame(some_events(rnd, 60), EVENT)
    rules = some_rules(rnd, 80)
    off = ["R3", "r7"]
    columns = ["alert_id", "rule_id", "rule_title", "level", "risk_score", "event_id", "actor", "source_ip", "summary"]
    want = Counter(tuple(r[c] for c in columns) for r in detect.detect(events, rules, NOW, off, strict=strict).collect())
    table = rulematch.rule_table(spark, rules)
    gone = spark.createDataFrame([(x,) for x in off], "rule_id string")
    for shard_bytes in (rulematch.SHARD_BYTES, 900):
        found = rulematch.detect_with_rules(events, table, NOW, gone, strict=strict, shard_bytes=shard_bytes)
        assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == want
    assert len(want) > 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("strict", [False, True])
def test_totals_of_a_rule_table_are_those_of_its_alerts(spark, strict):
    """Totals need no alert: tables of many rules over few selections made events times rules of them."""
    rnd = random.Random(21 + strict)
    events = spark.createDataFrame(some_events(rnd, 60), EVENT).repartition(3)
    # Rules with other names and levels repeat the logic of others.
    rules = [r for r in some_rules(rnd, 40)] + [dataclasses.replace(r, id=f"{r.id}-again", title="More", level="critical") for r in some_rules(random.Random(21 + strict), 10)]
    table = rulematch.rule_table(spark, rules + rules[:1])
    table = table.unionByName(table.limit(0)).unionByName(spark.createDataFrame([("bare", "Bare", "1", "h", None, None, None, {"selection": "EventType:alpha"}), ("none", "None", "1", "h", "low", [], "a", None)], rulematch.RULES))
    gone = spark.createDataFrame([("R3",), ("r7",)], "rule_id string")
    made = rulematch.detect_with_rules(events, table, NOW, gone, strict=strict).collect()
    want = {}
    for r in made:
        want.setdefault((r.rule_id, r.level), []).append(r)
    want = {k: (len(v), v[0].risk_score, min(r.event_id for r in v), max(",".join(r.matched_fields) for r in v), max((r.summary for r in v if r.summary is not None), default=None)) for k, v in want.items()}
    for shard_bytes in (rulematch.SHARD_BYTES, 600):
        found = rulematch.alert_totals(events, table, gone, strict=strict, shard_bytes=shard_bytes).groupBy("rule_id", "level").agg(
            F.sum("alerts"), F.min("risk_score"), F.min("first_event"), F.max("most_fields"), F.max("last_summary")
        )
        assert {(r[0], r[1]): tuple(r[2:]) for r in found.collect()} == want
    assert len(want) > 8 and rulematch.alert_totals(events, table.limit(0)).count() == 0


def test_rules_with_the_same_logic_are_matched_once(spark, monkeypatch):
    matched, scan = [], rulematch.scan_totals
    monkeypatch.setattr(rulematch, "scan_totals", lambda cells, rules: matched.append(len(rules)) or scan(cells, rules))
    table = spark.range(500).selectExpr("concat('r', id) AS rule_id", "'t' AS title", "'1' AS version", "'h' AS hash", "'low' AS level", "array('T') AS techniques", "'a' AS condition", "map('a', concat('EventResult:', IF(id % 2 = 0, 'success', 'failure'))) AS selections")
    events = spark.createDataFrame(some_events(random.Random(2), 50), EVENT)
    assert rulematch.alert_totals(events, table).agg(F.sum("alerts")).first()[0] == 50 * 250 and matched == [2]


def test_rule_table_edge_cases(spark):
    events = spark.createDataFrame(some_events(random.Random(1), 5), EVENT)
    assert rulematch.detect_with_rules(events, spark.createDataFrame([], rulematch.RULES), NOW).count() == 0
    clauses = spark.createDataFrame([], "rule_id string, level string, field string, value string")
    assert rulematch.detect_with_table(events, clauses).count() == 0
    matcher = rulematch.Matcher([rulematch.logic_of("a or b", {"a": "EventType:x;EventAction:y", "b": "Application:z"})])
    met = matcher.places_met(["xx", "n", "", "", "", "", "", "", "", "", "z"], None, [], [])
    # As far as its clauses hold, a group that fails is reported too.
    assert matcher.fired(met) == 1 and matcher.fields(0, met) == ["EventType", "Application"]


# ---- fleet ---------------------------------------------------------------------------------------


def plain_fleet(rows, start=()):
    """Outcome by (collector, seq), and the states, by walking the events of each collector."""
    states, outcomes = dict(start), {}
    for e in sorted(rows, key=lambda e: (e["collector_id"], e["seq"])):
        st = states.get(e["collector_id"])
        p, owner = e["principal"], st and st["principal"]
        if e["kind"] == "register":
            outcome = "identity-conflict" if owner is not None and p is not None and p != owner else "ok"
            new = dict(status=st["status"] if st else "Pending", principal=p, version=e["version"], queue_depth=st["queue_depth"] if st else 0, reports_seq=e["seq"])
        elif e["kind"] == "heartbeat":
            known = owner is not None and (p is None or p == owner)
            outcome = "unknown-collector" if not known else "ok" if st["status"] in ("Approved", "Active") else "state-conflict"
            new = dict(st or {}, status="Active", version=e["version"], queue_depth=e["queue_depth"], reports_seq=e["seq"])
        else:
            legal = {"approved": ("Pending", "Approved"), "rejected": ("Pending", "Revoked"), "suspended": ("Approved Active", "Suspended"), "revoked": ("Pending Approved Active Suspended", "Revoked")}
            sources, target = legal.get(e["action"], ("", ""))
            outcome = "reason-required" if not (e["reason"] or "").strip() else "unknown-collector" if st is None else "ok" if st["status"] in sources.split() and e["target_status"] == target else "state-conflict"
            new = dict(st or {}, status=e["target_status"])
        outcomes[e["collector_id"], e["seq"]] = outcome
        if outcome == "ok":
            states[e["collector_id"]] = new
    return outcomes, states


def fleet_rows(rnd, n):
    rows = []
    for seq in range(n):
        kind = rnd.choice(["register", "heartbeat", "heartbeat", "decide"])
        action, target = rnd.choice([("approved", "Approved"), ("approved", "Approved"), ("rejected", "Revoked"), ("suspended", "Suspended"), ("revoked", "Revoked"), ("approved", "Active")])
        rows.append(dict(
            collector_id=rnd.choice(["hot", "hot", "hot", "hot", "hot", f"c{rnd.randrange(40)}"]), seq=seq, kind=kind, at=START + timedelta(seconds=seq),
            principal=rnd.choice(["p", "p", "p", "thief", None]) if kind != "heartbeat" else rnd.choice(["p", "thief"]), version=str(seq), queue_depth=seq % 9,
            action=action if kind == "decide" else None, target_status=target if kind == "decide" else None, reason=rnd.choice(["fine", "fine", " "]),
        ))
    return rows


def fleet_frame(spark, rows):
    empty = spark.createDataFrame([], fleet.FLEET_EVENT).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in empty) for r in rows], empty).repartition(5)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fleet_of_a_hot_collector(spark, seed):
    """Also in two parts, where the second starts from the states of the first."""
    rows = fleet_rows(random.Random(seed), 700)
    outcomes, states = plain_fleet(rows)

    def check(folded, outcomes, states):
        assert {(r.collector_id, r.seq): r.outcome for r in fleet.fleet_outcomes(folded).collect()} == outcomes
        got = {r.collector_id: dict(status=r.status, principal=r.principal, version=r.version, queue_depth=r.queue_depth, reports_seq=r.reports_seq) for r in fleet.fleet_state(folded).collect()}
        assert got == states

    check(fleet.fleet_fold(fleet_frame(spark, rows)), outcomes, states)
    first = fleet.fleet_fold(fleet_frame(spark, rows[:300])).select("collector_id", "state")
    later, states = plain_fleet(rows[300:], plain_fleet(rows[:300])[1])
    check(fleet.fold_from(first, fleet_frame(spark, rows[300:])), later, states)


# ---- admission -----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed, most", [(1, 2000), (2, 150), (3, 10**6), (4, 0)])
def test_admission_of_a_hot_ledger(spark, seed, most):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot", "hot", "a", None]), f"e{i:04d}", rnd.choice([None, 0, 1, 3, 30, 200, rnd.randrange(1, 500)])) for i in range(900)]
    df = spark.createDataFrame(rows, "ledger string, event_id string, payload_bytes bigint").withColumn("received_at", F.lit(0))
    got = {r.event_id: (r.admitted, r.admitted_bytes) for r in dedupe.admit_skipping(df.repartition(6), most, ["ledger"]).collect()}
    used, want = Counter(), {}
    for ledger, event, size in sorted(rows, key=lambda r: r[1]):
        fits = used[ledger] + (size or 0) <= most
        used[ledger] += (size or 0) * fits
        want[event] = (fits, used[ledger])
    assert got == want


# ---- known keys ----------------------------------------------------------------------------------


def test_bloom_filters_pass_their_keys():
    import numpy as np

    rng = np.random.default_rng(1)
    keys, others = (rng.integers(-(2**63), 2**63 - 1, 5000) for _ in range(2))
    bits = bloom(keys)
    assert passes(bits, keys).all() and passes(bits, others).mean() < 0.03 and len(bits) < 5000 * 1.3
    assert len(bloom(keys[:0])) == 8


def test_key_index_reads_what_a_batch_needs(spark, tmp_path):
    """Fifty batches: each opens few of the key files, generations stay few, replays change nothing."""
    base = f"file://{tmp_path}/ledger"
    index = KeyIndex(spark, f"{base}/index", 200, 4)
    ledger = "event_id string, fingerprint string, received_at int"
    seen, opened, size = set(), [], 200
    rnd = random.Random(5)
    for number in range(50):
        ids = [number * size + i for i in range(size)]
        # Some keys of long ago come again.
        again = rnd.sample(sorted(seen), 3) if seen else []
        rows = [(f"e{i}", f"f{i}", i) for i in ids + again]
        batch = spark.createDataFrame(rows, ledger).coalesce(2)
        keys = batch.selectExpr("'event_id' AS kind", "event_id AS key")
        live = index.live(number)
        if number % 10 == 9:
            asked = index.candidates(keys, live).select("gen", "bucket").distinct().collect()
            total = sum(g.buckets for g in live)
            opened.append((len(asked), total))
            assert len(live) <= 4 * 4
        write_exact(batch, base, number, 200, 4)
        if number == 20:
            write_exact(batch, base, number, 200, 4)
        seen |= set(ids)
    got = spark.read.parquet(f"{base}/rows").select("event_id").collect()
    assert Counter(r.event_id for r in got) == Counter(f"e{i}" for i in seen)
    # One in a hundred other keys passes a filter; buckets hold about 200 keys and a batch 200.
    assert index.known(spark.createDataFrame([("event_id", "e17"), ("event_id", "new"), ("fingerprint", "e17"), ("event_id", None)], "kind string, key string"), 50).collect() == [("event_id", "e17")]
    few = index.candidates(spark.createDataFrame([("event_id", f"new{i}") for i in range(5)], "kind string, key string"), index.live(50)).select("gen", "bucket").distinct().count()
    assert few <= 0.15 * sum(g.buckets for g in index.live(50)) and opened[-1][1] > 50
    assert index.vacuum(49) and index.known(spark.createDataFrame([("event_id", "e9999")], "kind string, key string"), 50).count() == 1


# ---- long texts ----------------------------------------------------------------------------------


def timed(spark, text, detectors=None):
    started = time.perf_counter()
    df = spark.createDataFrame([(text,)], "text string")
    found = engine.redact_text(df, "text", None, detectors).select(F.size("redaction.findings").alias("n"), F.length("redaction.text").alias("size")).first()
    return found, time.perf_counter() - started


def test_many_matches_in_one_text(spark):
    redact(spark, "warm up a@example.org")
    text = " ".join(f"u{i}@example{i % 7}.org" for i in range(100_000))
    found, seconds = timed(spark, text)
    assert found.n == 100_000 and seconds < 30


MARKS = ["-----BEGIN CERTIFICATE-----", "-----END CERTIFICATE-----", "-----BEGIN RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----",
         "-----BEGIN PGP PUBLIC KEY BLOCK-----", "-----END PGP KEY BLOCK-----", "BEGIN CERTIFICATE-----", "-----END CERTIFICATE", "x", "é😀", "\n", "-----"]


def test_key_blocks_are_those_of_the_pattern(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(MARKS) for _ in range(rnd.randrange(1, 14))) for _ in range(1500)]
    from telemill.operators.privacy.detectors import builtin_detectors

    only = [d for d in builtin_detectors() if d.id == "crypto.material"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got: dict[int, list] = {}
    for r in engine.find_sensitive(df, "id", "text", None, only).collect():
        got.setdefault(r.id, []).append((r.start, r.start + r["size"]))
    want = {i: [m.span() for m in re.finditer(PATTERNS["crypto.material"], t)] for i, t in enumerate(texts)}
    assert {i: sorted(s) for i, s in got.items()} == {i: s for i, s in want.items() if s}
    assert len(got) > 200


@pytest.mark.parametrize("piece", ["-----BEGIN RSA PRIVATE KEY-----\n", "PASSWORD_"])
def test_hostile_texts(spark, piece):
    text = piece * (1_000_000 // len(piece))
    _, seconds = timed(spark, text)
    assert seconds < 60


# ---- streams -------------------------------------------------------------------------------------


def run_stream(spark, make, place, schema):
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    with lifecycle.state_store(spark):
        query = make(arriving).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return query


MOVE = "event_id string, seq bigint, action string, at timestamp, lease_until timestamp, next_attempt_at timestamp, failure_code string, acknowledgement string"


def test_deliveries_out_of_order(spark, tmp_path):
    """Moves of a key in separate files, last first, with a gap; the state is empty a day after the last result."""
    place = f"file://{tmp_path}"
    at = lambda m: START + timedelta(minutes=m)
    moves = [("a", 0, "enqueue", 0), ("a", 1, "lease", 1), ("a", 2, "delivered", 2), ("b", 0, "enqueue", 0), ("b", 2, "lease", 2), ("c", 1, "lease", 1), ("b", 3, "retrying", 3), ("d", 0, "enqueue", 0), ("d", 1, "lease", 1)]
    for key, seq, action, minute in reversed(moves):
        lease = at(minute + 5) if action == "lease" else None
        row = (key, seq, action, at(minute), lease, None, "http-500", "ack")
        spark.createDataFrame([row], MOVE).coalesce(1).write.mode("append").parquet(f"{place}/in")
    schema = spark.createDataFrame([], MOVE).schema
    run_stream(spark, lambda df: lifecycle.ledger_stream(df, "1 hour"), place, schema)
    read = lambda: {(r.event_id, r.seq, r.action): (r.accepted, r.state, r.attempts) for r in spark.read.parquet(f"{place}/out").collect() if r.event_id != "end"}
    first = read()
    assert first == {("a", 0, "enqueue"): (True, 0, 0), ("a", 1, "lease"): (True, 1, 1), ("a", 2, "delivered"): (True, 3, 1), ("b", 0, "enqueue"): (True, 0, 0), ("d", 0, "enqueue"): (True, 0, 0), ("d", 1, "lease"): (True, 1, 1)}
    # The watermark passes what waits, then all that is done.
    for minute in (600, 6000):
        spark.createDataFrame([("end", minute, "lease", at(minute), None, None, None, None)], MOVE).coalesce(1).write.mode("append").parquet(f"{place}/in")
        query = run_stream(spark, lambda df: lifecycle.ledger_stream(df, "1 hour"), place, schema)
    assert read() == first | {("b", 2, "lease"): (True, 1, 1), ("b", 3, "retrying"): (True, 2, 1), ("c", 1, "lease"): (False, None, None), ("d", None, "lease-expired"): (True, 1, 1)}
    kept = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    # Rows of b and d that wait for an attempt, and the last one.
    assert kept[-1] <= 12


def test_fleet_stream_gives_the_states_of_the_fold(spark, tmp_path):
    rows = [dict(r, seq=i + 1) for key in ("hot", "c1", "c2", "c3") for i, r in enumerate([r for r in fleet_rows(random.Random(4), 300) if r["collector_id"] == key])]
    place = f"file://{tmp_path}"
    frame = fleet_frame(spark, rows)
    # In files by number, last first: every event but the first waits.
    for low in (40, 10, 0):
        frame.where(f"seq > {low} AND seq <= {[400, 40, 10][[40, 10, 0].index(low)]}").coalesce(1).write.mode("append").parquet(f"{place}/in")
    run_stream(spark, lambda df: lifecycle.fleet_stream(df, "10 days"), place, frame.schema)
    got = {(r.collector_id, r.seq): r.outcome for r in spark.read.parquet(f"{place}/out").collect()}
    assert got == plain_fleet(rows)[0]


def test_silence_is_told_and_ends(spark, tmp_path):
    place = f"file://{tmp_path}"
    schema = "collector_id string, at timestamp"
    for minute, key in ((0, "a"), (0, "b"), (20, "b"), (40, "b"), (50, "a"), (200, "b")):
        spark.createDataFrame([(key, START + timedelta(minutes=minute))], schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
        run_stream(spark, lambda df: lifecycle.stale_stream(df, "15 minutes", "1 minute"), place, spark.createDataFrame([], schema).schema)
    got = sorted(((r.last_seen_at.replace(tzinfo=None) - START.replace(tzinfo=None)).seconds // 60, r.collector_id, r.status) for r in spark.read.parquet(f"{place}/out").collect())
    assert [g for g in got if g[1] == "a"] == [(0, "a", "stale"), (50, "a", "heard"), (50, "a", "stale")]
    # The watermark never passes a quarter of an hour without b: it moves only with what arrives.
    assert not [g for g in got if g[1] == "b"]


def test_a_key_with_moves_that_wait_costs_one_read_and_one_write(spark):
    """Each access to the state store is a message; a key made up to nine of them in a batch."""
    calls = []
    kept = {"value": None}
    row = SimpleNamespace(get=lambda: calls.append("get") or kept["value"], update=lambda v: calls.append("update") or kept.update(value=v))
    handle = SimpleNamespace(getValueState=lambda *_: row, registerTimer=lambda t: calls.append("timer"))
    move = "seq bigint, action string, failure_code string, acknowledgement string, at_us bigint, lease_until_us bigint, next_attempt_at_us bigint"
    ledger = lifecycle.Deliveries(move, lifecycle.LEDGER_OUT, 0)
    ledger.init(handle)
    came = lambda seq, action: SimpleNamespace(seq=seq, action=action, failure_code="x", acknowledgement="ack", at_us=1_000_000 * seq, lease_until_us=None, next_attempt_at_us=None)
    Move = Row(*[c.split()[0] for c in move.split(", ")])  # noqa: N806
    as_row = lambda m: Move(m.seq, m.action, m.failure_code, m.acknowledgement, m.at_us, m.lease_until_us, m.next_attempt_at_us)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    out = [list(ledger.handleInputRows(("a",), iter([as_row(came(s, a))]), clock)) for s, a in ((2, "delivered"), (3, "lease"), (1, "lease"), (0, "enqueue"))]
    assert [len(o) for o in out] == [0, 0, 0, 4] and [r.accepted for r in out[3]] == [True, True, True, False]
    # A timer for the first that waits, and another when an earlier one comes; the last one forgets the row.
    assert calls == ["get", "timer", "update", "get", "update", "get", "timer", "update", "get", "timer", "update"]


class FakeStore:
    """The state and the timers of one key a group, fired in the order of their times."""

    def __init__(self, rules):
        self.rows, self.timers, self.key = {}, set(), None
        self.rules = rules
        rules.init(self)

    def getValueState(self, *_):  # noqa: N802
        clear = lambda: self.rows.pop(self.key, None)
        return SimpleNamespace(get=lambda: self.rows.get(self.key), update=lambda v: self.rows.__setitem__(self.key, v), clear=clear)

    def registerTimer(self, time):  # noqa: N802
        self.timers.add((time, self.key))

    def batch(self, moves, now):
        out, clock = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
        for self.key in dict.fromkeys(k for k, _ in moves):
            out += self.rules.handleInputRows((self.key,), iter([m for k, m in moves if k == self.key]), clock)
        while due := [t for t in self.timers if t[0] <= now]:
            time, self.key = min(due, key=str)
            out += self.rules.handleExpiredTimer((self.key,), clock, SimpleNamespace(getExpiryTimeInMs=lambda: time))  # noqa: B023
            self.timers.discard((time, self.key))
        return Counter(map(tuple, out))


@pytest.mark.parametrize("seed", range(4))
def test_keys_of_a_bucket_are_told_as_alone(seed):
    """Random moves, late, lost, repeated and early, of keys that share a bucket and of the same keys by themselves."""
    rnd = random.Random(seed)
    columns = "seq bigint, action string, failure_code string, acknowledgement string, at_us bigint, lease_until_us bigint, next_attempt_at_us bigint"
    Move = Row(*[c.split()[0] for c in columns.split(", ")])  # noqa: N806
    rules = lambda: lifecycle.Deliveries(columns, lifecycle.LEDGER_OUT, 0)
    alone, bucket = FakeStore(rules()), lifecycle.Bucketed(rules())
    group = SimpleNamespace(exists=False, hasTimedOut=False, get=None, setTimeoutTimestamp=lambda t: setattr(group, "time", t))
    group.update = lambda v: (setattr(group, "exists", True), setattr(group, "get", v))
    group.remove = lambda: setattr(group, "exists", False)
    minute, now, told = 60_000_000, 0, 0
    hours = [0, 1, 2, 3, 30, 31, 60, 61, 90, 200]
    for hour in hours:
        moves = []
        for _ in range(60 if hour < 200 else 0):
            seq = rnd.randrange(8)
            at = (hour * 60 + rnd.randrange(1, 90)) * minute
            action = "enqueue" if seq == 0 else rnd.choice(["lease", "lease", "delivered", "retrying", "dead-lettered", "odd"])
            until = at + rnd.randrange(90) * minute if action == "lease" and rnd.random() < 0.9 else None
            moves.append((rnd.choice(["a", "b", "c", None, *"defgh"]), Move(seq, action, rnd.choice(["x", None]), rnd.choice(["ack", "", None]), at, until, rnd.choice([None, at + minute]))))
        now = max(now, hour * 3_600_000 - 1_800_000)
        group.getCurrentWatermarkMs = lambda: now  # noqa: B023
        whole = [c.split()[0] for c in columns.split(", ") if c.endswith("bigint")]
        frame = pd.DataFrame([(k, *m) for k, m in moves], columns=["key", *Move], dtype=object)
        frame[whole] = frame[whole].map(lambda x: lifecycle._NULL if x is None else x)
        group.hasTimedOut, group.time = not moves, None
        got = Counter(r for out in bucket((1,), iter([frame.iloc[:17], frame.iloc[17:]]), group) for r in out.itertuples(index=False, name=None))
        want = alone.batch(moves, now)
        # Alone, a lease that has run out may be told again when what waits is let pass; once is right.
        again = {r: n for r, n in want.items() if r[2] == "lease-expired"}
        assert {r: n for r, n in got.items() if r not in again} == {r: n for r, n in want.items() if r not in again}
        assert all(r in again for r in got if r[2] == "lease-expired") and all(got[r] <= n for r, n in again.items())
        assert group.time is None or group.time >= max(now, 1)
        told += sum(got.values())
    assert told > 300 and not group.exists or set(pickle.loads(group.get[0])) == set(alone.rows)


def test_keys_of_a_stream_share_few_state_rows(spark, tmp_path, monkeypatch):
    """A state row, its messages and an Arrow batch per key cost a hundred times what its moves do."""
    monkeypatch.setattr(lifecycle, "BUCKETS", 16)
    place = f"file://{tmp_path}"
    at = lambda m: f"timestamp'2024-01-01 00:0{m}:00Z'"
    nothing = "cast(null AS timestamp) AS next_attempt_at, 'x' AS failure_code, 'ack' AS acknowledgement"
    for seq, action in ((2, "delivered"), (1, "lease"), (0, "enqueue")):
        lease = "timestamp'2024-01-01 01:00:00Z'" if seq == 1 else "cast(null AS timestamp)"
        spark.range(3000).selectExpr("IF(id = 7, NULL, concat('e', id)) AS event_id", f"{seq}L AS seq", f"'{action}' AS action", f"{at(seq)} AS at", f"{lease} AS lease_until", nothing.split(", ")[0], *nothing.split(", ")[1:]).coalesce(1).write.mode("append").parquet(f"{place}/in")
    query = run_stream(spark, lambda df: lifecycle.ledger_stream(df, "1 hour"), place, spark.createDataFrame([], MOVE).schema)
    got = spark.read.parquet(f"{place}/out").groupBy("seq", "accepted", "state", "attempts").agg(F.count_distinct(F.coalesce("event_id", F.lit("-"))).alias("n")).collect()
    assert sorted(map(tuple, got)) == [(0, True, 0, 0, 3000), (1, True, 1, 1, 3000), (2, True, 3, 1, 3000)]
    assert max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators) <= 16
