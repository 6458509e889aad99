"""Ingest, policies, alerts, detection, normalisation and sources."""

from __future__ import annotations

import json

import pytest

from telemill.operators import dedupe, detect, envelope, ingest, normalise, policy
from telemill.sources import aws, hostlogs, incremental

NOW = "timestamp'2026-07-26 02:14:19Z'"
WHO = ingest.CollectorIdentity("collector", "1.0", "sdk", "hash")
BASE = {
    "schemaVersion": "1.0.0", "eventId": "event-1", "eventOriginalId": "source-1", "timeGenerated": "2026-07-26T02:14:19Z",
    "eventCategory": "authentication", "eventType": "authentication_failure", "eventAction": "authentication.attempt", "eventResult": "failure",
    "eventOutcomeReason": "InvalidPassword", "application": {"name": "TestApplication", "environment": "test"},
    "actor": {"username": "test-user"}, "source": {"ipAddress": "192.0.2.10"}, "request": {"correlationId": "correlation-1"},
}


def variant(**changes):
    return json.dumps({k: v for k, v in {**BASE, **changes}.items() if v is not None})


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = {
        "base": variant(), "free": variant(eventType="free_form_diagnostic", eventCategory="diagnostic"), "no_actor": variant(actor=None),
        "password": variant(attributes={"password": "never-persist"}), "tfn": variant(attributes={"note": "TFN 100000001"}),
        "mail": variant(attributes={"contact": "a@b.org"}), "number_id": variant(eventId=5), "old": variant(timeGenerated="2019-01-01T00:00:00Z"),
        "long_id": variant(eventId="x" * 129), "empty": "", "list": "[]", "broken": "{ invalid",
    }
    df = spark.createDataFrame(list(rows.items()), "name string, raw string")
    return ingest.process(df, WHO, NOW).cache()


def test_actions(outcomes):
    actions = {r["name"]: r["action"] for r in outcomes.collect()}
    assert actions == {
        "base": "accept", "free": "reject", "no_actor": "quarantine", "password": "redactAndAccept", "tfn": "redactAndAccept",
        "mail": "redactAndAccept", "number_id": "quarantine", "old": "quarantine", "long_id": "quarantine", "empty": "quarantine",
        "list": "quarantine", "broken": "quarantine",
    }


def test_base_score_and_reasons(outcomes):
    base = outcomes.filter("name = 'base'").first()
    assert base["decision"]["score"] == 98
    assert base["reasons"][2] == "Value score 98 meets minimum 70"
    free = outcomes.filter("name = 'free'").first()
    assert free["decision"]["policyId"] == policy.DEFAULT_DENY_ID and free["decision"]["score"] == 0


def test_alerts_only_for_worthy_findings(outcomes):
    alerts = {r["name"]: r["alert"] for r in outcomes.filter("alert IS NOT NULL").collect()}
    assert set(alerts) == {"password", "tfn"}
    assert alerts["tfn"]["eventCategory"] == "privacy-control" and alerts["tfn"]["privacy"]["detected"] == ["au.tfn"]


def test_secret_is_nowhere(outcomes):
    text = str([r.asDict(True) for r in outcomes.filter("name = 'password'").collect()])
    assert "never-persist" not in text


def test_second_copy_is_a_duplicate(spark):
    df = spark.createDataFrame([(variant(),), (variant(),), (variant(eventId="event-2"),)], "raw string")
    rows = ingest.to_queue(ingest.process(df, WHO, NOW), NOW)
    assert rows.count() == 3
    assert dedupe.dedupe_first(rows).count() == 1


def test_rows_are_kept_through_the_pipeline(outcomes):
    assert outcomes.count() == 12


def test_policy_documents_are_checked():
    good = {
        "apiVersion": "x.security/v1", "kind": "TelemetryPolicy", "metadata": {"id": "P", "version": "1"},
        "match": {"eventTypes": ["t"]}, "decision": {"action": "redact-and-accept", "minimumValueScore": 10},
    }
    assert policy.TelemetryPolicy.from_document(good).id == "P"
    for change in ({"kind": "Other"}, {"match": {}}, {"decision": {"action": "maybe"}}, {"decision": {"action": "accept", "minimumValueScore": 101}}):
        with pytest.raises(ValueError):
            policy.TelemetryPolicy.from_document({**good, **change})


def test_detection_and_suppression(spark):
    rule = detect.DetectionRule.from_document(
        {"id": "r1", "title": "Auth", "level": "High", "tags": ["attack.t1110"], "detection": {"selection": {"EventType": "authentication_failure"}}}
    )
    events = envelope.decode_envelope(spark.createDataFrame([(variant(),)], "raw string"), "raw")
    alert = detect.detect(events, [rule], NOW).collect()
    assert [(a["risk_score"], a["techniques"], a["actor"]) for a in alert] == [(75, ["T1110"], "test-user")]
    assert detect.detect(events, [rule], NOW, suppressed=["R1"]).count() == 0
    assert detect.suppressed_rules([rule], ["R1"]) == ["r1"]


def test_not_is_ignored_unless_strict(spark):
    rule = detect.DetectionRule("r", "t", {"a": "EventType:authentication_failure"}, "not a")
    events = envelope.decode_envelope(spark.createDataFrame([(variant(),)], "raw string"), "raw")
    assert detect.detect(events, [rule], NOW).count() == 1
    assert detect.detect(events, [rule], NOW, strict=True).count() == 0


def test_normalise_cases(spark):
    rows = [("Envelope", variant(eventSeverity="high")), ("WindowsEvent", '{"EventID":4625,"TargetUserName":"u"}'), ("Sysmon", "{bad"), ("Other", "{}")]
    done = normalise.normalise_mixed(spark.createDataFrame(rows, "kind string, raw string"), "kind", NOW)
    got = {r["kind"]: r["ocsf"] for r in done.collect()}
    assert (got["Envelope"]["event"]["class_uid"], got["Envelope"]["event"]["severity_id"]) == (3002, 4)
    assert got["WindowsEvent"]["event"]["status"] == "Failure"
    assert got["Sysmon"]["failure_code"] == "invalid-json" and got["Other"]["failure_code"] == "unsupported-source"


def test_custom_mapper(spark):
    mappers = normalise.register_mapper(normalise.MAPPERS, "Mine", normalise.vendor("Mine", "My Product", "Me"))
    done = normalise.normalise(spark.createDataFrame([('{"title":"x"}',)], "raw string"), "Mine", NOW, mappers=mappers).first()["ocsf"]
    assert done["event"]["metadata_product_name"] == "My Product"
    with pytest.raises(ValueError):
        normalise.register_mapper(mappers, "Mine", normalise.sysmon)


def test_aws_documents_of_any_size(spark):
    raw = json.dumps({"Records": [{"eventID": str(i), "eventName": "x" * 70_000 if i == 7 else "x"} for i in range(1_001)]})
    df = spark.createDataFrame([(raw,), ("{bad",)], "raw string")
    options = aws.AwsOptions("s")
    assert aws.map_aws(df, "cloudtrail", options, NOW).count() == 1_001
    assert [r.failure_code for r in aws.rejected_aws(df, "cloudtrail", options).collect()] == ["invalid-json"]
    limited = aws.AwsOptions("s", max_batch_events=1_000)
    assert sorted(r.failure_code for r in aws.rejected_aws(df, "cloudtrail", limited).collect()) == ["batch-too-large", "invalid-json"]


def test_aws_oversize_record_rejects_document(spark):
    options = aws.AwsOptions("s", max_record_bytes=1_024)
    raw = json.dumps([{"title": "x" * 2_000}, {"title": "ok"}])
    assert aws.aws_limits(spark.createDataFrame([(raw,)], "raw string"), "securityhub", options).first()["failure_code"] == "record-too-large"
    with pytest.raises(ValueError):
        aws.AwsOptions("s", account_id="12")


def test_host_lines(spark):
    lines = spark.createDataFrame([("auth", 0, "Failed password for root from 203.0.113.10"), ("auth", 1, " "), ("off", 0, "x")], "source_id string, line_no int, line string")
    sources = spark.createDataFrame([("auth", "Auth", "/var/log/auth.log", True), ("off", "Auth", "/x", False)], hostlogs.HOST_SOURCE)
    rows = hostlogs.map_host_lines(lines, sources, hostlogs.LineOptions("agent", "app"), NOW).collect()
    assert [(r["event"]["eventType"], r["event"]["eventResult"], r["event"]["eventCategory"]) for r in rows] == [("host_auth", "failure", "authentication")]


def test_cursor_guards(spark):
    from datetime import datetime, timedelta, timezone

    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = spark.createDataFrame([(1, at), (2, at)], "sequence bigint, event_time timestamp")
    cursor = incremental.Cursor(2, at)
    batch = incremental.incremental_scan(rows, "timestamp", cursor, 2, overlap=timedelta(minutes=5))
    report = incremental.batch_report(batch, "timestamp", cursor, 2, 1_000, timedelta(minutes=5))
    with pytest.raises(incremental.OverlapSaturated):
        incremental.check_batch(report, "s")
    with pytest.raises(incremental.RecordTooLarge):
        incremental.check_batch(incremental.batch_report(batch, "timestamp", cursor, 5, 3), "s")


def test_cursor_versions(spark):
    current = spark.createDataFrame([("a", "v1", 1, None)], "source_id string, value string, version bigint, updated_at timestamp")
    proposals = spark.createDataFrame(
        [("a", 1, "v2", None), ("a", 0, "old", None), ("b", 0, "first", None)], "source_id string, expected_version bigint, value string, updated_at timestamp"
    )
    advanced, refused = incremental.advance_cursors(current, proposals)
    assert {(r["source_id"], r["version"]) for r in advanced.collect()} == {("a", 2), ("b", 1)}
    assert [(r["source_id"], r["expected_version"]) for r in refused.collect()] == [("a", 0)]
