"""Detectors, redaction and JSON documents."""

from __future__ import annotations

import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from telemill.functions import checksums, tokens
from telemill.operators import normalise
from telemill.operators.privacy import engine, jsonwalk
from telemill.operators.privacy.detectors import builtin_detectors, register_detector
from telemill.operators.privacy.policy import ENCRYPT, HMAC, MASK, OPT_IN_DETECTORS, REPLACE, PrivacyPolicy
from telemill.sources import aws
from telemill.sources.candidates import with_candidate_status

AWS = "AKIA" + "IOSFODNN7EXAMPLE"
JWT = "eyJ" + "hbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9" + ".eyJ" + "zdWIiOiIxIn0" + ".signature"
PEM = "-----BEGIN RSA " + "PRIVATE KEY-----\nMIIE\n-----END RSA " + "PRIVATE KEY-----"

CHECKSUMS = [
    (checksums.valid_tfn, "100000001", "123456789"),
    (checksums.valid_abn, "51824753556", "51824753557"),
    (checksums.valid_acn, "000000019", "000000018"),
    (checksums.valid_medicare, "2123456701", "2123456711"),
    (checksums.valid_ihi, "8003600000000007", "8003600000000008"),
    (checksums.luhn, "4111111111111111", "4111111111111112"),
    (checksums.iban_valid, "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"),
]


def redact(spark, text, policy=None, detectors=None):
    df = spark.createDataFrame([(text,)], "text string")
    return engine.redact_text(df, "text", policy, detectors).first()["redaction"]


def redact_json(spark, document, policy=None, **options):
    raw = document if isinstance(document, str) or document is None else json.dumps(document)
    df = spark.createDataFrame([(raw,)], "raw string")
    return jsonwalk.redact_json(df, "raw", policy, **options).first()["redaction"]


@pytest.mark.parametrize("validator, good, bad", CHECKSUMS, ids=[c[0].__name__ for c in CHECKSUMS])
def test_checksums(spark, validator, good, bad):
    df = spark.createDataFrame([(good,), (bad,), (None,), ("",), ("x",)], "v string")
    result = [r[0] for r in df.select(F.expr(validator("v"))).collect()]
    assert result[0] is True
    assert not any(result[1:])


def test_eight_digit_tfn_counts_as_leading_zero(spark):
    weights = (1, 4, 3, 7, 5, 8, 6, 9, 10)
    valid = next(
        n for n in range(10_000_000, 10_001_000) if sum(int(d) * w for d, w in zip(f"0{n}", weights)) % 11 == 0
    )
    assert spark.range(1).select(F.expr(checksums.valid_tfn(f"'{valid}'"))).first()[0]


def test_regulated_identifiers_in_json(spark):
    r = redact_json(
        spark,
        {"tfn": "100000001", "abn": "51 824 753 556", "medicare": "2123 45670 1", "ihi": "8003600000000007", "crn": "123 456 789A"},
    )
    found = {f["detector"] for f in r["findings"]}
    assert {"au.tfn", "au.abn", "au.medicare", "au.ihi", "au.crn"} <= found
    document = json.loads(r["json"])
    assert document["tfn"] == "sha256:" + hashlib.sha256(b"100000001").hexdigest()
    assert document["abn"] == "51 824 753 556"
    assert r["privacy"]["actions"]["au.abn"] == "Allow"


def test_invalid_tfn_stays(spark):
    r = redact_json(spark, {"tfn": "123456789"})
    assert "123456789" in r["json"]
    assert "au.tfn" not in {f["detector"] for f in r["findings"]}


def test_secrets_are_removed(spark):
    r = redact_json(spark, {"awsKey": AWS, "token": JWT, "password": "do-not-store", "pem": PEM})
    for secret in (AWS, JWT, "do-not-store", "PRIVATE KEY"):
        assert secret not in r["json"]
    assert {"secret.aws", "secret.jwt", "crypto.material", "field-name-secret"} <= {f["detector"] for f in r["findings"]}
    assert "crypto.material:rsa-private" in r["privacy"]["detected"]


def test_api_key_providers(spark):
    keys = {
        "openai": "sk" + "-abcdefghijklmnopqrstuvwxyz12",
        "github": "gh" + "p_abcdefghijklmnopqrstuvwxyz0123456789",
        "stripe": "sk" + "_live_abcdefghijklmnopqrstuv",
    }
    kinds = {f["sub_kind"] for f in redact_json(spark, keys)["findings"] if f["detector"] == "secret.api-key"}
    assert {"OpenAI", "GitHub", "Stripe"} <= kinds


def test_card_removed_or_masked(spark):
    assert json.loads(redact_json(spark, {"pan": "4111111111111111"})["json"])["pan"] == ""
    masked = redact_json(spark, {"pan": "4111111111111111"}, PrivacyPolicy().with_actions(fin__credit_card=MASK))
    assert json.loads(masked["json"])["pan"] == "****-****-****-1111"


def test_disabled_detector_leaves_text(spark):
    r = redact_json(spark, {"owner": "alice@example.test"}, PrivacyPolicy(disabled=frozenset({"id.email"})))
    assert json.loads(r["json"])["owner"] == "alice@example.test"


def test_nested_paths(spark):
    r = redact_json(
        spark,
        {"actor": {"email": "alice@example.test", "password": "p"}, "http": {"request": {"headers": {"Authorization": "b"}}}},
    )
    assert r["removed_paths"] == ["$.actor.password", "$.http.request.headers"]
    assert r["masked_paths"] == ["$.actor.email"]


@pytest.mark.parametrize(
    "raw, code", [("", "empty-payload"), (None, "empty-payload"), ("[]", "root-must-be-object"), ("{ invalid", "invalid-json"),
                  ('{"a":' * 33 + "1" + "}" * 33, "invalid-json")]
)
def test_failures(spark, raw, code):
    r = redact_json(spark, raw)
    assert (r["succeeded"], r["failure_code"], r["json"]) == (False, code, None)


def test_long_texts_are_scanned_unless_limited(spark):
    text = "a " * 600_000 + "bob@example.org"
    df = spark.createDataFrame([(1, text), (2, "x")], "id int, t string")
    assert [(r.id, r.start) for r in engine.find_sensitive(df, "id", "t").collect()] == [(1, 1_200_000)]
    limited = engine.redact_text(df, "t", max_bytes=1_000).orderBy("id").select("redaction.*").collect()
    assert [(r.failure_code, r.text) for r in limited] == [("payload-too-large", None), (None, "x")]


CHAINS = {
    "names": "A_" * 10_000 + "=x", "labels": "a." * 10_000, "digits": "1" * 60_000, "at": "@" * 60_000,
    "keys": "-----BEGIN RSA PRIVATE KEY-----" + "A" * 60_000, "words": "Password " * 8_000, "mails": "a@" * 30_000,
}


def test_hostile_texts_do_not_end_the_executor(spark):
    """With every detector on; good rows beside them still give their findings."""
    detectors = list(builtin_detectors())
    policy = PrivacyPolicy(enabled_opt_in=OPT_IN_DETECTORS)
    rows = [(name, text) for name, text in CHAINS.items()] + [("good", "mail bob@example.org")]
    df = spark.createDataFrame(rows, "id string, t string").repartition(4)
    found = engine.find_sensitive(df, "id", "t", policy, detectors).where("id = 'good'").collect()
    assert "id.email" in {r.detector for r in found}


@pytest.mark.parametrize("raw, want", [
    ('{"a":"\\ud800 x","mail":"bob@example.org"}', '\\ud800 x'),
    ('{"a":"\\u000012\\u0000","mail":"bob@example.org"}', '\\u000012\\u0000'),
    ('{"a":"\ue0001.5\ue000","n":1.50,"mail":"bob@example.org"}', '"n":1.50'),
])
def test_odd_characters_survive_edits(spark, raw, want):
    r = redact_json(spark, raw)
    assert r["succeeded"] and want in r["json"] and "bob@" not in r["json"]


def test_filters_reach_the_scan(spark, tmp_path):
    """A filter on a column that an operator passes through is pushed below it."""
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "'x' AS source", "'{\"a\":1}' AS raw").write.parquet(path)
    df = spark.read.parquet(path)
    now = "timestamp'2024-01-01 00:00:00Z'"
    plans = {
        "text": engine.redact_text(df, "raw"),
        "json": jsonwalk.redact_json(df, "raw"),
        "normalise": normalise.normalise(df, "CrowdStrike", now),
        "aws": aws.map_aws(df, "guardduty", aws.AwsOptions("s"), now),
        "candidates": with_candidate_status(df),
    }
    for name, plan in plans.items():
        text = plan.where("source = 'y' AND id = 5")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(source,y)" in text and "EqualTo(id,5)" in text, name


def test_numbers_and_nested_arrays_are_not_scanned_unless_strict(spark):
    document = {"n": 4111111111111111, "x": [["a@b.org"], "c@d.org"], "f": 8.0}
    plain = json.loads(redact_json(spark, document)["json"])
    assert plain["x"] == [["a@b.org"], "c***@d.org"] and plain["n"] == 4111111111111111
    assert '"f":8.0' in redact_json(spark, document)["json"]
    strict = json.loads(redact_json(spark, document, strict=True)["json"])
    assert strict["x"] == [["a***@b.org"], "c***@d.org"]


def test_edits_survive_astral_characters_and_byte_order_marks(spark):
    text = "﻿😀 a@b.org 😀﻿ c@d.org é"
    assert redact(spark, text)["text"] == "﻿😀 a***@b.org 😀﻿ c***@d.org é"


def test_replace_hmac_and_encrypt(spark):
    key = bytes(range(32))
    base = PrivacyPolicy(hmac_key=key, encryption_key=key)
    assert redact(spark, "a@b.org", base.with_actions(id__email=REPLACE))["text"] == "***REDACTED***"
    keyed = redact(spark, "a@b.org", base.with_actions(id__email=HMAC))["text"]
    assert keyed == "hmac-sha256:" + hmac.new(key, b"a@b.org", hashlib.sha256).hexdigest()
    token = redact(spark, "a@b.org", base.with_actions(id__email=ENCRYPT))["text"]
    assert token.startswith("enc:aesgcm:")
    assert spark.range(1).select(F.expr(tokens.decrypt_token(f"'{token}'", key))).first()[0] == "a@b.org"
    assert redact(spark, "a@b.org", PrivacyPolicy().with_actions(id__email=ENCRYPT))["text"] == ""
    assert redact(spark, "a@b.org", PrivacyPolicy().with_actions(id__email=HMAC))["text"].startswith("sha256:")


def test_custom_detector_and_unique_ids(spark):
    catalogue = register_detector(builtin_detectors(), "x.badge", r"\bB-\d{4}\b")
    assert "B-1234" not in redact(spark, "badge B-1234", None, catalogue)["text"]
    with pytest.raises(ValueError):
        register_detector(catalogue, "x.badge", "x")


def test_text_path_has_no_python_node(spark):
    df = engine.redact_text(spark.createDataFrame([("a@b.org",)], "text string"), "text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def brute_force(text, policy, detectors):
    """Selected spans by the rules, with plain regular expressions."""
    spans = []
    for order, d in enumerate(detectors):
        for m in re.finditer(d.pattern.replace("(?i:aws_secret_access_key)", "[Aa][Ww][Ss]_secret_access_key") if "(?i:aws" in d.pattern else d.pattern, text):
            value = next((g for g in d.groups if m.group(g)), 0)
            digits = re.sub("[^0-9]", "", m.group(value))
            if d.id == "au.tfn":
                w = (1, 4, 3, 7, 5, 8, 6, 9, 10)
                if len(digits) not in (8, 9) or sum(int(c) * k for c, k in zip(digits.zfill(9), w)) % 11:
                    continue
            spans.append((-(m.end(value) - m.start(value)), m.start(value), order))
    kept = []
    for size, start, order in sorted(spans):
        if all(start >= s - n or s >= start - size for n, s, _ in kept):
            kept.append((size, start, order))
    return sorted((s, -n, o) for n, s, o in kept)


def test_spans_match_brute_force(spark):
    names = ("au.tfn", "au.crn", "id.email", "id.phone.au", "id.ip", "id.hostname", "fin.bsb-account", "id.dob")
    detectors = [d for d in builtin_detectors() if d.id in names]
    policy = PrivacyPolicy(enabled_opt_in=OPT_IN_DETECTORS)
    rng = random.Random(7)
    parts = ["a@b.org", "x.y@h1.corp", "100000001", "123 456 789A", "0412 345 678", "10.1.2.3", "www.example.com", "DOB: 1/2/1990",
             "123-456 account 12345678", " ", ", ", "é", "😀", "9", "-", "61 2 1234 5678", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = engine.scan_text(df, "text", policy, detectors).collect()
    for row in rows:
        ours = [(s["start"], s["size"], s["ord"]) for s in row["_spans"]]
        assert ours == brute_force(row["text"], policy, detectors), row["text"]


def test_many_hits_in_one_value(spark):
    text = " ".join(f"user{i}@example.org" for i in range(3_000))
    r = redact(spark, text)
    assert len(r["findings"]) == 3_000
    assert r["text"] == " ".join("u***@example.org" for _ in range(3_000))
