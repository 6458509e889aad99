"""Registered queries over text: detectors, redaction, summaries, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions import checksums, tokens
from telemill.functions.text import field_key, safe_stem
from telemill.operators.privacy import engine
from telemill.operators.privacy.detectors import builtin_detectors, register_detector
from telemill.operators.privacy.policy import OPT_IN_DETECTORS, PrivacyPolicy
from telemill.plans.inputs import table

ALL = PrivacyPolicy(enabled_opt_in=OPT_IN_DETECTORS)
BY_ID = {d.id: d for d in builtin_detectors()}

# Number of a row with n digits, spread by a large factor; the same text in Spark and in the oracle.
def _num(n: int, factor: int = 7919, offset: int = 100000001) -> str:
    return f"lpad(CAST((o_orderkey * {factor} + {offset}) % {10**n} AS STRING), {n}, '0')"


MEDICARE = _num(10, 123457, 2123456701)
KEY40 = "sha256(CAST(o_orderkey AS STRING))"

# Text of an order note that gives each detector something to find and something to refuse.
NOTE_TEXTS = {
    "au.tfn": f"'ref TFN: ' || {_num(9)} || ' or ' || {_num(8)} || ' end'",
    "au.crn": f"'CRN ' || {_num(9)} || 'K and ' || {_num(9)} || ' K'",
    "au.medicare": f"'card ' || substr({MEDICARE}, 1, 4) || ' ' || substr({MEDICARE}, 5, 5) || ' ' || substr({MEDICARE}, 10, 1) || '.'",
    "au.ihi": f"'ihi 800360' || {_num(10)} || ' x'",
    "au.passport": f"CASE WHEN o_orderkey % 3 = 0 THEN 'Passport no: N' ELSE 'code N' END || {_num(7)} || ' then PA' || {_num(7)}",
    "au.driver-licence": f"CASE WHEN o_orderkey % 3 = 0 THEN 'Licence ' ELSE 'number ' END || {_num(8)} || ' / AB' || {_num(6)}",
    "au.abn": f"'abn ' || substr({_num(11)}, 1, 2) || ' ' || substr({_num(11)}, 3, 3) || ' ' || substr({_num(11)}, 6, 3) || ' ' || substr({_num(11)}, 9, 3)",
    "au.acn": f"'acn ' || {_num(9)} || ', ' || {_num(9, 104729)}",
    "au.dva": f"'DVA: QX' || {_num(6)} || 'A, W1234 n' || {_num(4)}",
    "fin.credit-card": f"'paid 4' || {_num(15)} || ' or 51' || {_num(14)} || ' done'",
    "fin.bsb-account": f"'bsb ' || substr({_num(6)}, 1, 3) || '-' || substr({_num(6)}, 4, 3) || ' account ' || {_num(8)}",
    "fin.iban": f"'iban DE' || {_num(2, 31, 7)} || '37040044' || {_num(10)} || ' sent'",
    "fin.swift-bic": "'bic DEUTDEFF and ' || o_orderpriority || ' NOTASWIFTCODE ' || CASE WHEN o_orderstatus = 'F' THEN 'ABCDEF12345' ELSE '' END",
    "fin.payid": "'PayID: user' || CAST(o_orderkey AS STRING) || '@bank.example rest'",
    "id.email": "'to User' || CAST(o_custkey AS STRING) || '@Example.org;b.c@d.co, no@dot'",
    "id.phone.au": f"'call 04' || {_num(8)} || ' or +61 2 ' || {_num(8)} || ' or 0' || {_num(9)}",
    "id.phone.intl": f"'x+' || CAST(1 + o_orderkey % 9 AS STRING) || {_num(9)} || ' +4912345678'",
    "id.dob": "'DOB: ' || CAST(1 + o_orderkey % 28 AS STRING) || '/0' || CAST(1 + o_orderkey % 9 AS STRING) || '/1990 born 1.2.88'",
    "id.address": "'at ' || CAST(o_custkey AS STRING) || ' Long Hill Road, or 5 Main St now'",
    "id.gps": f"'at 33.' || {_num(5)} || ', 151.' || {_num(4)} || ' ok'",
    "id.ip": "'from 10.' || CAST(o_custkey % 300 AS STRING) || '.' || CAST(o_orderkey % 256 AS STRING) || '.7 to 1.2.3'",
    "id.hostname": "'host h' || CAST(o_custkey AS STRING) || '.corp and www.example.com or a.b'",
    "id.username": "'username: user_' || CAST(o_custkey AS STRING) || ' login=x1'",
    "secret.aws": f"'key AKIA' || upper(substr({KEY40}, 1, 16)) || ' AKIAshort'",
    "secret.azure": f"'AccountKey=' || {KEY40} || '== and sig=abc'",
    "secret.entra": f"'v abc8Q~' || substr({KEY40}, 1, 34) || ' end'",
    "secret.gcp": f"'AIza' || substr({KEY40}, 1, 35) || ' AIzaX'",
    "secret.jwt": f"'t eyJ' || substr({KEY40}, 1, 10) || '.eyJ' || substr({KEY40}, 5, 10) || '.s' || substr({KEY40}, 3, 8)",
    "secret.oauth": f"'Authorization Bearer ' || {KEY40} || ' x'",
    "secret.api-key": f"'use sk' || '-' || substr({KEY40}, 1, 24) || ' gh' || 'p_' || substr({KEY40}, 1, 38)",
    "secret.kubernetes": f"'client-key-data: ' || {KEY40}",
    "secret.docker": f"'dckr_pat' || '_' || substr({KEY40}, 1, 27) || ' y'",
    "secret.database": "'postgres://u' || CAST(o_custkey AS STRING) || ':pw@db.example/x and mysql://h/x'",
    "secret.env-var": "'DB_PASSWORD=pw' || CAST(o_orderkey AS STRING) || ' USER=x'",
    "crypto.material": f"'k -----BEGIN RSA PRIVATE KEY-----' || {KEY40} || '-----END RSA PRIVATE KEY----- t'",
    "class.security-marking": "'marked ' || CASE WHEN o_orderstatus = 'F' THEN 'Top Secret' WHEN o_orderstatus = 'O' THEN 'OFFICIAL: Sensitive' ELSE 'none' END",
}


# Oracle conditions on a value ``v``; digits are taken from it first.
def _digits(v: str = "v") -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def _weighted(d: str, weights) -> str:
    return "(" + " + ".join(f"CAST(substr({d}, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights, 1)) + ")"


def _luhn(d: str) -> str:
    return (
        f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 "
        f"THEN CAST(substr({d}, i, 1) AS INTEGER) "
        f"ELSE (CAST(substr({d}, i, 1) AS INTEGER) * 2) % 10 + (CAST(substr({d}, i, 1) AS INTEGER) * 2) // 10 END)) % 10 = 0)"
    )


def _network(d: str) -> str:
    return (
        f"CASE WHEN {d}[1] = '4' AND length({d}) IN (13, 16, 19) THEN 'Visa' "
        f"WHEN length({d}) = 16 AND ({d}[1:2] BETWEEN '51' AND '55' OR {d}[1:4] BETWEEN '2221' AND '2720') THEN 'Mastercard' "
        f"WHEN length({d}) = 16 AND ({d}[1:4] = '6011' OR {d}[1:2] = '65') THEN 'Discover' "
        f"WHEN length({d}) = 16 AND {d}[1:2] = '35' THEN 'JCB' "
        f"WHEN length({d}) = 15 AND {d}[1:2] IN ('34', '37') THEN 'Amex' "
        f"WHEN length({d}) IN (14, 16) AND ({d}[1:2] IN ('36', '38') OR {d}[1:3] = '300') THEN 'Diners' END"
    )


def _tfn(d: str) -> str:
    return f"(length({d}) IN (8, 9) AND {_weighted(f'lpad({d}, 9, chr(48))', checksums.TFN_WEIGHTS)} % 11 = 0)"


def _iban(v: str) -> str:
    # The number's remainder piece by piece: every letter is two digits.
    return (
        f"(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(upper({v})[5:] || upper({v})[1:4], ''), "
        "lambda ch: CAST(CASE WHEN ascii(ch) < 58 THEN ascii(ch) - 48 ELSE ascii(ch) - 55 END AS BIGINT))), "
        "lambda t, x: (t * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1)"
    )


ORACLE_ACCEPT = {
    "au.tfn": _tfn(_digits()),
    "au.medicare": f"({_digits()}[1] BETWEEN '2' AND '6' AND {_digits()}[10] <> '0' AND {_weighted(_digits(), checksums.MEDICARE_WEIGHTS)} % 10 = CAST({_digits()}[9] AS INTEGER))",
    "au.ihi": _luhn("v"),
    "au.abn": f"(({_weighted(_digits(), checksums.ABN_WEIGHTS)} - 10) % 89 = 0)",
    "au.acn": f"((10 - {_weighted(_digits(), checksums.ACN_WEIGHTS)} % 10) % 10 = CAST({_digits()}[9] AS INTEGER))",
    "fin.credit-card": f"({_luhn(_digits())} AND {_network(_digits())} IS NOT NULL)",
    "fin.iban": _iban("v"),
}
ORACLE_GATE = {
    "au.passport": "regexp_matches(note, '(?i)passport')",
    "au.driver-licence": "regexp_matches(note, '(?i)licence|license|driver|DLN')",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(pattern: str) -> str:
    """A pattern for an engine that bounds nested repetitions: its own bound is far above any input."""
    return pattern.replace("{1,127}", "+")


def notes(spark: SparkSession, sf_dir: str, detector_id: str) -> DataFrame:
    """``o_orderkey, note``: an order note for one detector."""
    # sha256(x) of the oracle is sha2(x, 256) here.
    text = NOTE_TEXTS[detector_id].replace("sha256(CAST(o_orderkey AS STRING))", "sha2(CAST(o_orderkey AS STRING), 256)")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("note"))


def detector_query(detector_id: str):
    """What one detector finds in every order note."""
    detector = BY_ID[detector_id]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = engine.scan_text(notes(spark, sf_dir, detector_id), "note", ALL, [detector])
        values = "transform(_spans, s -> substring(note, s.start + 1, s.size))"
        return found.filter("size(_spans) > 0").select(
            "o_orderkey",
            F.expr("cast(size(_spans) AS bigint)").alias("hits"),
            F.expr(f"array_join({values}, '|')").alias("values"),
            F.expr("array_join(transform(_spans, s -> coalesce(s.sub_kind, '-')), '|')").alias("kinds")
            if detector_id == "fin.credit-card"
            else F.lit("-").alias("kinds"),
        )

    return run


def detector_oracle(detector_id: str) -> str:
    """The same with RE2 patterns and list functions."""
    detector = BY_ID[detector_id]
    pattern = _quoted(_plain(detector.pattern))
    if len(detector.groups) == 2:
        a, b = (f"regexp_extract_all(note, {pattern}, {g})" for g in detector.groups)
        values = f"list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN coalesce({a}[i], '') <> '' THEN {a}[i] ELSE {b}[i] END)"
    else:
        values = f"regexp_extract_all(note, {pattern}, {detector.groups[0] if detector.groups else 0})"
    gate = ORACLE_GATE.get(detector_id, "true")
    accept = ORACLE_ACCEPT.get(detector_id, "true")
    if detector_id == "au.dva":
        accept = "true"  # every note names the label
    kinds = "'-'"
    if detector_id == "fin.credit-card":
        kinds = f"array_to_string(list_transform(vs, lambda v: {_network(_digits())}), '|')"
    return f"""
        WITH n AS (SELECT o_orderkey, {NOTE_TEXTS[detector_id]} AS note FROM orders),
        f AS (SELECT o_orderkey, list_filter({values}, lambda v: {accept}) AS vs FROM n WHERE {gate})
        SELECT o_orderkey, len(vs) AS hits, array_to_string(vs, '|') AS "values", {kinds} AS kinds FROM f WHERE len(vs) > 0
    """


CARD_AND_MAIL = [BY_ID["fin.credit-card"], BY_ID["id.email"]]


def documents_findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail and card findings in all documents by source (the flagship)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = engine.find_sensitive(docs, ["doc_id", "source"], "text", detectors=CARD_AND_MAIL)
    return engine.findings_summary(found, "doc_id", ["source"])


_CARDS = "list_filter(regexp_extract_all(text, {p}, 0), lambda v: {ok})".format(
    p=_quoted(BY_ID["fin.credit-card"].pattern), ok=ORACLE_ACCEPT["fin.credit-card"]
)
_MAILS = f"regexp_extract_all(text, {_quoted(BY_ID['id.email'].pattern)}, 0)"

DOCUMENTS_SUMMARY_SQL = f"""
    WITH f AS (
      SELECT doc_id, source, 'fin.credit-card' AS detector, 'financial' AS category, 'Remove' AS action, len({_CARDS}) AS n FROM documents
      UNION ALL
      SELECT doc_id, source, 'id.email', 'identity', 'Mask', len({_MAILS}) FROM documents
    )
    SELECT source, detector, category, action, CAST(sum(n) AS BIGINT) AS findings, count(*) AS documents
    FROM f WHERE n > 0 GROUP BY source, detector, category, action
"""


def documents_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with cards removed and e-mail addresses masked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return engine.redact_text(docs, "text", detectors=CARD_AND_MAIL).select(
        "doc_id", "redaction.succeeded", F.md5("redaction.text").alias("digest"), F.length("redaction.text").cast("bigint").alias("chars")
    )


# A removed card is cut out where its exact match stands; masking addresses is one replacement.
DOCUMENTS_REDACTED_SQL = f"""
    WITH r AS (
      SELECT doc_id, octet_length(encode(text)) AS size, list_reduce(list_prepend(text, {_CARDS}), lambda t, m: replace(t, m, '')) AS t FROM documents
    ), m AS (
      SELECT doc_id, size, regexp_replace(t, '(?i)([A-Z0-9._%+\\-])[A-Z0-9._%+\\-]*(@[A-Z0-9.\\-]+\\.[A-Z]{{2,}})', '\\1***\\2', 'g') AS t FROM r
    )
    SELECT doc_id, true AS succeeded, md5(t) AS digest, length(t) AS chars FROM m
"""


def documents_all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every default detector over all documents, overlaps resolved."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return engine.findings_summary(engine.find_sensitive(docs, "doc_id", "text"), "doc_id")


def conversations_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Privacy metadata of all conversation turns and documents that hold a card or an address."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS conv_id", "-1L AS turn", "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(docs)
    done = engine.redact_text(turns, "text", detectors=CARD_AND_MAIL)
    return done.filter("size(redaction.findings) > 0").select(
        "conv_id", "turn", F.array_join("redaction.privacy.detected", ",").alias("detected"),
        F.expr("array_join(transform(map_entries(redaction.privacy.actions), e -> concat(e.key, '=', e.value)), ',')").alias("actions"),
    )


CONVERSATIONS_SQL = f"""
    WITH f AS (
      SELECT conv_id, turn,
        list_sort(list_distinct(list_transform({_CARDS}, lambda v: 'fin.credit-card:' || {_network(_digits())}))) AS cards,
        CASE WHEN len({_MAILS}) > 0 THEN ['id.email'] ELSE [] END AS mails
      FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT doc_id, -1, text FROM documents)
    )
    SELECT conv_id, turn, array_to_string(list_concat(cards, mails), ',') AS detected,
      array_to_string(list_concat(CASE WHEN len(cards) > 0 THEN ['fin.credit-card=Removed'] ELSE [] END,
        CASE WHEN len(mails) > 0 THEN ['id.email=Masked'] ELSE [] END), ',') AS actions
    FROM f WHERE len(cards) + len(mails) > 0
"""


def pages_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hostnames in page URLs and HTML."""
    pages = table(spark, sf_dir, "pages")
    policy = PrivacyPolicy(enabled_opt_in=frozenset({"id.hostname"}))
    found = engine.find_sensitive(
        pages.select("page_id", F.concat_ws(" ", "url", "html").alias("body")), "page_id", "body", policy, [BY_ID["id.hostname"]]
    )
    return found.groupBy("page_id").agg(F.count("*").alias("hosts"), F.sum("size").cast("bigint").alias("chars"))


_HOSTS = f"regexp_extract_all(url || ' ' || html, {_quoted(_plain(BY_ID['id.hostname'].pattern))}, 0)"
PAGES_SQL = f"""
    SELECT page_id, len(h) AS hosts, CAST(list_sum(list_transform(h, lambda x: length(x))) AS BIGINT) AS chars
    FROM (SELECT page_id, {_HOSTS} AS h FROM pages) WHERE len(h) > 0
"""


def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest match wins where three overlapping detectors see the same digits."""
    catalogue = ()
    for name, pattern in (("x.four", r"\d{4}"), ("x.six", r"\d{6}"), ("x.tail", r"\d{2}-\d{3}")):
        catalogue = register_detector(catalogue, name, pattern)
    text = f"'n ' || {_num(6)} || '-' || {_num(4)} || ' z'"
    notes_ = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("note"))
    done = engine.redact_text(notes_, "note", PrivacyPolicy(), catalogue)
    return done.select(
        "o_orderkey", F.expr("array_join(transform(redaction.findings, f -> f.detector), ',')").alias("kept"),
        F.col("redaction.text").alias("text"),
    )


# Six digits beat the five-character tail and the four-digit prefix; the last four digits stand alone.
OVERLAP_SQL = f"""
    SELECT o_orderkey, 'x.six,x.four' AS kept,
      'n ' || substr({_num(6)}, 1, 2) || '**' || substr({_num(6)}, 5, 2) || '-**** z' AS text
    FROM orders
"""


def action_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every replacing action on the same value."""
    key = bytes(range(32))
    done = notes(spark, sf_dir, "id.email").select("o_orderkey", F.expr("substring(note, 4)").alias("value"))
    first = "regexp_extract(value, '^[^;]+', 0)"
    return done.select(
        "o_orderkey",
        F.expr(engine.mask_for(first, "id.email")).alias("masked"),
        F.expr(tokens.mask_middle(first)).alias("middle"),
        F.expr(tokens.sha256_token(first)).alias("hashed"),
        F.expr(tokens.hmac_token(first, key)).alias("keyed"),
        F.expr(tokens.decrypt_token(tokens.encrypt_token(first, key), key) + f" = {first}").alias("decrypts"),
        F.expr(tokens.mask_card("concat('4', lpad(cast(o_orderkey AS string), 15, '0'))")).alias("card"),
        F.expr(tokens.mask_digits("lpad(cast(o_orderkey AS string), 9, '0')")).alias("digits"),
    )


_INNER = "from_hex('" + "".join(f"{b ^ 0x36:02x}" for b in bytes(range(32)).ljust(64, b"\0")) + "')"
_OUTER = "from_hex('" + "".join(f"{b ^ 0x5C:02x}" for b in bytes(range(32)).ljust(64, b"\0")) + "')"
ACTION_SQL = f"""
    WITH v AS (SELECT o_orderkey, 'User' || CAST(o_custkey AS VARCHAR) || '@Example.org' AS v FROM orders)
    SELECT o_orderkey, 'U***@Example.org' AS masked,
      substr(v, 1, 2) || repeat('*', CAST(length(v) - 4 AS INTEGER)) || right(v, 2) AS middle,
      'sha256:' || sha256(v) AS hashed,
      'hmac-sha256:' || sha256({_OUTER} || from_hex(sha256({_INNER} || encode(v)))) AS keyed,
      true AS decrypts,
      '****-****-****-' || right(lpad(CAST(o_orderkey AS VARCHAR), 15, '0'), 4) AS card,
      '*****' || right(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 4) AS digits
    FROM v
"""


def checksum_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checksum validators over numbers made from every order key."""
    o = table(spark, sf_dir, "orders")
    n = {k: _num(k) for k in (9, 10, 11, 16)}
    ihi = f"'800360' || {_num(10)}"
    return o.select(
        "o_orderkey",
        F.expr(checksums.valid_tfn(f"({n[9]})")).alias("tfn"),
        F.expr(checksums.valid_abn(f"({n[11]})")).alias("abn"),
        F.expr(checksums.valid_acn(f"({n[9]})")).alias("acn"),
        F.expr(checksums.valid_medicare(f"({MEDICARE})")).alias("medicare"),
        F.expr(checksums.valid_ihi(f"({ihi})")).alias("ihi"),
        F.expr(checksums.luhn(f"({n[16]})")).alias("luhn"),
        F.expr(checksums.iban_valid(f"('DE' || {_num(2, 31, 7)} || '37040044' || {_num(10)})")).alias("iban"),
        F.expr(f"cast({checksums.count_digits('o_orderpriority')} AS bigint)").alias("digits"),
    )


CHECKSUM_SQL = f"""
    SELECT o_orderkey, {_tfn(_num(9))} AS tfn,
      (({_weighted(_num(11), checksums.ABN_WEIGHTS)} - 10) % 89 = 0) AS abn,
      ((10 - {_weighted(_num(9), checksums.ACN_WEIGHTS)} % 10) % 10 = CAST(substr({_num(9)}, 9, 1) AS INTEGER)) AS acn,
      (substr({MEDICARE}, 1, 1) BETWEEN '2' AND '6' AND substr({MEDICARE}, 10, 1) <> '0'
        AND {_weighted(MEDICARE, checksums.MEDICARE_WEIGHTS)} % 10 = CAST(substr({MEDICARE}, 9, 1) AS INTEGER)) AS medicare,
      {_luhn("('800360' || " + _num(10) + ")")} AS ihi,
      {_luhn("(" + _num(16) + ")")} AS luhn,
      {_iban("('DE' || " + _num(2, 31, 7) + " || '37040044' || " + _num(10) + ")")} AS iban,
      length(regexp_replace(o_orderpriority, '[^0-9]', '', 'g')) AS digits
    FROM orders
"""


def legacy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents in the older shape, counted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = engine.legacy_findings(engine.find_sensitive(docs, "doc_id", "text", detectors=CARD_AND_MAIL))
    return found.groupBy("kind", "legacy_action", "preview").agg(F.count("*").alias("findings"))


LEGACY_SQL = f"""
    SELECT kind, legacy_action, '***' AS preview, CAST(sum(n) AS BIGINT) AS findings FROM (
      SELECT 'CreditCard' AS kind, 'removed' AS legacy_action, len({_CARDS}) AS n FROM documents
      UNION ALL SELECT 'Email', 'masked', len({_MAILS}) FROM documents
    ) GROUP BY kind, legacy_action HAVING sum(n) > 0
"""


def names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name normalisation and file stems."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", F.expr(field_key("concat(c_name, '_Ä.', c_mktsegment)")).alias("key"), F.expr(safe_stem("c_name")).alias("stem")
    )


NAMES_SQL = """
    SELECT c_custkey, lower(replace(c_name, '#', '')) || 'ä' || lower(c_mktsegment) AS key, replace(c_name, '#', '_') AS stem FROM customer
"""


def build() -> dict:
    """Query name to (callable, oracle SQL or None)."""
    found = {
        f"detect_{name.replace('.', '_').replace('-', '_')}": (detector_query(name), detector_oracle(name)) for name in NOTE_TEXTS
    }
    return found | {
        "documents_findings_summary": (documents_findings_summary, DOCUMENTS_SUMMARY_SQL),
        "documents_redacted": (documents_redacted, DOCUMENTS_REDACTED_SQL),
        "documents_all_findings": (documents_all_findings, None),
        "privacy_metadata": (conversations_metadata, CONVERSATIONS_SQL),
        "pages_hostnames": (pages_hosts, PAGES_SQL),
        "overlap_resolution": (overlap_resolution, OVERLAP_SQL),
        "redaction_actions": (action_query, ACTION_SQL),
        "checksum_functions": (checksum_query, CHECKSUM_SQL),
        "legacy_findings": (legacy_query, LEGACY_SQL),
        "name_functions": (names_query, NAMES_SQL),
    }
