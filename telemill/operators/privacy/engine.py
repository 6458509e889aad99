"""Find and redact sensitive values in string columns with Catalyst expressions only.

For one detector ``regexp_extract_all`` yields the matches and ``split`` by the same pattern the text
between them; both lists interleave, so offsets follow from their lengths. The spans of all enabled
detectors are merged, overlaps resolved (longest first) and the text rebuilt once.

A column that carries a scan is a struct; read its fields rather than calling :func:`scan` twice.
Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions import tokens
from telemill.functions.sqltext import let, lit, lits, lookup, once, prefix_maxima, prefix_sums, struct, when
from telemill.operators.privacy import policy as pol
from telemill.operators.privacy.detectors import Detector, builtin_detectors
from telemill.operators.privacy.policy import PrivacyPolicy

SPAN = "struct<start:int,size:int,ord:int,sub_kind:string,edit:string>"
NO_SPANS = f"cast(array() AS array<{SPAN}>)"

# Mask by detector; all others keep two characters at each end.
DIGIT_MASKED = ("au.tfn", "au.medicare", "au.ihi", "au.crn", "au.abn", "au.acn", "fin.bsb-account")


def mask_for(value: str, detector_id: str) -> str:
    """Masked form of a value found by the detector."""
    if detector_id == "id.email":
        return tokens.mask_email(value)
    if detector_id == "fin.credit-card":
        return tokens.mask_card(value)
    if detector_id in DIGIT_MASKED:
        return tokens.mask_digits(value)
    return tokens.mask_middle(value)


def action_sql(value: str, detector_id: str, policy: PrivacyPolicy) -> str:
    """Replacement of a value; null means that the text stays as it is."""
    action = policy.action_for(detector_id)
    if action in pol.UNCHANGED_ACTIONS:
        return "cast(NULL AS string)"
    if action == pol.REMOVE:
        return "''"
    if action == pol.MASK:
        return mask_for(value, detector_id)
    if action == pol.SHA256:
        return tokens.sha256_token(value)
    if action == pol.HMAC:
        return tokens.hmac_token(value, policy.hmac_key)
    if action == pol.ENCRYPT:
        return tokens.encrypt_token(value, policy.encryption_key)
    return lit(policy.replacement)


def enabled_detectors(policy: PrivacyPolicy, detectors: Sequence[Detector] | None = None) -> list[tuple[int, Detector]]:
    """Detectors that take part, with their catalogue position."""
    catalogue = builtin_detectors() if detectors is None else detectors
    return [(i, d) for i, d in enumerate(catalogue) if policy.enabled(d.id)]


def may_match(text: str, detector: Detector, shapes: Sequence[str]) -> str:
    """Condition that every text with a match fulfils; ``known`` holds what was worked out before."""
    tests = []
    if detector.words:
        tests.append("(" + " OR ".join(f"contains(known.lowered, {lit(w)})" for w in detector.words) + ")")
    if detector.shape:
        tests.append(f"known.shape_{shapes.index(detector.shape)}")
    if detector.gate is not None:
        tests.append(detector.gate(text))
    return " AND ".join(tests)


def detector_spans(text: str, detector: Detector, order: int, policy: PrivacyPolicy) -> str:
    """Spans one detector accepts, in text order; the gate and the cheap conditions are not applied."""
    if detector.locate is not None:
        return let("hits", detector.locate(text), f"IF(size(hits) = 0, {NO_SPANS}, {_spans_of('hits', text, detector, order, policy)})")
    pattern = lit(detector.java_pattern)

    def found(group: int) -> str:
        return f"regexp_extract_all({text}, {pattern}, {group})"

    if not detector.groups:
        values = "wholes"
    elif len(detector.groups) == 1:
        values = found(detector.groups[0])
    else:
        first, second = detector.groups
        values = f"zip_with({found(first)}, {found(second)}, (g1, g2) -> IF(g1 <> '', g1, g2))"

    # The text before a match and the match itself; their lengths add up to where the match ends.
    gaps = f"slice(split({text}, {pattern}, -1), 1, size(wholes))"
    ends = prefix_sums(f"zip_with({gaps}, wholes, (g, w) -> length(g) + length(w))")
    hits = f"zip_with(zip_with(wholes, {values}, (w, v) -> named_struct('whole', w, 'value', v)), {ends}, (h, e) -> named_struct('whole', h.whole, 'value', h.value, 'upto', e))"
    return let("wholes", found(0), f"IF(size(wholes) = 0, {NO_SPANS}, {_spans_of(hits, text, detector, order, policy)})")


def _spans_of(hits: str, text: str, detector: Detector, order: int, policy: PrivacyPolicy) -> str:
    """The spans of the accepted hits, ``struct<whole, value, upto>``."""
    sub_kind = detector.sub_kind("hit.value") if detector.sub_kind else "cast(NULL AS string)"
    span = struct(
        start="hit.upto - length(hit.value)",
        size="length(hit.value)",
        ord=str(order),
        sub_kind=f"cast({sub_kind} AS string)",
        edit=action_sql("hit.value", detector.id, policy),
    )
    if detector.accept is not None:
        hits = f"filter({hits}, hit -> {detector.accept('hit.value', 'hit.whole', text)})"
    return f"transform({hits}, hit -> cast({span} AS {SPAN}))"


def resolve_overlaps(spans: str) -> str:
    """Greedy choice of non-overlapping spans: longest first, then leftmost, then catalogue order.

    Sorted spans are cut into runs where one begins behind all before it; a run of one needs no choice, and the
    greedy choice inside a run never has to look at spans outside it.
    """
    clash = "exists(chosen, c -> c.start < item.s.start + item.s.size AND item.s.start < c.start + c.size)"
    choose = (
        "array_sort(aggregate("
        "array_sort(transform(run, s -> named_struct('k1', -s.size, 'k2', s.start, 'k3', s.ord, 's', s))), "
        f"{NO_SPANS}, (chosen, item) -> IF({clash}, chosen, concat(chosen, array(item.s)))))"
    )
    ends = prefix_maxima("transform(sorted, s -> s.start + s.size)")
    heads = "filter(sequence(0, size(sorted) - 1), i -> i = 0 OR get(sorted, i).start >= get(tops, i - 1))"
    runs = "transform(heads, (i, k) -> slice(sorted, i + 1, coalesce(get(heads, k + 1), size(sorted)) - i))"
    settled = f"flatten(transform({runs}, run -> IF(size(run) = 1, run, {choose})))"
    cut = let("tops", ends, let("heads", heads, f"IF(size(heads) = size(sorted), sorted, {settled})"))
    return let("sorted", f"array_sort({spans})", cut)


def apply_edits(text: str, spans: str) -> str:
    """Text with every span that has an edit replaced.

    The text is turned into fixed-width UTF-32 once, so that cutting out a piece costs its own length
    and not its distance from the start.
    """

    def piece(begin: str, size: str) -> str:
        # A leading byte-order mark is put in front and consumed, so one in the text survives.
        return f"decode(concat(X'0000FEFF', substring(wide, ({begin}) * 4 + 1, {size})), 'UTF-32')"

    before = "IF(i = 0, 0, get(edits, i - 1).start + get(edits, i - 1).size)"
    parts = f"transform(edits, (e, i) -> concat({piece(before, f'(e.start - ({before})) * 4')}, e.edit))"
    last = "element_at(edits, -1).start + element_at(edits, -1).size"
    rebuilt = let("wide", f"encode({text}, 'UTF-32')", f"concat(array_join({parts}, ''), {piece(last, 'octet_length(wide)')})")
    return let("edits", f"filter({spans}, s -> s.edit IS NOT NULL)", f"IF(size(edits) = 0, {text}, {rebuilt})")


def value_spans(text: str, policy: PrivacyPolicy, detectors: Sequence[Detector] | None = None, asked: str | None = None) -> str:
    """Resolved spans of all enabled detectors over one value; empty for null.

    ``text`` is repeated many times: give a column or a bound name. ``asked`` names an array of the catalogue positions of
    the detectors that may match, if that is known.
    """
    active = enabled_detectors(policy, detectors)
    if not active:
        return NO_SPANS
    shapes = [] if asked else sorted({d.shape for _, d in active if d.shape})
    parts = []
    for order, detector in active:
        spans = detector_spans(text, detector, order, policy)
        if asked:
            condition = " AND ".join([f"array_contains({asked}, {order})", *([detector.gate(text)] if detector.gate is not None else [])])
        else:
            condition = may_match(text, detector, shapes)
        parts.append(f"IF({condition}, {spans}, {NO_SPANS})" if condition else spans)
    found = f"flatten(array({', '.join(parts)}))"
    if not asked:
        known = struct(lowered=f"lower({text})", **{f"shape_{i}": f"{text} RLIKE {lit(p)}" for i, p in enumerate(shapes)})
        found = let("known", known, found)
    resolved = let("every", found, f"IF(size(every) <= 1, every, {resolve_overlaps('every')})")
    return f"IF({text} IS NULL OR {text} = '', {NO_SPANS}, {resolved})"


def findings_of(spans: str, policy: PrivacyPolicy, detectors: Sequence[Detector] | None = None, path: str | None = None) -> str:
    """Spans with detector id, category and action spelled out."""
    catalogue = list(builtin_detectors() if detectors is None else detectors)

    def named(values: Sequence[str]) -> str:
        return f"get(array({lits(values)}), s.ord)"

    fields = dict(
        detector=named([d.id for d in catalogue]),
        category=named([d.category for d in catalogue]),
        action=named([policy.action_for(d.id) for d in catalogue]),
        start="s.start",
        size="s.size",
        validated=f"get(array({', '.join(lit(d.checked) for d in catalogue)}), s.ord)",
        sub_kind="s.sub_kind",
    )
    if path is not None:
        fields = dict(path=path, **fields)
    return f"transform({spans}, s -> {struct(**fields)})"


def detected_ids(findings: str) -> str:
    """Distinct sorted ``id[:sub kind]``."""
    return f"array_sort(array_distinct(transform({findings}, f -> concat_ws(':', f.detector, f.sub_kind))))"


def action_labels(findings: str) -> str:
    """Detector id to action label."""
    label = lookup("f.action", pol.ACTION_LABELS, "f.action")
    entries = f"array_distinct(transform({findings}, f -> named_struct('key', f.detector, 'value', {label})))"
    return f"map_from_entries(array_sort({entries}))"


def privacy_metadata(findings: str) -> str:
    """``struct<detected array<string>, actions map<string,string>>``."""
    return struct(detected=detected_ids(findings), actions=action_labels(findings))


def paths_with(findings: str, actions: Sequence[str]) -> str:
    """Distinct paths of findings that had one of the actions, sorted."""
    return f"array_sort(array_distinct(transform(filter({findings}, f -> f.action IN ({lits(actions)})), f -> f.path)))"


def text_failure(text: str, max_bytes: int | None = None) -> str:
    """Failure code of a text payload, null when it can be scanned; any size can, unless a limit is given."""
    large = [(f"octet_length({text}) > {max_bytes}", "'payload-too-large'")] if max_bytes is not None else []
    return when([(f"{text} IS NULL", "'empty-payload'"), *large])


def scan_text(
    df: DataFrame,
    column: str,
    policy: PrivacyPolicy | None = None,
    detectors: Sequence[Detector] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Adds ``_spans`` (resolved spans of ``column``); the building block of the operators below."""
    policy = policy or PrivacyPolicy()
    scannable = f"IF({text_failure(column, max_bytes)} IS NULL, {column}, NULL)"
    return df.transform(once, "_spans", let("val", scannable, value_spans("val", policy, detectors)))


def redact_text(
    df: DataFrame,
    column: str,
    policy: PrivacyPolicy | None = None,
    detectors: Sequence[Detector] | None = None,
    output: str = "redaction",
    max_bytes: int | None = None,
) -> DataFrame:
    """Adds ``struct<succeeded, failure_code, text, findings, privacy>`` for a string column.

    A null payload, or one over ``max_bytes`` if that is given, fails and carries no text.
    """
    policy = policy or PrivacyPolicy()
    failure = text_failure(column, max_bytes)
    result = let(
        "found",
        findings_of("_spans", policy, detectors),
        struct(
            succeeded=f"{failure} IS NULL",
            failure_code=failure,
            text=f"IF({failure} IS NULL, {apply_edits(column, '_spans')}, NULL)",
            findings="found",
            privacy=privacy_metadata("found"),
        ),
    )
    return scan_text(df, column, policy, detectors, max_bytes).transform(once, output, result).drop("_spans")


def find_sensitive(
    df: DataFrame,
    key: str | Sequence[str],
    column: str,
    policy: PrivacyPolicy | None = None,
    detectors: Sequence[Detector] | None = None,
) -> DataFrame:
    """One row per finding: the key columns, detector, category, action, offsets and sub-kind."""
    policy = policy or PrivacyPolicy()
    keys = [key] if isinstance(key, str) else list(key)
    found = scan_text(df.select(*keys, column), column, policy, detectors).select(
        *keys, F.explode(F.expr(findings_of("_spans", policy, detectors))).alias("f")
    )
    return found.select(*keys, "f.*")


def findings_summary(findings: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Findings and distinct documents per detector, category and action.

    Counted per key first, so the second aggregation moves one row per key and detector and no set of
    keys is ever held for one detector.
    """
    group = [*by, "detector", "category", "action"]
    per_key = findings.groupBy(*group, key).agg(F.count("*").alias("n"))
    return per_key.groupBy(*group).agg(F.sum("n").alias("findings"), F.count("*").alias("documents"))


def is_alert_worthy(detector: str) -> str:
    """Whether a detector id (with or without sub-kind) deserves its own security event."""
    return f"substring_index({detector}, ':', 1) IN ({lits(pol.ALERT_WORTHY)})"


# The older finding kinds by detector; anything else is a generic secret.
LEGACY_KINDS = {
    "secret.aws": "AwsAccessKey",
    "secret.jwt": "Jwt",
    "secret.entra": "Jwt",
    "crypto.material": "PrivateKeyBlock",
    "fin.credit-card": "CreditCard",
    "id.email": "Email",
    "id.ip": "IpAddress",
    "secret.database": "ConnectionString",
}


def legacy_findings(findings: DataFrame) -> DataFrame:
    """Findings in the older shape: kind, preview and action beside the other columns."""
    action = when(
        [(f"action = {lit(pol.REMOVE)}", "'removed'"), (f"action IN ({lits(pol.UNCHANGED_ACTIONS)})", "'alert'")], "'masked'"
    )
    return findings.withColumns(
        {
            "kind": F.expr(lookup("detector", LEGACY_KINDS, "'GenericSecret'")),
            "preview": F.lit("***"),
            "legacy_action": F.expr(action),
        }
    )
