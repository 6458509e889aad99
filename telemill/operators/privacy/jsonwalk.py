"""Redaction of JSON documents of any shape.

The document is checked as a VARIANT. A small Arrow function walks it and yields the properties whose name marks a
secret and the string leaves that may hold a finding, with their paths and the detectors whose cheap conditions they
fulfil. Detection runs on those leaves with the same expressions as on plain text. Only rows that need an edit pass
through a second function that puts the new values in place.

As in the text operators the check is on values: numbers and arrays directly inside arrays are not
looked at, unless ``strict`` asks for the nested arrays.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from telemill.functions.sqltext import let, lit, once, struct, when
from telemill.operators.privacy import engine
from telemill.operators.privacy import policy as pol
from telemill.operators.privacy.detectors import (
    FIELD_NAME_CATEGORY,
    FIELD_NAME_DETECTOR,
    SECRET_FIELD_NAMES,
    Detector,
)
from telemill.operators.privacy.policy import PrivacyPolicy

MAX_DEPTH = 32

ESCAPE = r"\\."
NO_BRACKETS = r"[^\[\]{}]+"
OBJECT_START = r"^[ \t\r\n]*\{"

STEPS = "array<string>"
LEAF = f"struct<path:string,steps:{STEPS},text:string,asked:array<int>>"
SECRET = f"struct<path:string,steps:{STEPS}>"
HIT = f"struct<path:string,steps:{STEPS},text:string,spans:array<{engine.SPAN}>>"


def json_depth_exceeds(raw: str, limit: int) -> str:
    """Whether brackets nest deeper than the limit; only texts with many brackets are folded."""
    many = lit(r"^(?:[^\[{]*+[\[{]){" + str(limit + 1) + "}")
    no_strings = f"regexp_replace(regexp_replace({raw}, {lit(ESCAPE)}, ''), '\"[^\"]*+\"', '')"
    brackets = f"split(regexp_replace({no_strings}, {lit(NO_BRACKETS)}, ''), '(?!^)(?!$)')"
    now = "state.now + IF(bracket IN ('{', '['), 1, -1)"
    deepest = (
        f"aggregate({brackets}, named_struct('now', 0, 'top', 0), "
        f"(state, bracket) -> named_struct('now', {now}, 'top', greatest(state.top, {now})), state -> state.top)"
    )
    return f"IF(NOT {raw} RLIKE {many}, false, {deepest} > {limit})"


def candidate_failure(raw: str, parsed: str, max_bytes: int | None = None) -> str:
    """Failure code of a candidate document, null when it is a usable JSON object."""
    return when(
        [
            (f"{raw} IS NULL OR {raw} RLIKE {lit(r'^\s*$')}", "'empty-payload'"),
            *([(f"octet_length({raw}) > {max_bytes}", "'payload-too-large'")] if max_bytes is not None else []),
            (f"{parsed} IS NULL OR {json_depth_exceeds(raw, MAX_DEPTH)}", "'invalid-json'"),
            (f"NOT {raw} RLIKE {lit(OBJECT_START)}", "'root-must-be-object'"),
        ]
    )


def _is_name(character: str) -> bool:
    kind = unicodedata.category(character)
    return kind[0] == "L" or kind == "Nd"


def name_key(name: str) -> str:
    """Letters and digits of any script, lower-cased, as :func:`telemill.functions.text.field_key` has them."""
    return (name if name.isalnum() and name.isascii() else "".join(filter(_is_name, name))).lower()


def _sound(text: str) -> str:
    """The text as the JVM writes it: half a surrogate pair becomes a question mark."""
    return text if text.isascii() else re.sub("[\ud800-\udfff]", "?", text)


def walk(document: str, names: frozenset[str], strict: bool = False, told: dict[str, bool] | None = None) -> tuple[list, list]:
    """The texts of an object and its members with a secret name, as ``path, steps[, text]``.

    Arrays directly inside arrays are opened, to a depth of five, only if ``strict``. ``told`` remembers which names are
    secret, from document to document.
    """
    leaves, secrets, told = [], [], {} if told is None else told
    # The literals of numbers are not looked at.
    open_ = [("$", (), json.loads(document, parse_int=len, parse_float=len))]

    def visit(path: str, steps: tuple, value, arrays: int) -> None:
        if type(value) is str:
            leaves.append((path, steps, _sound(value)))
        elif type(value) is dict:
            open_.append((path, steps, value))
        elif type(value) is list and arrays:
            for i, x in enumerate(value):
                visit(f"{path}[{i}]", (*steps, f"i{i}"), x, arrays - 1)

    while open_:
        path, steps, members = open_.pop()
        for key, value in members.items():
            here, trail = f"{path}.{key}", (*steps, "k" + key)
            if (secret := told.get(key)) is None:
                secret = told[key] = name_key(key) in names
            if secret:
                secrets.append((here, trail))
            else:
                visit(here, trail, value, 5 if strict else 1)
    return leaves, secrets


class Gates:
    """Which detectors may match in a text, by cheap conditions that every match implies."""

    def __init__(self, active: Sequence[tuple[int, bool, tuple[str, ...], str | None, str | None]]) -> None:
        """Position, whether the rest can be used, words, shape and pattern of each detector."""
        self.always = [order for order, portable, *_ in active if not portable]
        self.tests = [
            (order, words, shape and re.compile(shape, re.ASCII), pattern and re.compile(pattern, re.ASCII))
            for order, portable, words, shape, pattern in active
            if portable
        ]
        self.words = sorted({w for _, words, _, _ in self.tests for w in words})

    @classmethod
    def of(cls, active: Sequence[tuple[int, Detector]]) -> Gates:
        # Words alone are enough for a detector whose plain pattern is slow.
        return cls([(i, d.portable, d.words, d.shape, None if d.scan_pattern or d.locate else d.pattern) for i, d in active])

    def asked(self, texts: Sequence[str]) -> list[list[int]]:
        """The positions for each text."""
        found = [list(self.always) for _ in texts]
        joined = "\n".join(texts)
        lowered = joined.lower()
        # Most detectors fall out here: each word is looked for once in all texts of a document.
        there = {w for w in self.words if w in lowered}
        lower: list[str] = []
        hits: dict = {}
        for order, words, shape, pattern in self.tests:
            if words and there.isdisjoint(words):
                continue
            places = range(len(texts))
            if shape is not None:
                # Java's blanks are those of ASCII, so a shape in a text is one in the joined texts, too.
                if shape not in hits:
                    hits[shape] = shape.search(joined) is not None and [i for i in places if shape.search(texts[i]) is not None]
                if not hits[shape]:
                    continue
                places = hits[shape]
            if words:
                lower = lower or [t.lower() for t in texts]
                some = [w for w in words if w in there]
                places = [i for i in places if any(w in lower[i] for w in some)]
            for i in places:
                # Word borders of other scripts may differ.
                if pattern is None or not texts[i].isascii() or pattern.search(texts[i]):
                    found[i].append(order)
        return found


def _walker(names: Sequence[str], strict: bool, gates: Gates):
    """``struct<leaves, secrets>`` of each document, with the leaves that may hold a finding; null if it has none."""
    wanted = frozenset(names)

    def one(document: str | None, told: dict[str, bool]) -> dict | None:
        if document is None:
            return None
        leaves, secrets = walk(document, wanted, strict, told)
        asked = gates.asked([text for _, _, text in leaves]) if gates.always or gates.tests else [[]] * len(leaves)
        kept = [
            {"path": _sound(path), "steps": [_sound(s) for s in steps], "text": text, "asked": orders}
            for (path, steps, text), orders in zip(leaves, asked)
            if orders
        ]
        hidden = [{"path": _sound(path), "steps": [_sound(s) for s in steps]} for path, steps in secrets]
        return {"leaves": kept, "secrets": hidden} if kept or hidden else None

    def walk_all(documents: pa.Array) -> pa.Array:
        steps = ("steps", pa.list_(pa.string()))
        leaf = pa.struct([("path", pa.string()), steps, ("text", pa.string()), ("asked", pa.list_(pa.int32()))])
        secret = pa.struct([("path", pa.string()), steps])
        kind = pa.struct([("leaves", pa.list_(leaf)), ("secrets", pa.list_(secret))])
        told: dict[str, bool] = {}
        return pa.array([one(d, told) for d in documents.to_pylist()], kind)

    return F.arrow_udf(walk_all, f"struct<leaves:array<{LEAF}>,secrets:array<{SECRET}>>")


def put_edits(document: str | None, edits: str | None) -> str | None:
    """The document with ``[{steps, text, drop}]`` applied; number literals keep their text."""
    if document is None or edits is None:
        return None
    todo = json.loads(edits)
    # Number literals travel as texts with a mark that neither the document nor an edit holds.
    mark = "\ue000"
    if any(mark in x or "\\ue000" in x.lower() for x in (document, edits)):
        plain = json.dumps([json.loads(document), todo], ensure_ascii=False)
        while mark in plain:
            mark += "\ue001"
    root = json.loads(document, parse_float=lambda literal: f"{mark}{literal}{mark}")
    for edit in todo:
        steps = [step[1:] if step[0] == "k" else int(step[1:]) for step in edit["steps"]]
        place = root
        for step in steps[:-1]:
            place = place[step]
        if edit.get("drop"):
            del place[steps[-1]]
        elif "json" in edit:
            place[steps[-1]] = json.loads(edit["json"])
        else:
            place[steps[-1]] = edit["text"]
    text = json.dumps(root, ensure_ascii=False, separators=(",", ":"))
    text = re.sub(f'"{mark}([-+0-9.eE]+){mark}"', r"\1", text)
    # A surrogate without its other half stays an escape.
    return re.sub("[\ud800-\udfff]", lambda half: f"\\u{ord(half[0]):04x}", text)


@F.pandas_udf(StringType())
def _put_edits(documents: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([put_edits(d, e) for d, e in zip(documents, edits)], dtype=object)


def redact_json(
    df: DataFrame,
    column: str,
    policy: PrivacyPolicy | None = None,
    detectors: Sequence[Detector] | None = None,
    field_names: Sequence[str] = SECRET_FIELD_NAMES,
    output: str = "redaction",
    strict: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """Adds ``struct<succeeded, failure_code, json, findings, removed_paths, masked_paths, privacy>``.

    A document without edits keeps its text; compare documents as JSON values.
    """
    policy = policy or PrivacyPolicy()
    names = tuple(field_names) if policy.enabled(FIELD_NAME_DETECTOR) else None
    name_action = policy.action_for(FIELD_NAME_DETECTOR)

    hit = struct(
        path="leaf.path",
        steps="leaf.steps",
        text="leaf.text",
        spans=let("val", "leaf.text", engine.value_spans("val", policy, detectors, "leaf.asked")),
    )
    # A text over the limit, if there is one, is never parsed.
    parsed = f"try_parse_json({column})" if max_bytes is None else f"try_parse_json(IF(octet_length({column}) <= {max_bytes}, {column}, NULL))"
    checked = df.transform(once, "_failed", let("doc", parsed, candidate_failure(column, "doc", max_bytes)))
    gates = Gates.of(engine.enabled_detectors(policy, detectors))
    walked = checked.withColumn("_tree", _walker(names or (), strict, gates)(F.expr(f"IF(_failed IS NULL, {column}, NULL)")))
    scan = struct(
        failed="_failed",
        hits=f"filter(transform(_tree.leaves, leaf -> {hit}), h -> size(h.spans) > 0)",
        secrets="_tree.secrets",
    )
    scanned = walked.transform(once, "_scan", f"IF(_tree IS NULL, {struct(failed='_failed', hits=f'cast(array() AS array<{HIT}>)', secrets=f'cast(array() AS array<{SECRET}>)')}, {scan})").drop("_failed", "_tree")

    value_findings = f"flatten(transform(_scan.hits, h -> {engine.findings_of('h.spans', policy, detectors, path='h.path')}))"
    name_finding = struct(
        path="s.path",
        detector=lit(FIELD_NAME_DETECTOR),
        category=lit(FIELD_NAME_CATEGORY),
        action=lit(name_action),
        start="cast(NULL AS int)",
        size="cast(NULL AS int)",
        validated="true",
        sub_kind="cast(NULL AS string)",
    )
    findings = f"array_sort(concat(transform(_scan.secrets, s -> {name_finding}), {value_findings}))"
    with_findings = scanned.withColumn("_findings", F.expr(findings))

    edit_type = f"array<struct<steps:{STEPS},text:string,drop:boolean,json:string>>"

    def edit(steps: str, text: str = "NULL", drop: str = "false", doc: str = "NULL") -> str:
        return struct(steps=steps, text=f"cast({text} AS string)", drop=drop, json=f"cast({doc} AS string)")

    changed = "filter(_scan.hits, h -> exists(h.spans, s -> s.edit IS NOT NULL))"
    edits = [f"transform({changed}, h -> {edit('h.steps', text=engine.apply_edits('h.text', 'h.spans'))})"]
    if name_action not in pol.UNCHANGED_ACTIONS:
        edits.append(f"transform(_scan.secrets, s -> {edit('s.steps', drop='true')})")
    if policy.emit_metadata:
        note = edit("array('kprivacy')", doc=f"to_json({engine.privacy_metadata('_findings')})")
        edits.append(f"IF(size(_findings) > 0, array({note}), array())")
    every = "concat(" + ", ".join(f"cast({e} AS {edit_type})" for e in edits) + ")"
    all_edits = let("todo", every, "IF(size(todo) > 0, to_json(todo), NULL)")
    edited = with_findings.withColumn("_edits", F.expr(all_edits))
    # Rows without edits send nulls to the Python worker and keep their text.
    touched = F.when(F.col("_edits").isNotNull(), F.col(column))
    rewritten = edited.withColumn("_json", F.coalesce(_put_edits(touched, F.col("_edits")), F.col(column)))
    result = struct(
        succeeded="_scan.failed IS NULL",
        failure_code="_scan.failed",
        json="IF(_scan.failed IS NULL, _json, NULL)",
        findings="_findings",
        removed_paths=engine.paths_with("_findings", [pol.REMOVE]),
        masked_paths=engine.paths_with("_findings", pol.MASKING_ACTIONS),
        privacy=engine.privacy_metadata("_findings"),
    )
    return rewritten.transform(once, output, result).drop("_scan", "_findings", "_edits", "_json")
