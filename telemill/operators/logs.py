"""Log-format inference and parsing over tables of log lines.

Input is a table ``file, line_no, line``. Inference is one aggregation over all lines, whatever their
number; parsing is one expression per line. Blank lines are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.functions.jsonread import ISO_DATE
from telemill.functions.sqltext import let, lit, lits, once, opaque, struct, when
from telemill.functions.text import ascii_key
from telemill.operators.ordinals import running_sum

MAX_PATTERN = 2048
PREVIEW_ROWS = 20

# Field names that never leave the parser, and fragments that rule a name out.
PROHIBITED_NAMES = (
    "authorization",
    "authorizationheader",
    "body",
    "cookie",
    "credentials",
    "password",
    "payload",
    "rawpayload",
    "secret",
    "token",
)
PROHIBITED_PARTS = ("password", "secret", "token", "cookie")

# Separators, the pair pattern and the known line patterns with their group names.
DELIMITERS = (",", "\t", ";")
SEPARATORS = ("=", ":")
PAIR = r"""([A-Za-z_][\w.@-]*){sep}("[^"]*"|'[^']*'|[^\s]+)"""
LINE_PATTERNS = {
    "http-access": (
        r"""^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)(?:\s+[^"]+)?"\s+(\d{3})(?:\s+(\d+|-))?.*$""",
        ("source_ip", "identity", "timestamp", "method", "path", "status", "bytes"),
    ),
    "timestamp-severity": (
        r"""^(\d{4}-\d{2}-\d{2}[T ][^\s]+)\s+(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\s+(.*)$""",
        ("timestamp", "severity", "message"),
    ),
    "syslog": (
        r"""^(?:<\d+>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w.-]+)(?:\[(\d+)\])?:\s*(.*)$""",
        ("timestamp", "host", "application", "process_id", "message"),
    ),
}

# Aliases of a canonical field name, its OCSF path, ASIM field and whether it is sensitive.
FIELD_ALIASES = (
    (("timestamp", "time", "datetime", "eventtime", "eventtimestamp", "ts"), "time", "TimeGenerated", False),
    (("severity", "level", "loglevel", "severityname"), "severity", "EventSeverity", False),
    (
        ("user", "username", "userid", "identity", "principal", "principalname", "actor", "email"),
        "actor.user.name",
        "ActorUsername",
        True,
    ),
    (("sourceip", "srcip", "clientip", "remoteaddr", "ip"), "src_endpoint.ip", "SrcIpAddr", True),
    (("destinationip", "dstip", "serverip"), "dst_endpoint.ip", "DstIpAddr", True),
    (("action", "activity", "operation", "event", "eventname", "method"), "activity_name", "EventType", False),
    (("result", "outcome", "status"), "status_detail", "EventResultDetails", False),
    (("host", "hostname", "computer", "device"), "device.hostname", "DvcHostname", True),
    (("application", "app", "service", "component"), "metadata.product.name", "EventProduct", False),
    (("message", "eventmessage", "description"), "message", "EventMessage", True),
    (("processid", "pid"), "actor.process.pid", "ActorProcessId", False),
    (("path", "url", "requesturi"), "http_request.url.path", "Url", True),
)

# Value types and the Spark type of a typed projection.
TYPES = {"Text": "string", "DateTime": "timestamp", "IpAddress": "string", "WholeNumber": "bigint", "Boolean": "boolean"}

IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)$"
IPV6 = r"^(?=.*:.*:)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=(?:[^:]|:(?!:))*::(?:[^:]|:(?!:))*$)[0-9A-Fa-f:]{2,39})$"
FIELD_NAME = "^[A-Za-z0-9_.@-]{1,128}$"


@dataclass(frozen=True)
class LogConfig:
    """How to parse lines: ``json``, ``csv``, ``keyvalue`` or ``regex`` with what each needs."""

    format: str
    delimiter: str | None = None
    headers: tuple[str, ...] = ()
    separator: str | None = None
    pattern: str | None = None
    groups: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.format not in ("json", "csv", "keyvalue", "regex"):
            raise ValueError(f"unknown log format: {self.format}")
        if self.format == "csv" and self.delimiter not in DELIMITERS:
            raise ValueError("csv needs a comma, tab or semicolon as delimiter")
        if self.format == "keyvalue" and self.separator not in SEPARATORS:
            raise ValueError("keyvalue needs = or : as separator")
        if self.format == "regex":
            if not self.pattern or len(self.pattern) > MAX_PATTERN:
                raise ValueError(f"a pattern of 1 to {MAX_PATTERN} characters is required")
            if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", self.pattern):
                raise ValueError("look-around and back-references are not supported")
            if not self.groups:
                raise ValueError("regex needs the names of its groups")


def is_prohibited(name: str) -> str:
    """Whether a field name must not be emitted."""
    parts = " OR ".join(f"contains(canon, {lit(p)})" for p in PROHIBITED_PARTS)
    return let("canon", ascii_key(name), f"(canon IN ({lits(PROHIBITED_NAMES)}) OR {parts})")


def valid_name(name: str) -> str:
    """Whether a field name is well-formed."""
    return f"coalesce({name} RLIKE {lit(FIELD_NAME)}, false)"


def is_ip(value: str) -> str:
    """IPv4 or IPv6 address."""
    return f"({value} RLIKE {lit(IPV4)} OR {value} RLIKE {lit(IPV6)})"


#: Dates in other forms: a shape, what of it is parsed, and the pattern of that.
DATE_FORMS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", None, "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", None, "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", None, "M/d/yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", None, "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", None, "yyyy/M/d H:mm"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", None, "yyyy/M/d H:mm:ss"),
    (r"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?\d{1,2} [A-Z][a-z]{2} \d{4}$", r"^[A-Z][a-z]{2}, ", "d MMM yyyy"),
    (
        r"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}(?: GMT)?$",
        r"^[A-Z][a-z]{2}, | GMT$", "d MMM yyyy HH:mm:ss",
    ),
)


def is_datetime(value: str) -> str:
    """ISO-like date, or one of the common forms of :data:`DATE_FORMS`, that can be parsed; blanks around it do not count."""

    def form(shape: str, dropped: str | None, pattern: str) -> str:
        bare = "plain" if dropped is None else f"regexp_replace(plain, {lit(dropped)}, '')"
        return f"(plain RLIKE {lit(shape)} AND try_to_timestamp({bare}, {lit(pattern)}) IS NOT NULL)"

    iso = f"(plain RLIKE {lit(ISO_DATE)} AND try_cast(plain AS timestamp) IS NOT NULL)"
    other = f"((contains(plain, '/') OR plain LIKE '% ___ %') AND ({' OR '.join(form(*f) for f in DATE_FORMS)}))"
    return let("plain", f"trim({value})", f"({iso} OR {other})")


def is_whole_number(value: str) -> str:
    """64-bit whole number."""
    return f"(trim({value}) RLIKE '^[-+]?[0-9]+$' AND try_cast(trim({value}) AS bigint) IS NOT NULL)"


def is_boolean(value: str) -> str:
    """``true`` or ``false`` in any case; other spellings that Spark would cast do not count."""
    return f"(lower(trim({value})) IN ('true', 'false'))"


def value_matches(value: str, kind: str) -> str:
    """Whether a value fits the type named in a column or literal."""
    return when(
        [
            (f"{kind} = 'DateTime'", is_datetime(value)),
            (f"{kind} = 'IpAddress'", is_ip(value)),
            (f"{kind} = 'WholeNumber'", is_whole_number(value)),
            (f"{kind} = 'Boolean'", is_boolean(value)),
        ],
        "true",
    )


def split_delimited(line: str, delimiter: str) -> str:
    """Cells of a delimited line; empty when quotes do not balance.

    Every second quote closes the one before it, so a delimiter counts when the quotes in front of it
    are even in number: it is turned into a control character and the line is split there. A doubled
    quote inside quotes is kept as one quote.
    """
    unit, quote = chr(31), chr(30)
    # Pieces between quotes alternate between outside and inside.
    pieces = f"split({line}, '\"', -1)"
    marked = (
        f"array_join(transform({pieces}, (p, i) -> IF(i % 2 = 0, replace(p, {lit(delimiter)}, {lit(unit)}), p)), {lit(quote)})"
    )
    # A quote right between two quoted pieces is an escaped one; all others vanish.
    doubled = lit(quote + quote)
    cells = (
        f"transform(split({marked}, {lit(unit)}, -1), c -> trim(replace(replace(replace(c, {doubled}, {lit(chr(29))}), "
        f"{lit(quote)}, ''), {lit(chr(29))}, '\"')))"
    )
    return f"IF(size({pieces}) % 2 = 0, cast(array() AS array<string>), {cells})"


def flatten_json(document: str, levels: int | None = None, fields: int | None = None) -> str:
    """Scalars of a parsed object under dotted names, of all levels and fields unless limits are given.

    Invalid and prohibited names drop out with everything below them; arrays and nulls are skipped.
    """
    entry = "struct<name:string,text:string>"
    node = "struct<name:string,obj:map<string,variant>>"
    full = "IF(n.name = '', e.key, concat(n.name, '.', e.key))"
    members = (
        "flatten(transform(state.open, n -> filter(transform(map_entries(n.obj), e -> "
        + struct(name=full, v="e.value", obj="try_variant_get(e.value, '$', 'map<string,variant>')")
        + f"), m -> {valid_name('m.name')} AND NOT {is_prohibited('m.name')})))"
    )
    scalar = "m.obj IS NULL AND left(schema_of_variant(m.v), 5) <> 'ARRAY' AND schema_of_variant(m.v) <> 'VOID'"
    text = "try_variant_get(m.v, '$', 'string')"
    step = let(
        "found",
        members,
        struct(
            open="transform(filter(found, m -> m.obj IS NOT NULL), m -> named_struct('name', m.name, 'obj', m.obj))",
            leaves=f"concat(state.leaves, transform(filter(found, m -> {scalar}), m -> named_struct('name', m.name, 'text', {text})))",
        ),
    )
    start = struct(
        open=f"cast(array(named_struct('name', '', 'obj', try_variant_get({document}, '$', 'map<string,variant>'))) AS array<{node}>)",
        leaves=f"cast(array() AS array<{entry}>)",
    )
    # No object is deeper than its schema has objects.
    depth = str(levels) if levels is not None else f"coalesce(regexp_count(schema_of_variant({document}), 'OBJECT'), 0)"
    leaves = "state.leaves" if fields is None else f"slice(state.leaves, 1, {fields})"
    fold = (
        f"aggregate(sequence(0, {depth}), {start}, (state, lvl) -> IF(size(state.open) = 0, state, {step}), "
        f"state -> {leaves})"
    )
    return last_wins(fold)


def last_wins(entries: str) -> str:
    """Map of ``struct<name, text>`` entries in which the last of equal names stays.

    The session's LAST_WIN policy (``session.configure``) decides, in one pass over any number of entries.
    """
    return f"map_from_entries(transform({entries}, e -> struct(e.name, e.text)))"


def pair_pattern(separator: str) -> str:
    """Pattern of key and value pairs."""
    return PAIR.replace("{sep}", separator)


def key_values(line: str, separator: str) -> str:
    """Map of the pairs of a line; null with fewer than two pairs or without a usable one."""
    pattern = lit(pair_pattern(separator))
    keys, values = f"regexp_extract_all({line}, {pattern}, 1)", f"regexp_extract_all({line}, {pattern}, 2)"
    unquoted = "regexp_replace(v, '^[\"\\']+|[\"\\']+$', '')"
    pairs = f"zip_with(ks, {values}, (k, v) -> named_struct('name', k, 'text', {unquoted}))"
    usable = f"filter({pairs}, p -> {valid_name('p.name')} AND NOT {is_prohibited('p.name')})"
    body = let("ps", usable, f"IF(size(ps) = 0, NULL, {last_wins('ps')})")
    return let("ks", keys, f"IF(size(ks) < 2, NULL, {body})")


def has_pairs(line: str, separator: str) -> str:
    """Whether :func:`key_values` gives a map, without building it."""
    usable = f"exists(ks, k -> {valid_name('k')} AND NOT {is_prohibited('k')})"
    return let("ks", f"regexp_extract_all({line}, {lit(pair_pattern(separator))}, 1)", f"size(ks) >= 2 AND {usable}")


def regex_groups(line: str, pattern: str, groups: Sequence[str]) -> str:
    """Map of the groups of a matching line; null without a match. Empty optional groups are left out."""
    fields = ", ".join(
        f"named_struct('name', {lit(name)}, 'text', nullif(regexp_extract({line}, {lit(pattern)}, {i}), ''))"
        for i, name in enumerate(groups, start=1)
    )
    kept = f"filter(array({fields}), g -> g.text IS NOT NULL AND NOT {is_prohibited('g.name')})"
    return f"IF({line} RLIKE {lit(pattern)}, map_from_entries(transform({kept}, g -> struct(g.name, g.text))), NULL)"


def csv_values(line: str, config: LogConfig) -> str:
    """Map of the cells of a line; null when the width differs from the header's."""
    cells = split_delimited(line, config.delimiter)
    keep = [(i, h) for i, h in enumerate(config.headers)]
    pairs = ", ".join(f"named_struct('name', {lit(h)}, 'text', cells[{i}])" for i, h in keep)
    kept = f"filter(array({pairs}), g -> NOT {is_prohibited('g.name')})"
    return let("cells", cells, f"IF(size(cells) = {len(config.headers)}, map_from_entries(transform({kept}, g -> struct(g.name, g.text))), NULL)")


def with_lines(df: DataFrame) -> DataFrame:
    """The non-blank lines."""
    return df.filter(F.trim("line") != "")


def _is_header() -> Column:
    return F.col("line_no") == F.lit(0)


def infer_log_format(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row ``lines, format, confidence, delimiter, separator, pattern_name`` for all lines, or for those of each ``by``.

    A format holds only if every line fits; the first that holds in the order JSON, comma, tab, semicolon,
    ``=`` pairs, ``:`` pairs, known line patterns is taken. Null format: none holds. A JSON line is an object or an
    array of objects; documents over several lines are found by :func:`json_documents`. Delimited widths are
    compared by their minimum and maximum, so that one aggregation with partial results decides everything. Line
    numbers start at 0 and line 0 of each file is its header. Cheap shapes are tested first.
    """
    def width(delimiter: str) -> str:
        # Only a line with quotes has to be taken apart to count its cells.
        plain = f"length(line) - length(replace(line, {lit(delimiter)}, '')) + 1"
        return f"IF(contains(line, '\"'), size({split_delimited('line', delimiter)}), {plain})"

    def header(delimiter: str) -> str:
        good = (
            f"size(cells) >= 2 AND forall(cells, c -> {valid_name('c')}) "
            "AND size(array_distinct(cells)) = size(cells)"
        )
        return f"IF(line_no = 0, {let('cells', split_delimited('line', delimiter), good)}, true)"

    lines = with_lines(df)
    of_objects = "forall(coalesce(try_variant_get(doc, '$', 'array<variant>'), array()), d -> try_variant_get(d, '$', 'map<string,variant>') IS NOT NULL)"
    some = "size(coalesce(try_variant_get(doc, '$', 'array<variant>'), array())) > 0"
    document = f"try_variant_get(doc, '$', 'map<string,variant>') IS NOT NULL OR ({some} AND {of_objects})"
    json_line = f"(left(ltrim(line), 1) IN ('{{', '[') AND {let('doc', 'try_parse_json(line)', f'coalesce({document}, false)')})"
    aggregates = [F.count("*").alias("n"), F.expr(f"bool_and({json_line})").alias("json")]
    for i, d in enumerate(DELIMITERS):
        aggregates += [
            F.expr(f"min({width(d)})").alias(f"min{i}"),
            F.expr(f"max({width(d)})").alias(f"max{i}"),
            F.expr(f"bool_and({header(d)})").alias(f"head{i}"),
        ]
    aggregates.append(F.expr("count_if(line_no > 0)").alias("data_lines"))
    for i, separator in enumerate(SEPARATORS):
        aggregates.append(F.expr(f"bool_and(contains(line, {lit(separator)}) AND {has_pairs('line', separator)})").alias(f"kv{i}"))
    for i, (pattern, _) in enumerate(LINE_PATTERNS.values()):
        aggregates.append(F.expr(f"bool_and(contains(line, ':') AND line RLIKE {lit(pattern)})").alias(f"rx{i}"))
    row = lines.groupBy(*by).agg(*aggregates)

    def choice(fmt: str, confidence: float, delimiter=None, separator=None, name=None) -> str:
        return struct(
            format=lit(fmt), confidence=f"{confidence}D", delimiter=f"cast({lit(delimiter)} AS string)",
            separator=f"cast({lit(separator)} AS string)", pattern_name=f"cast({lit(name)} AS string)",
        )

    cases = [("json", choice("json", 1.0))]
    cases += [
        (f"data_lines > 0 AND min{i} = max{i} AND min{i} >= 2 AND head{i}", choice("csv", 0.95, delimiter=d)) for i, d in enumerate(DELIMITERS)
    ]
    cases += [(f"kv{i}", choice("keyvalue", 0.9, separator=s)) for i, s in enumerate(SEPARATORS)]
    cases += [(f"rx{i}", choice("regex", 0.8, name=name)) for i, name in enumerate(LINE_PATTERNS)]
    return row.select(*by, "n", F.expr(when(cases)).alias("f")).select(*by, F.col("n").alias("lines"), "f.*")


def json_documents(df: DataFrame) -> DataFrame:
    """``file, line_no, text``: the JSON documents of files that may spread them over lines, by their first line.

    Strings cannot hold line breaks, so what a line does to the depth of brackets follows from the line alone, and
    the depth before it is a running sum over the file, cut into blocks where a file is long. A document begins
    where the depth is zero. A file that begins with a bracket is an array, whose elements are documents: they
    begin at depth one. ``text`` holds one or more of them without the brackets of the array around them, separated by
    commas; what is no JSON is told when it is parsed.
    """
    bare = "regexp_replace(regexp_replace(line, '\\\\\\\\.', ''), '\"[^\"]*\"', '')"
    change = let("bare", bare, "length(translate(bare, '}]', '')) - length(translate(bare, '{[', ''))")
    lines = with_lines(df).select("file", "line_no", F.trim("line").alias("line"), F.expr(f"cast({change} AS bigint)").alias("_change"))
    deep = running_sum(lines, ["file"], ["line_no"], "_change", "_after").withColumn("_before", F.col("_after") - F.col("_change"))
    arrays = lines.groupBy("file").agg(F.min_by(F.expr("IF(startswith(line, '['), 1, 0)"), "line_no").alias("_base"))
    marked = deep.join(arrays, "file").withColumn("_begins", F.expr("IF(_before <= _base, 1, 0)"))
    grouped = running_sum(marked, ["file"], ["line_no"], "_begins", "_document")
    # A document is as long as it is; its lines meet in one row.
    texts = grouped.groupBy("file", "_document").agg(
        F.min("line_no").alias("line_no"), F.first("_base").alias("_base"), F.min_by("_before", "line_no").alias("_before"),
        F.max_by("_after", "line_no").alias("_after"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"),
    )
    whole = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    # Brackets of the array, and commas between its elements, stand at the ends.
    opened = F.when((F.col("_base") == 1) & (F.col("_before") <= 0), F.regexp_replace(whole, r"^\[", "")).otherwise(whole)
    closed = F.when((F.col("_base") == 1) & (F.col("_after") <= 0), F.regexp_replace(opened, r"\]$", "")).otherwise(opened)
    inner = F.when(F.col("_base") == 1, F.regexp_replace(F.trim(closed), r"^,|,$", "")).otherwise(closed)
    return texts.select("file", "line_no", F.trim(inner).alias("text")).where("trim(text) <> ''")


def parse_json_documents(df: DataFrame) -> DataFrame:
    """``file, line_no, fields, failure_code``: a row for each object of files of JSON documents over several lines.

    ``line_no`` is the first line of the piece that holds the object. What is no object has the failure ``not-json``.
    """
    documents = let("doc", "try_parse_json(concat('[', text, ']'))", "IF(doc IS NULL, array(cast(NULL AS variant)), try_variant_get(doc, '$', 'array<variant>'))")
    exploded = json_documents(df).select("file", "line_no", F.explode(F.expr(documents)).alias("_doc"))
    good = "try_variant_get(_doc, '$', 'map<string,variant>') IS NOT NULL"
    parsed = exploded.withColumn("fields", F.expr(opaque(f"IF({good}, {flatten_json('_doc')}, NULL)"))).drop("_doc")
    return parsed.withColumn("failure_code", F.when(F.col("fields").isNull(), "not-json"))


def config_for(inferred, headers: Sequence[str] = ()) -> LogConfig:
    """A parser configuration from the one row of :func:`infer_log_format`."""
    if inferred["format"] is None:
        raise ValueError("no supported format fits every line")
    if inferred["format"] == "regex":
        pattern, groups = LINE_PATTERNS[inferred["pattern_name"]]
        return LogConfig("regex", pattern=pattern, groups=groups)
    return LogConfig(
        inferred["format"], delimiter=inferred["delimiter"], headers=tuple(headers), separator=inferred["separator"]
    )


def csv_headers(df: DataFrame, delimiter: str) -> DataFrame:
    """The distinct header rows (one, for files of one kind)."""
    return with_lines(df).filter(_is_header()).select(F.expr(split_delimited("line", delimiter)).alias("headers")).distinct()


def parse_logs(df: DataFrame, config: LogConfig) -> DataFrame:
    """Adds ``fields MAP<STRING, STRING>`` and ``failure_code``; bad lines stay with a code.

    A JSON line may hold an array of objects, which becomes one row per object.
    """
    lines = with_lines(df)
    if config.format == "json":
        documents = "coalesce(try_variant_get(doc, '$', 'array<variant>'), array(doc))"
        records = let("doc", "try_parse_json(line)", f"IF(doc IS NULL, array(cast(NULL AS variant)), {documents})")
        exploded = lines.withColumn("_doc", F.explode(F.expr(records)))
        good = "try_variant_get(_doc, '$', 'map<string,variant>') IS NOT NULL"
        parsed = exploded.transform(once, "fields", f"IF({good}, {flatten_json('_doc')}, NULL)").drop("_doc")
    elif config.format == "csv":
        body = lines.filter(~_is_header())
        parsed = body.transform(once, "fields", csv_values("line", config))
    elif config.format == "keyvalue":
        parsed = lines.transform(once, "fields", key_values("line", config.separator))
    else:
        parsed = lines.transform(once, "fields", regex_groups("line", config.pattern, config.groups))
    return parsed.withColumn("failure_code", F.when(F.col("fields").isNull(), f"not-{config.format}"))


def infer_schema(parsed: DataFrame, max_fields: int | None = None) -> DataFrame:
    """Field rows of parsed lines: ``name, type, required, values, ocsf_path, asim_field, sensitive``.

    Types, presence and the field list come from one aggregation per name with partial results.
    All fields are kept, or the first ``max_fields`` in the order of their first line.
    """
    # Every record adds a nameless cell, so that the records are counted in the same pass.
    marked = (
        "concat(array(named_struct('pos', -1, 'name', '', 'value', '')), "
        "transform(map_entries(fields), (e, i) -> named_struct('pos', i, 'name', e.key, 'value', e.value)))"
    )
    cells = parsed.filter("fields IS NOT NULL").select("file", "line_no", F.explode(F.expr(marked)).alias("c")).select(
        "file", "line_no", "c.*"
    )
    kinds = {"ip": is_ip("value"), "dt": is_datetime("value"), "wn": is_whole_number("value"), "bo": is_boolean("value")}
    has_value = "trim(value) <> ''"
    per_name = cells.groupBy("name").agg(
        F.count("*").alias("_present"),
        F.expr(f"count_if({has_value})").alias("values"),
        F.min(F.struct("file", "line_no", "pos")).alias("_first"),
        *[F.expr(f"coalesce(bool_and({t}) FILTER (WHERE {has_value}), false)").alias(k) for k, t in kinds.items()],
    )
    canon = ascii_key("name")
    kind = when(
        [
            (f"contains({canon}, 'ip') AND ip", "'IpAddress'"),
            (f"(contains({canon}, 'time') OR contains({canon}, 'date')) AND dt", "'DateTime'"),
            ("wn", "'WholeNumber'"),
            ("bo", "'Boolean'"),
        ],
        "'Text'",
    )
    top = per_name.filter(f"NOT {is_prohibited('name')}")
    if max_fields is not None:
        top = top.orderBy("_first", "name").limit(max_fields + 1)
    # One row per field name from here on, one of them being the record count.
    records = F.max(F.when(F.col("name") == "", F.col("_present"))).over(W.partitionBy(F.lit(1)))
    typed = (
        top.withColumn("_records", records)
        .filter("name <> ''")
        .select("name", F.expr(kind).alias("type"), (F.col("_present") == F.col("_records")).alias("required"), "values")
    )
    return map_fields(typed)


def excluded_names(raw_names: DataFrame) -> DataFrame:
    """One row: how many distinct names of a table ``name`` are prohibited."""
    return raw_names.filter(is_prohibited("name")).agg(F.countDistinct("name").alias("excluded"))


def map_fields(fields: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``ocsf_path``, ``asim_field`` and ``sensitive``; an unknown field is unmapped and sensitive."""
    cases = [
        (f"canon IN ({lits(aliases)})", struct(ocsf=lit(ocsf), asim=lit(asim), sensitive=lit(sensitive)))
        for aliases, ocsf, asim, sensitive in FIELD_ALIASES
    ]
    unknown = struct(ocsf="cast(NULL AS string)", asim="cast(NULL AS string)", sensitive="true")
    mapped = fields.withColumn("_m", F.expr(let("canon", ascii_key(name), when(cases, unknown))))
    return mapped.select(
        *fields.columns, F.col("_m.ocsf").alias("ocsf_path"), F.col("_m.asim").alias("asim_field"), F.col("_m.sensitive").alias("sensitive")
    )


def _field_list(schema: Sequence) -> str:
    """The schema rows as an array literal."""
    items = ", ".join(
        struct(
            name=lit(f["name"]), type=lit(f["type"]), ocsf=f"cast({lit(f['ocsf_path'])} AS string)",
            asim=f"cast({lit(f['asim_field'])} AS string)",
            hidden=lit(bool(f["sensitive"]) or (f["type"] == "Text" and f["ocsf_path"] is None and f["asim_field"] is None)),
        )
        for f in schema
    )
    return f"array({items})"


def validate_types(parsed: DataFrame, schema: Sequence) -> DataFrame:
    """Sets ``failure_code`` to ``type-mismatch`` on records with a value that does not fit its type.

    ``schema`` is the (at most 64) rows of :func:`infer_schema`.
    """
    bad = f"exists({_field_list(schema)}, f -> fields[f.name] IS NOT NULL AND NOT {value_matches('fields[f.name]', 'f.type')})"
    return parsed.withColumn(
        "failure_code", F.coalesce("failure_code", F.expr(f"IF({bad}, 'type-mismatch', NULL)"))
    )


def apply_schema(parsed: DataFrame, schema: Sequence) -> DataFrame:
    """Typed columns, one per field."""
    columns = []
    for f in schema:
        value, name = f"fields[{lit(f['name'])}]", f["name"].replace("`", "``")
        typed = f"cast({is_boolean(value)} AND lower(trim({value})) = 'true' AS boolean)" if f["type"] == "Boolean" else f"try_cast(trim({value}) AS {TYPES[f['type']]})" if f["type"] != "Text" else value
        columns.append(f"{typed} AS `{name}`")
    return parsed.selectExpr("file", "line_no", *columns)


def preview(parsed: DataFrame, schema: Sequence) -> tuple[DataFrame, DataFrame]:
    """One row of counts, and the first rows with sensitive and free text hidden."""
    checked = validate_types(parsed, schema)
    counts = checked.agg(
        F.count_if(F.col("failure_code").isNull()).alias("parsed"), F.count_if(F.col("failure_code").isNotNull()).alias("rejected")
    )
    shown = (
        "IF(f.hidden, IF(f.type = 'IpAddress', '[redacted:ip]', '[redacted]'), fields[f.name])"
    )
    fields = (
        f"map_from_entries(transform(filter({_field_list(schema)}, f -> fields[f.name] IS NOT NULL), f -> struct(f.name, {shown})))"
    )
    rows = (
        checked.filter("failure_code IS NULL")
        .orderBy("file", "line_no")
        .limit(PREVIEW_ROWS)
        .select("file", "line_no", F.expr(fields).alias("fields"))
        .filter("size(fields) > 0")
    )
    return counts, rows


def expectations(parsed: DataFrame, schema: Sequence) -> DataFrame:
    """Data-quality rows: ``name, holds`` for a representative record, malformed records and hidden names."""
    checked = validate_types(parsed, schema)
    leaked = f"exists(map_keys(fields), k -> {is_prohibited('k')})"
    row = checked.agg(
        F.expr("count_if(failure_code IS NULL) > 0").alias("a"),
        F.expr("count_if(failure_code IS NOT NULL) = 0").alias("b"),
        F.expr(f"count_if(coalesce({leaked}, false)) = 0").alias("c"),
    )
    return row.select(
        F.expr(
            "inline(array(named_struct('name', 'parses representative record', 'holds', a), "
            "named_struct('name', 'rejects malformed record', 'holds', b), "
            "named_struct('name', 'does not emit prohibited fields', 'holds', c)))"
        )
    )
