"""Small text, name, id and map helpers as SQL fragments."""

from __future__ import annotations

from telemill.functions.sqltext import lit
from telemill.schema import DECISIONS

BLANK_START = r"^\s+"
NO_LETTER_OR_DIGIT = r"[^\p{L}\p{Nd}]"


def truncate(text: str, size: int) -> str:
    """First ``size`` characters."""
    return f"left({text}, {size})"


def present(text: str) -> str:
    """Neither null nor blank."""
    return f"coalesce(regexp_replace({text}, {lit(BLANK_START)}, '') <> '', false)"


def field_key(name: str) -> str:
    """Letters and digits of any script, lower-cased."""
    return f"lower(regexp_replace({name}, {lit(NO_LETTER_OR_DIGIT)}, ''))"


def ascii_key(name: str) -> str:
    """ASCII letters and digits, lower-cased."""
    return f"lower(regexp_replace({name}, '[^A-Za-z0-9]', ''))"


def safe_stem(name: str) -> str:
    """File stem with everything but letters, digits, ``-`` and ``_`` replaced by ``_``."""
    return f"regexp_replace({name}, '[^A-Za-z0-9_-]', '_')"


def contains_ci(text: str, needle: str) -> str:
    """Case-insensitive *contains*."""
    return f"contains(lower({text}), {lit(needle.lower())})"


def short_hash(material: str, size: int) -> str:
    """First hex digits of the SHA-256 of the text."""
    return f"left(sha2({material}, 256), {size})"


def prefixed_id(prefix: str, material: str, size: int = 24) -> str:
    """Deterministic id ``prefix-<hex>``."""
    return f"concat({lit(prefix + '-')}, {short_hash(material, size)})"


def joined_parts(*parts: str) -> str:
    """Parts joined by the unit separator, null as empty text."""
    return f"concat_ws({lit(chr(31))}, " + ", ".join(f"coalesce(cast({p} AS string), '')" for p in parts) + ")"


def instant_text(ts: str) -> str:
    """Round-trip text of an instant in UTC with seven fraction digits."""
    return f"concat(date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '0+00:00')"


def drop_nulls(labels: str) -> str:
    """Map without null values."""
    return f"map_filter({labels}, (k, v) -> v IS NOT NULL)"


def merge_labels(first: str, second: str) -> str:
    """Two label maps merged; an entry of the second wins, whatever the session's key policy is."""
    none = "cast(map() AS map<string,string>)"
    return (
        f"map_concat(map_filter(coalesce({first}, {none}), (k, v) -> NOT map_contains_key(coalesce({second}, {none}), k)), "
        f"coalesce({second}, {none}))"
    )


def parse_decision(text: str) -> str:
    """Envelope spelling of a configured decision (``redact-and-accept`` and the like)."""
    wanted = text.replace("-", "").lower()
    for decision in DECISIONS:
        if decision.lower() == wanted:
            return decision
    raise ValueError(f"unsupported policy action: {text}")
