"""Lenient scalar readers over VARIANT values, as SQL fragments."""

from __future__ import annotations

from telemill.functions.sqltext import lit

ISO_DATE = r"^\s*\d{4}-\d{2}-\d{2}"


def child(value: str, *keys: str) -> str:
    """Nested member as a variant; null when a step is missing."""
    path = "$" + "".join(f"['{key}']" for key in keys)
    return f"try_variant_get({value}, {lit(path)}, 'variant')" if keys else value


def jstr(value: str, *keys: str) -> str:
    """String, number or boolean member as text; objects, arrays and JSON null give null."""
    member = child(value, *keys)
    # Reading a container as string would print it, but a container is no scalar here.
    return f"IF(left(schema_of_variant({member}), 5) IN ('OBJEC', 'ARRAY'), NULL, try_variant_get({member}, '$', 'string'))"


def jfirst(value: str, *paths: str | tuple[str, ...]) -> str:
    """First readable scalar among several members."""
    return "coalesce(" + ", ".join(jstr(value, *((p,) if isinstance(p, str) else p)) for p in paths) + ")"


def jnum(value: str, *keys: str) -> str:
    """Number member as a double; numeric text does not count."""
    member = child(value, *keys)
    return f"IF(schema_of_variant({member}) IN ('STRING', 'BOOLEAN'), NULL, try_variant_get({member}, '$', 'double'))"


def parse_instant(text: str) -> str:
    """ISO-like text as a timestamp; text without an offset counts as UTC."""
    return f"IF({text} RLIKE {lit(ISO_DATE)}, try_cast({text} AS timestamp), NULL)"


def jtime(value: str, *keys: str) -> str:
    """Text member as a timestamp."""
    return parse_instant(jstr(value, *keys))


def jarray(value: str, *keys: str) -> str:
    """Array member as ``array<variant>``; null for anything else."""
    return f"try_variant_get({child(value, *keys)}, '$', 'array<variant>')"


def jobject(value: str, *keys: str) -> str:
    """Object member as ``map<string,variant>``; null for anything else."""
    return f"try_variant_get({child(value, *keys)}, '$', 'map<string,variant>')"
