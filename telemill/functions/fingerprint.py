"""Event fingerprint."""

from __future__ import annotations

from telemill.functions.sqltext import lookup
from telemill.functions.text import instant_text, joined_parts

# The spelling of results inside the fingerprint.
RESULT_NAMES = {"unknown": "Unknown", "success": "Success", "failure": "Failure", "denied": "Denied"}


def result_name(result: str) -> str:
    """Capitalised result."""
    return lookup(result, RESULT_NAMES, result)


def event_fingerprint(prefix: str = "") -> str:
    """``sha256:`` token over the eleven identifying parts; collection times are left out.

    ``prefix`` names the struct that holds the envelope (``'event.'``), empty for columns.
    """
    c = prefix
    material = joined_parts(
        f"{c}eventOriginalId",
        f"{c}eventType",
        f"{c}eventAction",
        f"{c}application.name",
        f"{c}application.environment",
        f"{c}application.tenantId",
        f"coalesce({c}actor.userId, {c}actor.username)",
        f"{c}target.type",
        f"{c}target.id",
        result_name(f"{c}eventResult"),
        instant_text(f"{c}timeGenerated"),
    )
    return f"concat('sha256:', sha2({material}, 256))"
