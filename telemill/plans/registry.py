"""All registered queries and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_queries", "event_queries", "source_queries", "log_queries", "state_queries", "stream_queries", "whole_queries", "extension_queries")


def registered() -> dict:
    """Query name to (callable, oracle SQL or None)."""
    found: dict = {}
    for module in MODULES:
        for name, entry in import_module(f"telemill.plans.{module}").build().items():
            if name in found:
                raise ValueError(f"query registered twice: {name}")
            found[name] = entry
    return found
