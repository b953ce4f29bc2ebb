"""All queries of the core library by name, with the SQL that each is checked against."""

from __future__ import annotations

import importlib

MODULES = ("operators.runs", "operators.changes", "operators.coupling", "operators.facts", "operators.segments", "operators.retrieval", "operators.sections", "operators.pages", "operators.profile", "operators.checks", "operators.interface", "operators.indexing", "operators.judged", "operators.composed", "operators.evidence", "streaming.events")


def _merge(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged |= getattr(importlib.import_module(f"docloom.{name}"), attribute)
    return merged


def queries() -> dict:
    return _merge("QUERIES")


def oracle_sql() -> dict:
    return _merge("SQL")
