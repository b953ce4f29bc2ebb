"""The queries of this package by name, with SQL for those that it can express."""

from __future__ import annotations

import importlib

MODULES = ("pieces", "secrets", "quantiles", "provenance", "neighbours", "duplicates", "tokens", "leaks", "sentences")


def _merge(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"docloom.llm.{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"docloom.llm.{name}":
                raise
            continue
        merged |= getattr(module, attribute)
    return merged


def queries() -> dict:
    return _merge("QUERIES")


def sql() -> dict:
    return _merge("SQL")
