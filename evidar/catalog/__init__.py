"""Registered queries over the given tables, each beside its SQL twin."""

from __future__ import annotations

from importlib import import_module

MODULES = ["text", "retrieval", "index", "answers", "sessions", "streams", "evaluation", "records"]


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"evidar.catalog.{name}"), attribute))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
