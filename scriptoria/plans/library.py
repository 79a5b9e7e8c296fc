"""The registered queries of the library."""

from __future__ import annotations

import importlib

from scriptoria.plans.registry import ORACLES, QUERIES, Query

MODULES = ("annotations", "catalogue", "changes", "citing", "documents", "duplicates", "entries", "graphs", "identifiers", "intake", "records", "retrieval", "shelves", "streams")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"scriptoria.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
