"""Collects the queries of every plan module."""

from __future__ import annotations

import importlib

MODULES = ("ingest", "keywords", "layout", "ledger", "retrieval", "scalars", "shelving", "streams", "study")


def _modules():
    return [importlib.import_module(f"readlake.plans.{name}") for name in MODULES]


def queries() -> dict:
    found: dict = {}
    for module in _modules():
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found.update(module.ORACLES)
    return found
