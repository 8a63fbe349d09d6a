"""Registered queries: each a Spark plan and, where SQL can say it, its twin."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES, compose

MODULES = ("study", "pit", "trading", "options", "picks", "research", "ingest", "streams")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return {name: compose(sql, uses) for name, (sql, uses) in ORACLES.items()}
