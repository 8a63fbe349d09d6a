"""Query registry and the shared SQL fragments of the comparison queries."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, tuple[str, str]] = {}
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn`` under ``name``; ``uses`` names the SQL fragments it needs."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (sql, uses)
        return fn

    return wrap


def fragment(name: str, text: str, uses: str = "") -> None:
    FRAGMENTS[name] = (tuple(uses.split()), text)


def compose(final: str, uses: str = "") -> str:
    """``final`` below the WITH clause of the fragments it needs, in order."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in done:
            return
        needs, text = FRAGMENTS[name]
        for n in needs:
            visit(n)
        done[name] = text

    for n in uses.split():
        visit(n)
    if not done:
        return final
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in done.items())
    body = final.lstrip()
    tail = f",\n{body[5:]}" if body.startswith("WITH ") else f"\n{body}"
    return f"WITH RECURSIVE {ctes}{tail}"


def R(expr: str, digits: int) -> str:
    """SQL text: half-even rounding on the binary value, no negative zero."""
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0.0)"


def S(expr: str, digits: int) -> str:
    """SQL text twin of ``guards.settled``."""
    return f"(round_even(({expr}) * 1e{digits} + 0.000137::DOUBLE, 0) / 1e{digits} + 0.0)"


def ET(date: str, minutes: int) -> str:
    """SQL text: naive UTC instant of a New York wall time on ``date``."""
    return (
        f"timezone('UTC', timezone('America/New_York', CAST({date} AS TIMESTAMP) + INTERVAL '{minutes} minutes'))"
    )
