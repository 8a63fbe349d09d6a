"""Market clock: New York wall time to UTC and back, DST-correct."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .guards import col

MARKET_ZONE = "America/New_York"
CLOSE_HOUR = 16
AVAILABILITY_LAG_HOURS = 17
DECISION_HOUR, DECISION_MINUTE = 15, 45


def wall_to_utc(date: str | Column, hours: int, minutes: int = 0) -> Column:
    """UTC instant of a New York wall time on ``date``; hours past 24 roll over.

    The offset is added to the local value before conversion, so an hour lag
    never drifts across a clock change.
    """
    local = col(date).cast("timestamp") + F.expr(f"INTERVAL '{hours * 60 + minutes}' MINUTE")
    return F.to_utc_timestamp(local, MARKET_ZONE)


def bar_event_time(date: str | Column) -> Column:
    return wall_to_utc(date, CLOSE_HOUR)


def bar_available_time(date: str | Column) -> Column:
    return wall_to_utc(date, CLOSE_HOUR + AVAILABILITY_LAG_HOURS)


def decision_time(date: str | Column) -> Column:
    return wall_to_utc(date, DECISION_HOUR, DECISION_MINUTE)


def market_date(instant: str | Column) -> Column:
    """New York calendar date of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(col(instant), MARKET_ZONE))
