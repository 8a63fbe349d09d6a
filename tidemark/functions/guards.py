"""Null, NaN and infinity guards, and typed-number checks, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True only for a real number: null, NaN and both infinities are false.

    Spark orders NaN above infinity, so one comparison tells them all.
    """
    return F.coalesce(F.abs(col(c)) < F.lit(INF), F.lit(False))


def finite_or_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(is_finite(x), x)


def rounded(c: str | Column, digits: int) -> Column:
    """Round half to even on the binary value; ``+ 0.0`` removes negative zero."""
    scale = F.lit(float(10**digits))
    return F.rint(col(c) * scale) / scale + F.lit(0.0)


def settled(c: str | Column, digits: int) -> Column:
    """Round for storage or comparison, away from short-decimal ties.

    Sums taken in another order differ in the last bits; a small fixed offset
    keeps values that sit exactly on a rounding tie from landing on both sides.
    """
    scale = F.lit(float(10**digits))
    return F.rint(col(c) * scale + F.lit(0.000137)) / scale + F.lit(0.0)


def clip(c: str | Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Clamp to [low, high]; null stays null (greatest/least would skip it)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def parsed_number(c: str | Column) -> Column:
    """Vendor text to a finite double, or null when it is not one."""
    return finite_or_null(col(c).try_cast("double"))


def truncated_count(c: str | Column) -> Column:
    """Non-negative count from vendor text; a fraction is cut off."""
    x = parsed_number(c)
    return F.when((x >= 0) & (x < F.lit(9.0e18)), F.floor(x).cast("long"))


def whole_count(c: str | Column) -> Column:
    """Non-negative count that must already be whole; fractions become null."""
    x = parsed_number(c)
    return F.when((x >= 0) & (x < F.lit(9.0e18)) & (x == F.floor(x)), F.floor(x).cast("long"))


# Fixed format: ISO date-time with an explicit zone (Z or +hh:mm).
ISO_WITH_ZONE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"


def zoned_timestamp(c: str | Column) -> Column:
    """ISO text to a UTC instant; text without an explicit zone becomes null."""
    x = F.trim(col(c))
    return F.when(x.rlike(ISO_WITH_ZONE), x.try_cast("timestamp"))


def number_reject_reason(c: str | Column, minimum: float | None = None, whole: bool = False) -> Column:
    """Why a text value is not an acceptable number; null when it is.

    Order of checks: missing, boolean, not a number, not finite, below the
    minimum, not whole.
    """
    x = F.lower(F.trim(col(c)))
    value = x.try_cast("double")
    reason = (
        F.when(x.isNull(), "missing")
        .when(x.isin("true", "false"), "boolean")
        .when(value.isNull(), "not_a_number")
        .when(F.isnan(value) | (F.abs(value) == F.lit(INF)), "not_finite")
    )
    if minimum is not None:
        reason = reason.when(value < F.lit(float(minimum)), "below_minimum")
    if whole:
        reason = reason.when(value != F.rint(value), "not_whole")
    return reason
