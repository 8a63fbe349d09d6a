"""Daily-bar normalization: returns, chain breaks, split guard.

A window here spans one ticker's sessions. (ticker, date) is unique once
vintages are resolved, so a partition is bounded by the number of trading days
that exist, however large the universe grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import bar_available_time, bar_event_time
from ..functions.guards import INF, rounded
from ..session import spread

SPLIT_MATERIALITY = 2.0
SPLIT_TOLERANCE = 0.15


def by_ticker() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def daily_total_return(bars: DataFrame) -> DataFrame:
    """Add ``daily_total_return`` = (close + dividend) / previous close - 1.

    ``lag`` keeps null closes in place, so a row after a gap has no prior close
    and no return: the chain breaks instead of bridging.
    """
    prev = F.lag(F.when(_present("close"), F.col("close"))).over(by_ticker())
    return bars.withColumn("prev_close", prev).withColumn(
        "daily_total_return",
        F.when(
            _present("close") & (F.col("prev_close") > 0),
            (F.col("close") + F.coalesce("dividend", F.lit(0.0))) / F.col("prev_close") - 1.0,
        ),
    )


def split_verdicts(bars: DataFrame, materiality: float = SPLIT_MATERIALITY, tolerance: float = SPLIT_TOLERANCE) -> DataFrame:
    """Per split on the bars: do the closes around it look adjusted?"""
    w = by_ticker()
    prev = F.lag("close").over(w)
    df = bars.withColumn("prev_close", prev).filter(F.col("split").isNotNull() & (F.col("split") != 0))
    ratio, close, prior = F.col("split"), F.col("close"), F.col("prev_close")
    usable = _present("close") & (close > 0) & _present("prev_close") & (prior > 0)
    raw_move = F.lit(1.0) / ratio
    observed = close / prior
    immaterial = (ratio > 1.0 / materiality) & (ratio < materiality)
    checkable = (ratio > 0) & ~immaterial & usable
    return df.select(
        "ticker",
        "date",
        F.col("split").alias("ratio"),
        F.when(~(ratio > 0), "UNCHECKABLE")
        .when(immaterial, "IMMATERIAL")
        .when(~usable, "UNCHECKABLE")
        .when(F.abs(observed - raw_move) <= raw_move * tolerance, "UNADJUSTED")
        .otherwise("ADJUSTED")
        .alias("verdict"),
        F.when(checkable, observed).alias("observed_ratio"),
        F.when(ratio > 0, raw_move).alias("expected_if_raw"),
    )


def normalize_bars(bars: DataFrame, tolerance: float = SPLIT_TOLERANCE, materiality: float = SPLIT_MATERIALITY) -> DataFrame:
    """Raw bars to timestamped bars with a return and a status.

    The split test reads the same previous close as the return, so one window
    pass serves both. A flagged date loses only its own return, and says which
    ratio was announced and how far the close moved. Prices that the raw bars lack
    stay null.
    """
    df = daily_total_return(spread(bars, "ticker"))
    known = _present("close") & F.col("date").isNotNull()
    ratio = F.col("split")
    raw_move = F.lit(1.0) / ratio
    material = (ratio > 0) & ~((ratio > 1.0 / materiality) & (ratio < materiality))
    unadjusted = F.coalesce(
        F.when(
            known & material & (F.col("close") > 0) & (F.col("prev_close") > 0),
            F.abs(F.col("close") / F.col("prev_close") - raw_move) <= raw_move * tolerance,
        ),
        F.lit(False),
    )
    ret = F.when(known & ~unadjusted, F.col("daily_total_return"))
    status = (
        F.when(~known, "UNKNOWN")
        .when(unadjusted, "SPLIT_UNADJUSTED")
        .when(F.col("daily_total_return").isNull(), "NO_PRIOR_CLOSE")
        .otherwise("OK")
    )
    moved = F.format_string("a split of %.2f was announced and the close moved by a factor of %.4f", ratio, rounded(F.col("close") / F.col("prev_close"), 4))
    price = lambda c: F.when(known, F.col(c) if c in bars.columns else F.lit(None).cast("double")).alias(c)
    return df.select(
        "ticker",
        "date",
        F.when(known, bar_event_time("date")).alias("event_time"),
        F.when(known, bar_available_time("date")).alias("available_time"),
        *[price(c) for c in ("open", "high", "low")],
        F.when(known, F.col("close")).alias("close"),
        "volume",
        F.when(known, F.coalesce("dividend", F.lit(0.0))).alias("dividend"),
        ret.alias("daily_total_return"),
        status.alias("status"),
        F.when(unadjusted, ratio).alias("split_ratio"),
        F.when(unadjusted, moved).alias("reason"),
    )


def log_growth(r: Column) -> Column:
    """log1p of a return; a total loss is minus infinity."""
    return F.when(r <= -1.0, F.lit(-INF)).otherwise(F.log1p(r))
