"""Rank information coefficient per component, cross-sectional or pooled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .calendar import fold_dates
from .features import COMPONENTS
from .running import average_ranks

MIN_NAMES, THIN_UNIVERSE = 3, 5


def long_components(observations: DataFrame, components: tuple[str, ...] = COMPONENTS, keep: tuple[str, ...] = ("decision_date", "excess_log_return")) -> DataFrame:
    return observations.unpivot(list(keep), list(components), "component", "value")


def _spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation of two rank columns whose mean is (n + 1) / 2 by construction.

    Null below three rows or when one side is constant; ranks are multiples of
    one half, so the sums are exact and need no second pass.
    """
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"),
        F.sum(F.col(y) * F.col(y)).alias("syy"),
    )
    n = F.col("n")
    centre = n * (n + 1) * (n + 1) / 4.0
    dx, dy = F.col("sxx") - centre, F.col("syy") - centre
    ic = F.when((n >= MIN_NAMES) & (dx > 0) & (dy > 0), (F.col("sxy") - centre) / (F.sqrt(dx) * F.sqrt(dy)))
    return agg.select(*keys, n, ic.alias("ic"))


def tie_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Tie-averaged rank inside a small group (one date's universe)."""
    w = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0)


def daily_ic(observations: DataFrame, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """(component, decision_date, n, ic). A date's IC does not depend on folds."""
    long = long_components(observations, components)
    keys = ["component", "decision_date"]
    ranked = tie_ranks(tie_ranks(long, keys, "value", "rx"), keys, "excess_log_return", "ry")
    return _spearman(ranked, keys, "rx", "ry")


def upper_median(values: Column) -> Column:
    return F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1)


def fold_ic(observations: DataFrame, calendar: DataFrame, splits: DataFrame, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Cross-sectional IC per (component, fold): mean of the daily readings."""
    test_days = fold_dates(calendar, splits).filter(F.col("role") == "test").select("fold", "decision_date")
    daily = daily_ic(observations, components).join(F.broadcast(test_days), "decision_date")
    return (
        daily.groupBy("component", "fold")
        .agg(
            F.avg("ic").alias("ic"),
            F.count("ic").alias("daily_readings"),
            upper_median(F.collect_list("n")).alias("width"),
            F.sum("n").alias("rows"),
        )
        .filter((F.col("rows") >= MIN_NAMES) & F.col("ic").isNotNull())
    )


def pooled_ic(observations: DataFrame, calendar: DataFrame, splits: DataFrame, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """One correlation per (component, fold) over the whole test window.

    A window can hold 30 dates of a large universe, so ranks go through counted
    distinct values in slices rather than one sort per window.
    """
    test_days = fold_dates(calendar, splits).filter(F.col("role") == "test").select("fold", "decision_date")
    test = observations.join(F.broadcast(test_days), "decision_date")
    long = long_components(test, components, ("fold", "excess_log_return"))
    keys = ["component", "fold"]
    by_value = average_ranks(long, keys, "value", F.floor(F.col("value") * 16.0), "rx")
    by_return = average_ranks(by_value, keys, "excess_log_return", F.floor(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col("excess_log_return"))) * 64.0), "ry")
    return _spearman(by_return, keys, "rx", "ry").filter(F.col("ic").isNotNull())


def ic_summary(per_fold: DataFrame) -> DataFrame:
    """Mean, spread, sign stability and universe width per component."""
    has_width = "width" in per_fold.columns
    base = per_fold if has_width else per_fold.select("*", F.lit(None).cast("long").alias("width"), F.lit(0).cast("long").alias("daily_readings"))
    agg = base.groupBy("component").agg(
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("stdev_ic"),
        F.count("*").alias("folds"),
        F.count_if(F.col("ic") > 0).alias("positive"),
        F.sum("daily_readings").alias("daily_readings"),
        upper_median(F.collect_list("width")).alias("median_universe") if has_width else F.lit(None).cast("long").alias("median_universe"),
    )
    keep = F.when(F.col("mean_ic") > 0, F.col("positive")).when(F.col("mean_ic") < 0, F.col("folds") - F.col("positive"))
    spread = F.when(F.col("folds") >= 2, F.col("stdev_ic"))
    return agg.select(
        "component",
        "folds",
        "mean_ic",
        spread.alias("stdev_ic"),
        (keep / F.col("folds")).alias("hit_rate"),
        F.when(spread > 0, F.col("mean_ic") / (spread / F.sqrt(F.col("folds").cast("double")))).alias("t_stat"),
        "daily_readings",
        "median_universe",
        (F.col("median_universe") < THIN_UNIVERSE).alias("thin_universe"),
    )
