"""Trailing price features and the fixed-weight strategy variants.

Every window is guarded by a count: a feature with too little history, or a
missing value inside its window, is null rather than approximated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.clock import decision_time
from ..functions.guards import clip, is_finite
from ..session import materialize, spread
from .bars import by_ticker

TRADING_DAYS = 252
VOL_WINDOW = 20
COMPONENTS = ("momentum_20d", "momentum_60d", "trend_50d", "low_volatility", "reversion")

# Component weights per variant.
VARIANT_WEIGHTS = {
    "momentum": {"momentum_20d": 0.45, "momentum_60d": 0.35, "trend_50d": 0.20},
    "trend_quality": {"trend_50d": 0.40, "momentum_60d": 0.30, "low_volatility": 0.30},
    "reversion": {"reversion": 0.60, "low_volatility": 0.20, "momentum_20d": -0.20},
    "balanced": {"momentum_20d": 0.25, "trend_50d": 0.25, "reversion": 0.25, "low_volatility": 0.25},
    "equal_weight_control": {c: 0.20 for c in COMPONENTS},
}
CONVICTION_FLOOR = 0.20
TARGET_ABS_DELTA = 0.35


def available_rows():
    """Rows of one ticker that have a close, in order.

    Rows without one form a partition of their own, so "the last N sessions"
    skips them without a second scan; hash partitioning by ticker serves both.
    """
    return Window.partitionBy("ticker", F.col("close").isNotNull()).orderBy("date")


def last_rows(n: int):
    return available_rows().rowsBetween(-(n - 1), 0)


def trailing_return(n: int, r: str = "daily_total_return") -> Column:
    """Compounded return over the last n rows; null unless all n are present.

    Works in logs, with the sign of factors below zero and an exact zero kept
    apart, so it equals the plain product.
    """
    w, x = last_rows(n), F.col(r)
    magnitude = F.sum(F.when(x != -1.0, F.log(F.abs(x + 1.0)))).over(w)
    negatives = F.count_if(x < -1.0).over(w)
    wiped = F.count_if(x == -1.0).over(w) > 0
    product = F.when(wiped, F.lit(0.0)).otherwise(F.when(negatives % 2 == 1, -F.exp(magnitude)).otherwise(F.exp(magnitude)))
    return F.when(F.count(x).over(w) == n, product - 1.0)


def distance_from_sma(n: int) -> Column:
    w, c = last_rows(n), F.col("close")
    ok = (F.count(c).over(w) == n) & (F.min(c).over(w) > 0)
    return F.when(ok, c / F.avg(c).over(w) - 1.0)


def realised_volatility(n: int = VOL_WINDOW, r: str = "daily_total_return") -> Column:
    w, x = last_rows(n), F.col(r)
    return F.when(F.count(x).over(w) == n, F.stddev_samp(x).over(w) * F.sqrt(F.lit(float(TRADING_DAYS))))


def drawdown_from_high(n: int = TRADING_DAYS) -> Column:
    w, c = last_rows(n), F.col("close")
    return F.when(F.min(c).over(w) > 0, c / F.max(c).over(w) - 1.0)


def counted_before(df: DataFrame, key: str, place: str, value: str, name: str) -> DataFrame:
    """(key, place, name): of the rows at or before each place (1, 2, ... per key), how many have no greater ``value``.

    Offline order statistics by divide and conquer: places form a binary tree, and
    every earlier row meets a later one in exactly one node, as its left half. A
    row visits one node a level; in a node, one ordering by value counts the left
    half's rows up to each row of the right half.
    """
    rows = df.select(key, F.col(place).alias("_p"), F.col(value).alias("_v"), F.max(place).over(Window.partitionBy(key)).alias("_n"))
    deep = F.ceil(F.log2(F.col("_n").cast("double"))).cast("int")
    at = rows.select(key, "_p", "_v", F.explode(F.when(F.col("_n") > 1, F.sequence(F.lit(0), deep - 1)).otherwise(F.array(F.lit(0)))).alias("_level"))
    low = F.expr("shiftright(_p - 1, _level)")
    at = at.select(key, "_p", "_v", "_level", (low.bitwiseAND(1) == 1).alias("_right"), F.expr("shiftright(_p - 1, _level + 1)").alias("_node"))
    upto = Window.partitionBy(key, "_level", "_node").orderBy("_v", "_right").rowsBetween(Window.unboundedPreceding, 0)
    met = at.select(key, "_p", F.when(F.col("_right"), F.count_if(~F.col("_right")).over(upto)).otherwise(F.lit(0)).alias("_c"))
    return met.groupBy(key, F.col("_p").alias(place)).agg((F.sum("_c") + 1).alias(name))


def with_volatility_percentile(
    df: DataFrame, vol: str = "vol_20d", min_rows: int = VOL_WINDOW + TRADING_DAYS // 4, min_vols: int = 20
) -> DataFrame:
    """Add ``vol_percentile``: where the latest volatility sits in its own past.

    The share of the volatilities so far at or below the latest one; a session
    without one keeps the standing of the last. Values are compared at twelve
    decimals, so windows holding the same returns tie whatever order they were
    summed in.
    """
    known = F.col("close").isNotNull()
    so_far = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(known & ~F.isnan(vol), F.rint(F.col(vol) * 1e12))
    df = df.withColumn("_v", value)
    df = df.select("*", F.count("_v").over(so_far).alias("_nth"), F.count_if(known).over(so_far).alias("_row"))
    ranks = counted_before(df.filter(F.col("_v").isNotNull()), "ticker", "_nth", "_v", "_le")
    share = F.when(known & (F.col("_row") >= min_rows) & (F.col("_nth") >= min_vols), F.col("_le") / F.col("_nth"))
    return df.join(ranks, ["ticker", "_nth"], "left").withColumn("vol_percentile", share).drop("_v", "_nth", "_row", "_le")


def all_features(bars: DataFrame) -> DataFrame:
    """One row per bar; rows without a close carry null features."""
    known = F.col("close").isNotNull()
    measures = {
        "return_20d": trailing_return(20),
        "return_60d": trailing_return(60),
        "distance_from_sma50": distance_from_sma(50),
        "vol_20d": realised_volatility(),
        "drawdown_252d": drawdown_from_high(),
        "bars_available": F.row_number().over(available_rows()).cast("long"),
    }
    df = spread(bars.select("ticker", "date", "close", "daily_total_return"), "ticker")
    df = df.select("ticker", "date", "close", *[F.when(known, m).alias(n) for n, m in measures.items()])
    return with_volatility_percentile(df)


def raw_features(bars: DataFrame) -> DataFrame:
    """Features at each bar that has a close, using that bar and earlier ones."""
    return all_features(bars).filter(F.col("close").isNotNull())


def scale_components(df: DataFrame) -> DataFrame:
    """Scaled components in [-1, 1]; a null feature stays null."""
    return df.select(
        "*",
        clip(F.col("return_20d") / 0.10).alias("momentum_20d"),
        clip(F.col("return_60d") / 0.20).alias("momentum_60d"),
        clip(F.col("distance_from_sma50") / 0.10).alias("trend_50d"),
        clip(F.lit(1.0) - F.col("vol_percentile") * 2.0).alias("low_volatility"),
        clip(-F.col("drawdown_252d") / 0.20).alias("reversion"),
    )


def _punctual_features(bars: DataFrame) -> DataFrame:
    """Per dated bar, the features of the latest earlier bar that has a close."""
    feats = scale_components(all_features(bars))
    names = [c for c in feats.columns if c not in ("ticker", "date")]
    own = F.when(F.col("close").isNotNull(), F.struct(F.col("date").alias("as_of_date"), *names))
    seen = F.last(own, ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, -1))
    return feats.select("ticker", F.col("date").alias("decision_date"), seen.alias("f")).select("ticker", "decision_date", "f.*")


def decision_features(bars: DataFrame) -> DataFrame:
    """Features a decision on each dated bar may see: those of bars received by then.

    A bar that arrives by the next day's decision is on time, and the latest
    earlier bar is the visible one. Decisions taken while an earlier bar was
    still missing are worked out again, each from the bars it could see; these
    are as few as late bars are. A bar without an availability is old stock and
    counts as on time.
    Rows without a close are decisions too; they carry no features of their own.
    """
    punctual = _punctual_features(bars)
    if "available_time" not in bars.columns:
        return punctual
    late = bars.filter(F.col("available_time") > decision_time(F.date_add("date", 1))).select("ticker", F.col("date").alias("late_date"), F.col("available_time").alias("late_time"))
    late = materialize(late, "late-bars")
    if late.isEmpty():
        return punctual
    asked = bars.select("ticker", F.col("date").alias("decision_date")).distinct()
    blind = asked.join(late, "ticker").filter((F.col("late_date") < F.col("decision_date")) & (F.col("late_time") > decision_time("decision_date")))
    blind = materialize(blind.select("ticker", "decision_date").distinct(), "blind-decisions")
    in_time = F.col("available_time").isNull() | (F.col("available_time") <= decision_time("decision_date"))
    seen = bars.join(blind, "ticker").filter((F.col("date") < F.col("decision_date")) & in_time)
    alone = F.concat_ws("|", F.date_format("decision_date", "yyyy-MM-dd"), "ticker")
    feats = scale_components(all_features(seen.select(alone.alias("ticker"), "date", "close", "daily_total_return"))).filter(F.col("close").isNotNull())
    names = [c for c in feats.columns if c not in ("ticker", "date")]
    newest = feats.groupBy("ticker").agg(F.max_by(F.struct(F.col("date").alias("as_of_date"), *names), "date").alias("f"))
    again = newest.select(F.substring("ticker", 1, 10).cast("date").alias("decision_date"), F.expr("substring(ticker, 12)").alias("ticker"), "f.*")
    redone = blind.join(again, ["ticker", "decision_date"], "left").select(punctual.columns)
    return punctual.join(blind, ["ticker", "decision_date"], "left_anti").select(punctual.columns).unionByName(redone)


def variants_table(spark: SparkSession, variants: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(variant, component, weight) with absolute weights summing to one."""
    rows = []
    for name, weights in (variants or VARIANT_WEIGHTS).items():
        total = sum(abs(w) for w in weights.values())
        rows += [(name, c, w / total if total else w, len(weights)) for c, w in weights.items()]
    return spark.createDataFrame(rows, "variant string, component string, weight double, n_weights int")


def weighted_columns(weights: dict[str, float], missing_as_zero: bool = False) -> Column:
    """Weighted sum of component columns, added in the order of the weights."""
    total = sum(abs(w) for w in weights.values()) or 1.0
    acc = None
    for c, w in weights.items():
        x = F.col(c) * F.lit(w / total)
        if missing_as_zero:
            x = F.coalesce(x, F.lit(0.0))
        acc = x if acc is None else acc + x
    return acc


def variant_scores(df: DataFrame, variants: dict[str, dict[str, float]] | None = None, keys: tuple[str, ...] = ("ticker", "decision_date")) -> DataFrame:
    """Score per (row, variant); null plus the missing names when any is absent.

    The variants are a small fixed dimension, so each row expands in place: an
    array of structs is exploded and no join or shuffle is needed.
    """
    cells = []
    for name, weights in (variants or VARIANT_WEIGHTS).items():
        gaps = F.array_compact(F.array(*[F.when(~F.coalesce(is_finite(c), F.lit(False)), F.lit(c)) for c in weights]))
        cells.append(
            F.struct(
                F.lit(name).alias("variant"),
                F.when(F.size(gaps) == 0, weighted_columns(weights)).alias("score"),
                F.concat_ws(", ", gaps).alias("missing"),
            )
        )
    return df.select(*keys, F.explode(F.array(*cells)).alias("v")).select(*keys, "v.*")


def contributions(df: DataFrame, weights: dict[str, float], keys: tuple[str, ...] = ("ticker", "decision_date"), top: int = 3) -> DataFrame:
    """Weighted contribution per indicator, with rank by size then name."""
    total = sum(abs(w) for w in weights.values()) or 1.0
    cells = [
        F.struct(F.lit(c).alias("indicator"), F.col(c).alias("scaled_value"), F.lit(w / total).alias("weight"), (F.col(c) * F.lit(w / total)).alias("contribution"))
        for c, w in sorted(weights.items())
    ]
    usable = F.filter(F.array(*cells), lambda x: x["contribution"].isNotNull() & ~F.isnan(x["contribution"]))
    ranked = F.array_sort(F.transform(usable, lambda x: F.struct((-F.abs(x["contribution"])).alias("neg"), x["indicator"].alias("indicator"), x["contribution"].alias("contribution"))))
    return df.select(
        *keys,
        F.slice(ranked, 1, top).alias("top"),
        F.aggregate(usable, F.lit(0.0), lambda a, x: a + x["contribution"]).alias("contribution_sum"),
        F.size(usable).alias("n_usable"),
        F.array(*cells).alias("indicator_contributions"),
    )
