"""Technical indicators and the 0..100 scores built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import clip, rounded
from ..session import spread
from .bars import by_ticker

# Score weights; sentiment carries none.
WEIGHTS = {"technical": 0.5, "momentum": 0.35, "volatility": 0.15}
#: Sessions per block of the exponential means.
BLOCK = 1024
FOREST_FEATURES = ("sma_20", "sma_50", "sma_200", "rsi", "macd", "volume_ratio")


def _full(n: int, value, c: str = "close") -> Column:
    w = by_ticker().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, value(w))


def exponential_mean(df: DataFrame, column: str, span: int, name: str, block: int = BLOCK) -> DataFrame:
    """Add the recursive mean m = q m' + (1 - q) x per ticker, started by its first value, q = 1 - 2 / (span + 1).

    A session is an affine map of the mean before it. Sessions are cut into blocks
    by ``bar_no``; within one the maps compose to a running sum of values weighted
    with powers of q. A block reaches the next one through its last mean alone:
    q to the power of a whole block is far below what a double resolves, so two
    blocks back nothing is left (``block`` times the logarithm of q must stay
    below -40).
    """
    alpha = 2.0 / (span + 1.0)
    q = 1.0 - alpha
    if q**block > 1e-17:
        raise ValueError("a block is too short for this span")
    x = df.withColumn("_block", F.floor((F.col("bar_no") - 1) / F.lit(block))).withColumn("_at", (F.col("bar_no") - 1) % block)
    share = F.when(F.col("bar_no") == 1, 1.0).otherwise(alpha)
    inside = Window.partitionBy("ticker", "_block").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_own", F.sum(share * F.col(column) * F.pow(F.lit(q), -F.col("_at"))).over(inside) * F.pow(F.lit(q), F.col("_at")))
    earlier = Window.partitionBy("ticker").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("_at") == block - 1, F.col("_own")), ignorenulls=True).over(earlier)
    mean = F.col("_own") + F.pow(F.lit(q), F.col("_at") + 1) * F.coalesce(carried, F.lit(0.0))
    return x.withColumn(name, mean).drop("_block", "_at", "_own")


def indicators(bars: DataFrame) -> DataFrame:
    """Moving averages, RSI, MACD, bands, volume ratio and volatility per bar.

    All of it is windows on one partitioning by ticker, exponential averages too.
    """
    df = spread(bars.filter(F.col("close").isNotNull()).select("ticker", "date", "close", "volume"), "ticker")
    prev = F.lag("close").over(by_ticker())
    df = df.select("*", F.coalesce(F.col("close") - prev, F.lit(0.0)).alias("_d"), (F.col("close") / prev - 1.0).alias("returns"), F.log(F.col("close") / prev).alias("log_returns"))
    w14 = by_ticker().rowsBetween(-13, 0)
    gain, loss = F.avg(F.greatest("_d", F.lit(0.0))).over(w14), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(w14)
    df = df.select(
        "*", *[_full(n, lambda w: F.avg("close").over(w)).alias(f"sma_{n}") for n in (20, 50, 200)],
        _full(20, lambda w: F.stddev_samp("close").over(w)).alias("bb_std"), _full(20, lambda w: F.avg("volume").over(w), "volume").alias("volume_sma"),
        _full(20, lambda w: F.stddev_samp("returns").over(w) * F.sqrt(F.lit(252.0)), "returns").alias("volatility"),
        F.when(F.count("close").over(w14) == 14, gain).alias("_gain"), F.when(F.count("close").over(w14) == 14, loss).alias("_loss"), F.row_number().over(by_ticker()).cast("long").alias("bar_no"),
        F.lag("close", 19).over(by_ticker()).alias("close_19_back"), F.lag("close", 49).over(by_ticker()).alias("close_49_back"),
    )
    rsi = F.when(F.col("_loss") == 0, F.when(F.col("_gain") > 0, 100.0)).otherwise(F.lit(100.0) - F.lit(100.0) / (F.try_divide(F.col("_gain"), F.col("_loss")) + 1.0))
    df = df.select(
        "*", rsi.alias("rsi"), (F.col("sma_20") + F.col("bb_std") * 2).alias("bb_upper"), (F.col("sma_20") - F.col("bb_std") * 2).alias("bb_lower"), F.try_divide(F.col("volume"), F.col("volume_sma")).alias("volume_ratio"),
    ).drop("_d", "_gain", "_loss")

    df = exponential_mean(exponential_mean(df, "close", 12, "_fast"), "close", 26, "_slow")
    df = exponential_mean(df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow"), "macd", 9, "signal")
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def latest_rows(ind: DataFrame) -> DataFrame:
    rest = [c for c in ind.columns if c not in ("ticker", "date")]
    return ind.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by(F.struct(*rest), "date").alias("r"), F.count("*").alias("bars")).select("ticker", "date", "bars", "r.*")


def scores(ind: DataFrame) -> DataFrame:
    """Technical, momentum, volatility and overall score on the latest bar."""
    df = latest_rows(ind)
    trend = F.when((F.col("close") > F.col("sma_50")) & (F.col("sma_50") > F.col("sma_200")), 15.0).when((F.col("close") < F.col("sma_50")) & (F.col("sma_50") < F.col("sma_200")), -15.0).otherwise(0.0)
    rsi = F.when(F.col("rsi") < 30, 10.0).when(F.col("rsi") > 70, -10.0).otherwise(0.0)
    macd = F.when(F.col("macd") > F.col("signal"), 10.0).when(F.col("macd").isNotNull() & F.col("signal").isNotNull(), -10.0).otherwise(0.0)
    enough = F.col("bars") >= 50
    mom = F.lit(50.0) + (F.col("close") / F.col("close_19_back") - 1) * 50 + (F.col("close") / F.col("close_49_back") - 1) * 25
    vol = F.lit(50.0) - F.col("volatility") * 100
    df = df.select(
        "ticker", "date", F.when(enough, clip(trend + rsi + macd + 50.0, 0.0, 100.0)).otherwise(50.0).alias("technical"),
        F.when(enough, clip(mom, 0.0, 100.0)).otherwise(50.0).alias("momentum"), F.when(F.col("bars") >= 20, clip(vol, 0.0, 100.0)).otherwise(50.0).alias("volatility_score"),
    )
    overall = F.col("technical") * WEIGHTS["technical"] + F.col("momentum") * WEIGHTS["momentum"] + F.col("volatility_score") * WEIGHTS["volatility"]
    return df.withColumn("overall", overall)


def raw_return_target(bars: DataFrame, horizon: int = 5, threshold: float = 0.02, null_as_zero: bool = False) -> DataFrame:
    """Does the close gain more than ``threshold`` in ``horizon`` bars? Null at the tail."""
    known = bars.filter(F.col("close").isNotNull())
    gain = F.lead("close", horizon).over(by_ticker()) / F.col("close") - 1.0
    target = (gain > threshold).cast("int")
    return known.select("ticker", "date", (F.coalesce(target, F.lit(0)) if null_as_zero else target).alias("target"))


def forest_signals(ind: DataFrame, trees: int = 50, depth: int = 10, seed: int = 42) -> DataFrame:
    """BUY where a forest gives more than 0.55 to a gain over 2 %, else HOLD; gaps abstain.

    The label names both classes, so rows that all fall into one give a model
    that is sure of it; without a complete row every name abstains.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    target = raw_return_target(ind, null_as_zero=True)
    rows = ind.join(target, ["ticker", "date"]).dropna(subset=list(FOREST_FEATURES))
    va = VectorAssembler(inputCols=list(FOREST_FEATURES), outputCol="features")
    last = latest_rows(ind)
    if rows.isEmpty():
        return last.select("ticker", F.lit(None).cast("string").alias("prediction"), F.lit(0.5).alias("confidence"))
    label = F.col("target").cast("double").alias("target", metadata={"ml_attr": {"type": "nominal", "vals": ["0", "1"]}})
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="target").fit(va.transform(rows).select("features", label))
    complete = model.transform(va.transform(last.dropna(subset=list(FOREST_FEATURES)))).select("ticker", vector_to_array("probability")[1].alias("p"))
    signal = F.when(F.col("p") > 0.55, "BUY").otherwise("HOLD")
    return last.select("ticker").join(complete, "ticker", "left").select("ticker", signal.alias("prediction"), F.coalesce(rounded("p", 3), F.lit(0.5)).alias("confidence"))
