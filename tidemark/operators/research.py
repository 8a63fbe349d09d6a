"""Research studies: eligibility, segments, weighting, challenger, holdout review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import clip, is_finite
from ..session import materialize

# Features a study may register.
ALLOWED_FEATURES = (
    "momentum_20d", "momentum_60d", "trend_50d", "low_volatility", "reversion", "delta", "dte", "iv_solved",
    "relative_spread", "round_trip_cost_pct_premium", "theta_pct_premium_per_day",
)
SAMPLES, BLOCK, SEED, LOWER_INDEX = 500, 5, 61, 12


def eligibility(rows: DataFrame, features: list[str], evaluated: Column, allow_synthetic: bool = False) -> DataFrame:
    """Add ``reject_reason``; the first copy of a row id is the only usable one."""
    first = rows.groupBy("row_id").agg(F.min("seq").alias("_first"))
    j = rows.join(first, "row_id", "left")
    numbers = is_finite("net_return")
    for f in features:
        numbers = numbers & is_finite(f)
    times = (F.col("feature_available_utc") > F.col("decision_utc")) | (F.col("label_available_utc") <= F.col("decision_utc")) | (F.col("label_available_utc") > evaluated)
    observed = F.col("provenance") == "OBSERVED_QUOTES"
    if allow_synthetic:
        observed = observed | (F.col("provenance") == "SYNTHETIC_DEMO")
    unknown_time = F.col("decision_utc").isNull() | F.col("feature_available_utc").isNull() | F.col("label_available_utc").isNull()
    reason = (
        F.when((F.coalesce("row_id", F.lit("")) == "") | (F.col("seq") != F.col("_first")) | unknown_time, "invalid_row")
        .when(times, "unavailable_or_invalid_time").when(~F.coalesce(observed, F.lit(False)), "not_observed_quotes")
        .when(~F.coalesce(numbers, F.lit(False)) | (F.coalesce("ticker", F.lit("")) == ""), "invalid_row")
    )
    return j.withColumn("reject_reason", reason).drop("_first")


def purged_segments(rows: DataFrame, edges: dict[str, tuple[str, str]]) -> DataFrame:
    """Role per row; a label resolving in the next segment is purged.

    ``edges``: train, validation, holdout as (start, end) dates in order.
    """
    day, label = F.to_date("decision_utc"), F.to_date("label_available_utc")
    names = list(edges)
    role = F.lit(None).cast("string")
    for i, name in enumerate(names):
        lo, hi = edges[name]
        inside = (day >= F.lit(lo).cast("date")) & (day <= F.lit(hi).cast("date"))
        value = F.lit(name)
        if i + 1 < len(names):
            value = F.when(label >= F.lit(edges[names[i + 1]][0]).cast("date"), "label_overlap_purged").otherwise(name)
        role = F.when(inside, value).otherwise(role)
    return rows.withColumn("role", role)


def inverse_group_weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each (day, ticker) group gets equal weight; weights sum to one.

    The total is simply the number of groups, so no second pass over rows.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    groups = counts.agg(F.count("*").cast("double")).scalar()
    return rows.join(counts, keys).withColumn("weight", F.lit(1.0) / F.col("_n") / groups).drop("_n")


def weighted_moments(rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """One row: weighted mean and scale per feature; scales floored at 1e-6.

    Squares are taken around the mean, so a large mean costs no digits.
    """
    total = F.sum("weight").alias("_w")
    means = rows.groupBy(*keys).agg(total, *[F.sum(F.col("weight") * F.col(f)).alias(f"mean_{f}") for f in features])
    means = means.select(*keys, *[(F.col(f"mean_{f}") / F.col("_w")).alias(f"mean_{f}") for f in features])
    apart = rows.join(means, keys) if keys else rows.crossJoin(F.broadcast(means))
    gap = {f: F.col(f) - F.col(f"mean_{f}") for f in features}
    spread = apart.groupBy(*keys, *[f"mean_{f}" for f in features]).agg(*[(F.sum(F.col("weight") * g * g) / F.sum("weight")).alias(f"_v_{f}") for f, g in gap.items()])
    return spread.select(*keys, *[f"mean_{f}" for f in features], *[F.greatest(F.lit(1e-6), F.sqrt(f"_v_{f}")).alias(f"scale_{f}") for f in features])


def standardize(rows: DataFrame, moments: DataFrame, features: list[str]) -> DataFrame:
    """Replace features by clipped z-scores. ``moments`` is a single row, joined once."""
    named = moments.select(*[F.col(f"{k}_{f}").alias(f"_{k}_{f}") for f in features for k in ("mean", "scale")])
    joined = rows.crossJoin(F.broadcast(named.limit(1)))
    z = {f: clip((F.col(f) - F.col(f"_mean_{f}")) / F.col(f"_scale_{f}"), -10.0, 10.0) for f in features}
    return joined.select(*[z[c].alias(c) if c in z else F.col(c) for c in rows.columns])


def calibration(scored: DataFrame, penalty: float = 0.05, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope that recalibrate logits ``z`` of rows with label and weight.

    The slope is pulled to 1 by a squared penalty and stays in [0, 3]. Newton
    steps; each is one aggregation of five sums.
    """
    a, b = 0.0, 1.0
    w, y, z = F.col("weight"), F.col("label"), F.col("z")
    for _ in range(steps):
        p = F.lit(1.0) / (F.exp(-clip(F.lit(a) + z * b, -40.0, 40.0)) + 1.0)
        e, v = w * (p - y), w * p * (F.lit(1.0) - p)
        g0, g1, h00, h01, h11 = (x or 0.0 for x in scored.agg(F.sum(e), F.sum(e * z), F.sum(v), F.sum(v * z), F.sum(v * z * z)).first())
        g1, h11, h00 = g1 + penalty * (b - 1), h11 + penalty, h00 + 1e-12
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        wanted = min(3.0, max(0.0, b - db))
        if wanted != b - db:  # at a bound the intercept alone is free
            da = (g0 + h01 * (wanted - b)) / h00
        da = min(4.0, max(-4.0, da))
        done = abs(da) + abs(wanted - b) < 1e-10
        a, b = a - da, wanted
        if done:
            break
    return a, b


def segment_status(segments: DataFrame, roles: tuple[str, ...] = ("train", "validation", "holdout"), least: int = 20) -> DataFrame:
    """One row: rows per segment, and whether each has enough for a study."""
    counts = segments.agg(*[F.count_if(F.col("role") == r).alias(r) for r in roles])
    return counts.withColumn("status", F.when(F.least(*roles) < least, "INSUFFICIENT_ELIGIBLE_DATA").otherwise("RESEARCH_REPORT"))


def logistic_challenger(train: DataFrame, validation: DataFrame, holdout: DataFrame, features: list[str]) -> DataFrame:
    """Weighted, regularized logistic fit, recalibrated on validation, scored on holdout.

    Distributed optimizers replace a fixed number of descent steps, so the
    coefficients are the optimum rather than a stopping point near it.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    va = VectorAssembler(inputCols=features, outputCol="x")
    prep = lambda d: va.transform(d.withColumn("label", (F.col("net_return") > 0).cast("double")))
    fit = LogisticRegression(featuresCol="x", weightCol="weight", regParam=0.05, standardization=False, maxIter=100).fit(prep(train))
    logit = lambda d: fit.transform(prep(d)).withColumn("z", vector_to_array("rawPrediction")[1]).drop("x", "rawPrediction", "probability", "prediction")
    a, b = calibration(materialize(logit(validation).select("z", "label", "weight"), "logits"))
    p = F.lit(1.0) / (F.exp(-clip(F.lit(a) + F.col("z") * b, -40.0, 40.0)) + 1.0)
    return logit(holdout).withColumn("probability", p).drop("z", "label")


def holdout_days(scored: DataFrame, probability: str, enter: Column) -> DataFrame:
    """Per day: mean net return of entered trades, Brier score and log loss."""
    won = (F.col("net_return") > 0).cast("double")
    p = F.col(probability)
    miss = F.when(won == 1, p).otherwise(1.0 - p)
    return scored.groupBy(F.to_date("decision_utc").alias("day")).agg(
        F.avg(F.when(enter, F.col("net_return")).otherwise(0.0)).alias("day_return"), F.avg((p - won) * (p - won)).alias("brier"), F.avg(-F.log(F.greatest(F.lit(1e-12), miss))).alias("log_loss"),
        F.count("*").alias("rows"), F.count_if(enter).alias("entered"),
    )


def holdout_metrics(days: DataFrame) -> DataFrame:
    """One row over the holdout days. Days are few, so they are ordered in one task."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    cum = days.withColumn("cum", F.sum("day_return").over(w))
    peak = cum.withColumn("peak", F.greatest(F.lit(0.0), F.max("cum").over(w)))
    return peak.agg(
        F.count("*").alias("observations"), F.sum("rows").alias("rows"), F.avg("day_return").alias("net_expectancy"), F.least(F.lit(0.0), F.min(F.col("cum") - F.col("peak"))).alias("max_drawdown"),
        F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss"), (F.sum("entered") / F.sum("rows")).alias("trade_rate"),
    )


def bootstrap_lower(days: DataFrame, value: str, samples: int = SAMPLES, block: int = BLOCK, seed: int = SEED, rank: int = LOWER_INDEX + 1) -> DataFrame:
    """Circular block bootstrap of the mean of a daily series; its lower quantile.

    Block starts come from md5, so every engine draws the same samples. Work is
    days x samples rows, joined to the series by position.
    """
    w = Window.orderBy("day")
    series = days.select((F.row_number().over(w) - 1).cast("long").alias("pos"), F.col(value).alias("v"))
    n = days.agg(F.count("*")).scalar()
    draws = series.select("pos", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("sample"), F.floor(F.col("pos") / F.lit(block))))
    start = F.conv(F.substring(key, 1, 12), 16, 10).cast("long") % n
    drawn = draws.select("sample", ((start + F.col("pos") % block) % n).alias("pos"))
    means = drawn.join(F.broadcast(series), "pos").groupBy("sample").agg(F.avg("v").alias("m"))
    return means.withColumn("k", F.row_number().over(Window.orderBy("m"))).filter(F.col("k") == rank).select(F.col("m").alias("lower"))


def experiment_problem() -> Column:
    """First rule an experiment row breaks, or null. Features is an array."""
    dates = ["train_start", "train_end", "validation_start", "validation_end", "holdout_start", "holdout_end"]
    d = [F.col(c) for c in dates]
    ordered = (d[0] <= d[1]) & (d[1] < d[2]) & (d[2] <= d[3]) & (d[3] < d[4]) & (d[4] <= d[5])
    blank = F.lit(False)
    for c in ("name", "hypothesis", "signal_version"):
        blank = blank | (F.coalesce(c, F.lit("")) == "")
    f = F.col("features")
    bad = (F.size(f) < 1) | (F.size(F.array_distinct(f)) != F.size(f)) | (F.size(F.array_except(f, F.array(*[F.lit(x) for x in ALLOWED_FEATURES]))) > 0)
    return F.when(~F.coalesce(ordered, F.lit(False)), "dates_not_chronological").when(blank, "identity_missing").when(bad, "features_not_allowed")


def promotion_blockers(minimum: int = 50) -> Column:
    """Reasons a challenger may not go to review; an empty array clears it."""
    c, b = "challenger_", "baseline_"
    numbers = is_finite(f"{c}net_expectancy") & is_finite(f"{b}net_expectancy") & is_finite(f"{c}max_drawdown") & is_finite(f"{b}max_drawdown") & is_finite("lower_improvement")
    valid = F.coalesce(numbers & (F.col(f"{c}max_drawdown") <= 0) & (F.col(f"{b}max_drawdown") <= 0), F.lit(False))
    checks = [
        F.when(F.col(f"{c}observations") < minimum, "insufficient_fresh_holdout_dates"),
        F.when(valid & (F.col(f"{c}net_expectancy") <= F.col(f"{b}net_expectancy")), "expectancy_not_improved"),
        F.when(valid & (F.col(f"{c}max_drawdown") < F.col(f"{b}max_drawdown")), "drawdown_worse"),
        F.when(valid & ~F.coalesce("fresh_holdout", F.lit(False)), "fresh_forward_holdout_not_verified"),
        F.when(valid & ~F.coalesce(F.col(f"{c}cohort") == F.col(f"{b}cohort"), F.lit(False)), "different_or_unknown_cohort"),
        F.when(valid & (F.col("lower_improvement") <= 0), "uncertainty_interval_includes_no_improvement"),
        F.when(~valid, "invalid_or_missing_metrics"),
    ]
    return F.array_compact(F.array(*checks))
