"""Forward labels against a benchmark aligned by date, failing closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import decision_time
from ..functions.guards import INF
from ..session import spread
from .bars import by_ticker, log_growth

HORIZON = 5
BENCHMARK = "SPY"


def benchmark_returns(bars: DataFrame, benchmark: str) -> DataFrame:
    return bars.filter(F.col("ticker") == benchmark).select("date", F.col("daily_total_return").alias("bench_return"))


def with_benchmark(bars: DataFrame, benchmark: str) -> DataFrame:
    """Left join by date. The benchmark side is one row per trading session."""
    return bars.join(F.broadcast(benchmark_returns(bars, benchmark)), "date", "left")


def _window_log_return(r: str, horizon: int) -> Column:
    """Sum of log growth over the next ``horizon`` rows; any total loss wins."""
    w = by_ticker().rowsBetween(1, horizon)
    return F.when(F.min(r).over(w) <= -1.0, F.lit(-INF)).otherwise(F.sum(F.when(F.col(r) > -1.0, F.log1p(r))).over(w))


def excess_and_sign(inst: Column, bench: Column, is_benchmark: Column) -> tuple[Column, Column]:
    """(excess, y). Two total losses give NaN excess, which is not positive."""
    excess = F.when(is_benchmark, inst).otherwise(inst - bench)
    y = F.when(excess.isNotNull(), F.when(F.isnan(excess), 0).otherwise((excess > 0).cast("int")))
    return excess, y


def build_labels(bars: DataFrame, benchmark: str = BENCHMARK, horizon: int = HORIZON) -> DataFrame:
    """One label per dated bar, unresolved tail included.

    The benchmark return is joined once per bar, so both forward sums come from
    the same window sort instead of collecting per-decision arrays.
    """
    w = by_ticker().rowsBetween(1, horizon)
    df = spread(with_benchmark(bars.select("ticker", "date", "daily_total_return"), benchmark), "ticker")

    def gap_first(r: str) -> Column:
        # A total loss before the first gap already decides the sum.
        gap = F.min(F.when(F.col(r).isNull(), F.col("date"))).over(w)
        loss = F.min(F.when(F.col(r) <= -1.0, F.col("date"))).over(w)
        return gap.isNotNull() & (loss.isNull() | (gap < loss))

    df = df.select(
        "ticker",
        F.col("date").alias("decision_date"),
        F.count(F.lit(1)).over(w).alias("n_forward"),
        gap_first("daily_total_return").alias("inst_gap"),
        gap_first("bench_return").alias("bench_gap"),
        _window_log_return("daily_total_return", horizon).alias("inst_lr"),
        _window_log_return("bench_return", horizon).alias("bench_lr"),
    )
    is_bench = F.col("ticker") == benchmark
    status = (
        F.when(F.col("n_forward") < horizon, "INSUFFICIENT_FORWARD_BARS")
        .when(F.col("inst_gap"), "RETURN_GAP_UNRESOLVED")
        .when(~is_bench & F.col("bench_gap"), "RETURN_GAP_UNRESOLVED")
        .otherwise("OK")
    )
    df = df.withColumn("status", status)
    excess, y = excess_and_sign(F.col("inst_lr"), F.col("bench_lr"), is_bench)
    ok = F.col("status") == "OK"
    return df.select(
        "ticker",
        "decision_date",
        decision_time("decision_date").alias("decision_time_utc"),
        F.when(ok, y).alias("y"),
        F.when(ok, excess).alias("excess_log_return"),
        "status",
        F.when(ok, y).isNotNull().alias("usable"),
    )


def labels_from_arrays(inputs: DataFrame, benchmark: str = BENCHMARK, horizon: int = HORIZON) -> DataFrame:
    """Label rows that already carry their forward return arrays.

    Columns: ticker, decision_date, fwd_returns, bench_returns,
    corporate_action_resolved, delisted, delisting_return. Each array holds one
    horizon, so folding it in place is bounded.
    """
    inst = F.col("fwd_returns")
    last = F.element_at(inst, -1)
    dlret = F.col("delisting_return")
    merged = F.when(F.size(inst) == 0, F.array(dlret)).otherwise(
        F.concat(F.slice(inst, 1, F.greatest(F.size(inst) - 1, F.lit(0))), F.array((last + 1.0) * (dlret + 1.0) - 1.0))
    )
    df = inputs.withColumn(
        "inst",
        F.when(F.col("delisted") & dlret.isNull(), F.concat(inst, F.array(F.lit(-1.0))))
        .when(F.col("delisted"), merged)
        .otherwise(inst),
    ).withColumn("imputed", F.col("delisted") & dlret.isNull())

    def fold(arr: Column) -> Column:
        # null = gap met first; -inf = total loss met first and final.
        return F.aggregate(
            arr,
            F.lit(0.0),
            lambda acc, r: F.when(acc == -INF, acc).when(acc.isNull() | r.isNull(), F.lit(None)).otherwise(acc + log_growth(r)),
        )

    bench = F.slice(F.col("bench_returns"), 1, F.greatest(F.size("inst"), F.lit(1)))
    is_bench = F.col("ticker") == benchmark
    df = df.withColumn("inst_lr", fold(F.col("inst"))).withColumn("bench_lr", fold(bench))
    status = (
        F.when(~F.col("corporate_action_resolved"), "CORPORATE_ACTION_UNRESOLVED")
        .when(~F.col("delisted") & (F.size("inst") < horizon), "INSUFFICIENT_FORWARD_BARS")
        .when(F.size("bench_returns") < F.least(F.size("inst"), F.lit(horizon)), "INSUFFICIENT_FORWARD_BARS")
        .when(F.col("inst_lr").isNull(), "RETURN_GAP_UNRESOLVED")
        .when(~is_bench & F.col("bench_lr").isNull(), "RETURN_GAP_UNRESOLVED")
        .otherwise("OK")
    )
    df = df.withColumn("status", status)
    excess, y = excess_and_sign(F.col("inst_lr"), F.col("bench_lr"), is_bench)
    ok = F.col("status") == "OK"
    resolved = F.col("status") != "CORPORATE_ACTION_UNRESOLVED"
    return df.select(
        "ticker",
        "decision_date",
        F.when(ok, y).alias("y"),
        F.when(ok, excess).alias("excess_log_return"),
        "status",
        (ok & F.col("imputed")).alias("delisting_return_imputed"),
        (ok & F.when(ok, y).isNotNull() & ~(resolved & F.col("imputed"))).alias("usable"),
    )


def label_coverage(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Per ticker: bars, dates, last close, usable and unresolved labels, base rate."""
    b = bars.groupBy("ticker").agg(
        F.count("*").alias("bars"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("last_close"),
        F.count("daily_total_return").alias("usable_returns"),
        F.count_if(F.col("daily_total_return").isNull()).alias("gap_rows"),
    )
    l = labels.groupBy("ticker").agg(
        F.count("*").alias("labels_total"),
        F.count_if("usable").alias("labels_usable"),
        F.count_if(F.col("usable") & (F.col("y") == 1)).alias("ones"),
    )
    return b.join(l, "ticker", "left").select(
        *b.columns,
        "labels_total",
        "labels_usable",
        (F.col("labels_total") - F.col("labels_usable")).alias("labels_unresolved"),
        F.try_divide(F.col("ones"), F.col("labels_usable")).alias("base_rate_y1"),
    )


def usable_against(bars: DataFrame, labels: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """Labels, or only the benchmark's own, when it has no usable return at all.

    Another benchmark is never substituted.
    """
    has = bars.filter(F.col("ticker") == benchmark).agg((F.count("daily_total_return") > 0).alias("has_benchmark"))
    return labels.filter(has.scalar() | (F.col("ticker") == benchmark))


def forward_returns(bars: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Per bar with a close: its stored return, else the plain close ratio."""
    known = bars.filter(F.col("close").isNotNull())
    prev = F.lag("close").over(by_ticker())
    return known.select(
        "ticker", "date", "close", F.coalesce("daily_total_return", F.col("close") / prev - 1.0).alias("forward_return")
    )


def with_excess_return(labels: DataFrame) -> DataFrame:
    """Add excess_return_pct, the plain return behind the logarithmic one; null where that is."""
    return labels.withColumn("excess_return_pct", F.expm1("excess_log_return"))
