"""Option chains in bulk: enrichment, costs, screens, eligibility, ranking."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import is_finite, rounded
from ..functions.pricing import with_solved_model, years_to_expiry
from .asof import asof_backward
from .gate import Limits, with_gate

COMMISSION, EXCHANGE_FEE, SPREAD_CAPTURE, EQUITY_SLIPPAGE_BPS = 0.65, 0.15, 0.5, 1.0
DELTA_TOLERANCE, PREFERRED_DTE = 0.08, 40
RISK_FREE = 0.04
MODES = ("delta", "cost_aware")
#: Contracts of one key that a single task may order.
BUSY_ROWS = 1_000_000
SELECTION_VERSION, VALIDATION_STATUS, QUOTE_AGE_STATUS = "1.0.0", "UNVALIDATED_RESEARCH_POLICY", "UNVERIFIED"
AUDIT_NOTE = "Alternative identities are not independently resolved trades or evidence of edge."


def usable_quote(bid: str = "bid", ask: str = "ask") -> Column:
    b, a = F.col(bid), F.col(ask)
    return F.coalesce((b > 0) & (a > 0) & (a >= b), F.lit(False))


def round_trip_cost(contracts: int = 1) -> Column:
    """Buy at ask, sell at bid, plus both sides' fees; null on an unusable quote."""
    fees = 2 * contracts * (COMMISSION + EXCHANGE_FEE)
    return F.when(usable_quote(), rounded((F.col("ask") - F.col("bid")) * 100.0 * contracts + fees, 2))


def half_spread_fill(side: str) -> Column:
    sign = F.when(F.col(side) == "BUY", 1.0).otherwise(-1.0)
    mid, half = (F.col("bid") + F.col("ask")) / 2, (F.col("ask") - F.col("bid")) / 2
    return F.when(usable_quote(), rounded(mid + sign * half * SPREAD_CAPTURE, 4))


def equity_fill(mid: str, side: str, spread: str) -> Column:
    sign = F.when(F.col(side) == "BUY", 1.0).otherwise(-1.0)
    return F.col(mid) + sign * (F.col(spread) / 2 * SPREAD_CAPTURE + F.col(mid) * (EQUITY_SLIPPAGE_BPS / 10000))


def tradeable_reason(age_seconds: str, max_age: int = 60, max_spread: float = 0.10) -> Column:
    """First reason a quote is not tradeable, or null."""
    b, a = F.col("bid"), F.col("ask")
    return (
        F.when((b <= 0) | (a <= 0), "non-positive quote").when(a < b, "crossed quote")
        .when(F.col(age_seconds) > max_age, "stale quote").when(F.try_divide(a - b, (a + b) / 2) > max_spread, "spread too wide")
    )


def underlying_context(snapshots: DataFrame, bars: DataFrame) -> DataFrame:
    """Per (ticker, snapshot_date): last earlier close, its date, trailing yield.

    Dividends come from a running total read at two dates, so a one-year sum
    costs two as-of matches instead of a range join. Input rows are unique.
    """
    total = F.sum(F.coalesce("dividend", F.lit(0.0))).over(Window.partitionBy("ticker").orderBy("date"))
    b = bars.select("ticker", "date", "close", total.alias("paid"))
    # A row without a close carries no dividend either, so one match reads both.
    closes = b.filter(F.col("close").isNotNull()).select("ticker", "date", F.col("date").alias("underlying_close_date"), F.col("close").alias("underlying_close"), "paid")
    paid = b.select("ticker", "date", "paid")
    width = 86400 * 90
    s = asof_backward(snapshots, closes, "ticker", "snapshot_date", "date", ["underlying_close_date", "underlying_close", "paid"], strict=True, bucket_seconds=width)
    s = s.withColumn("_year_ago", F.add_months("snapshot_date", -12)).withColumnRenamed("paid", "_upto")
    s = asof_backward(s, paid, "ticker", "_year_ago", "date", ["paid"], strict=True, bucket_seconds=width)
    cash = F.coalesce("_upto", F.lit(0.0)) - F.coalesce("paid", F.lit(0.0))
    y = F.when((F.col("underlying_close") > 0) & (cash > 0), cash / F.col("underlying_close")).otherwise(0.0)
    return s.select(*snapshots.columns, "underlying_close_date", "underlying_close", y.alias("dividend_yield"))


def screens(limits: Limits = Limits()) -> dict[str, Column]:
    """Liquidity screens; an unknown value fails its screen."""
    no = F.lit(False)
    return {
        "screen_dte": F.coalesce((F.col("dte") >= limits.min_dte) & (F.col("dte") <= limits.max_dte), no),
        "screen_spread": F.coalesce(F.col("relative_spread") <= limits.max_relative_spread, no),
        "screen_open_interest": F.coalesce(F.col("open_interest") >= limits.min_open_interest, no),
        "screen_volume": F.coalesce(F.col("volume") >= limits.min_daily_volume, no),
    }


def days_to_expiry() -> Column:
    days = F.datediff("expiration", "snapshot_date")
    return F.when(days > 0, days)


def passes_unquoted(chain: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``chain`` without contracts that fail a screen which needs no quote; they may be left out before one is made."""
    tests = screens(limits)
    df = chain.withColumn("dte", days_to_expiry())
    return df.filter(tests["screen_dte"] & tests["screen_open_interest"] & tests["screen_volume"]).drop("dte")


def enrich_chain(chain: DataFrame, context: DataFrame, rate: float = RISK_FREE, limits: Limits = Limits(), liquid_only: bool = False, liquid_model: bool = False) -> DataFrame:
    """Observed contracts plus solved volatility, Greeks, cost, screens and gate.

    ``chain``: ticker, snapshot_date, kind, expiration, strike, bid, ask, mid,
    volume, open_interest, status. The solver sees only rows that reach it. With
    ``liquid_only``, contracts that fail a screen, which needs no model, are left
    out before the solver; none of them can be eligible. With ``liquid_model``, all
    contracts stay and have their status, but volatility and Greeks only where the
    screens pass: whether a price can be solved takes two prices, not a search.
    """
    df = chain.join(context, ["ticker", "snapshot_date"], "left")
    t = years_to_expiry("snapshot_date", "expiration")
    r = F.lit(rate)
    two_sided = (F.col("status") == "OK") & F.col("mid").isNotNull()
    df = df.withColumn("t_years", t).withColumn("dte", days_to_expiry())
    df = df.withColumn("relative_spread", F.try_divide(F.col("ask") - F.col("bid"), F.col("mid")))
    if liquid_only:
        for screen in screens(limits).values():
            df = df.filter(screen)
    ready = two_sided & F.col("underlying_close").isNotNull() & F.col("t_years").isNotNull() & F.col("kind").isin("CALL", "PUT")
    gated = lambda c: F.when(ready, F.col(c))
    wanted = reduce(and_, screens(limits).values()) if liquid_model else None
    df = with_solved_model(df, gated("mid"), gated("underlying_close"), gated("strike"), gated("t_years"), r, F.coalesce("dividend_yield", F.lit(0.0)), F.col("kind"), wanted)
    model = (
        F.when(~F.coalesce(two_sided, F.lit(False)), "NO_TWO_SIDED_QUOTE")
        .when(F.col("underlying_close").isNull(), "NO_AVAILABLE_UNDERLYING_BAR")
        .when(F.col("t_years").isNull(), "EXPIRED_OR_BAD_DATE")
        .when(~F.col("kind").isin("CALL", "PUT"), "UNKNOWN_OPTION_TYPE")
        .when(~F.col("solvable"), "IV_UNSOLVABLE_FROM_MID")
        .otherwise("OK")
    )
    df = df.select("*", model.alias("model_status"), round_trip_cost().alias("round_trip_cost_1x")).drop("solvable")
    df = df.select("*", *[c.alias(n) for n, c in screens(limits).items()])
    passed = F.col("screen_dte") & F.col("screen_spread") & F.col("screen_open_interest") & F.col("screen_volume")
    known = {"dte": F.col("dte"), "relative_spread": F.col("relative_spread"), "open_interest": F.col("open_interest"), "daily_volume": F.col("volume"), "defined_risk": F.lit(True)}
    return with_gate(df.withColumn("liquidity_screen", F.when(passed, "PASS").otherwise("FAIL")), known, limits)


def eligible(limits: Limits = Limits()) -> Column:
    """Row re-validation that trusts no upstream flag alone.

    A comparison with null is no match, and NaN is above infinity: a range with
    both ends also tells that a number is known and finite, so none is tested twice.
    """
    inf = F.lit(float("inf"))
    b, m, a, d, cost, iv = (F.col(c) for c in ("bid", "mid", "ask", "delta", "round_trip_cost_1x", "iv_solved"))
    sane = F.col("expiration").isNotNull() & (cost >= 0) & (cost < inf) & (b > 0) & (b <= m) & (m <= a) & (a < inf)
    for c in ("strike", "underlying_close"):
        sane = sane & (F.col(c) > 0) & (F.col(c) < inf)
    for c in ("gamma", "theta_per_day", "vega"):
        sane = sane & F.coalesce(F.abs(c) < inf, F.lit(True))
    sign = ((F.col("kind") == "CALL") & (d > 0) & (d <= 1)) | ((F.col("kind") == "PUT") & (d >= -1) & (d < 0))
    spread = F.try_divide(a - b, (a + b) / 2)
    liquid = (
        (F.col("dte") >= limits.min_dte) & (F.col("dte") <= limits.max_dte) & (F.col("relative_spread") >= 0) & (F.col("relative_spread") <= limits.max_relative_spread)
        & (spread <= limits.max_relative_spread) & (F.col("open_interest") >= limits.min_open_interest) & (F.col("volume") >= limits.min_daily_volume)
    )
    flags = (F.col("model_status") == "OK") & (F.col("liquidity_screen") == "PASS") & (iv > 0) & (iv < inf)
    return F.coalesce(flags & sane & sign & liquid, F.lit(False))


def selection_metrics(target_abs_delta: float, tolerance: float = DELTA_TOLERANCE, preferred_dte: int = PREFERRED_DTE) -> dict[str, Column]:
    gap = F.abs(F.abs("delta") - target_abs_delta)
    premium = F.when(F.col("ask") > 0, F.col("ask"))
    return {
        "delta_gap": gap,
        "inside_delta_tolerance": F.coalesce(gap <= tolerance + 1e-12, F.lit(False)),
        "round_trip_cost_pct_premium": F.col("round_trip_cost_1x") / premium / 100.0,
        "theta_pct_premium_per_day": F.greatest(-F.col("theta_per_day"), F.lit(0.0)) / premium,
        "signed_theta_pct_premium_per_day": F.col("theta_per_day") / premium,
        "dte_distance": F.abs(F.col("dte") - preferred_dte),
    }


def ranking_key(mode: str, digits: int = 9) -> list[Column]:
    """Ascending sort key; unknown values sort last, identity breaks ties.

    Model values enter at nine decimals so equal contracts rank alike whatever
    produced them.
    """
    inf = F.lit(float("inf"))
    v = lambda c: F.coalesce(rounded(c, digits), inf)
    identity = [F.col("expiration").cast("string"), F.coalesce("strike", F.lit(0.0)), F.col("kind"), F.col("contract_symbol")]
    if mode == "delta":
        return [v("delta_gap"), v("relative_spread"), *identity]
    if mode != "cost_aware":
        raise ValueError("selection mode must be delta or cost_aware")
    economics = [
        v("round_trip_cost_pct_premium"), v("delta_gap"), v("theta_pct_premium_per_day"), v(F.col("dte_distance").cast("double")), v("relative_spread"),
        -F.coalesce("open_interest", F.lit(0)), -F.coalesce("volume", F.lit(0)),
    ]
    outside = F.when(F.col("inside_delta_tolerance"), 0).otherwise(1)
    fallback = F.when(F.col("inside_delta_tolerance"), F.lit(0.0)).otherwise(v("delta_gap"))
    return [outside, fallback, *economics, *identity]


def packed_key(mode: str) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ranking_key(mode))])


def best_contracts(rows: DataFrame, keys: list[str], mode: str, payload: list[str]) -> DataFrame:
    """Top contract per key: a minimum over a packed key, combined before the shuffle."""
    best = rows.groupBy(*keys).agg(F.min(F.struct(packed_key(mode).alias("k"), F.struct(*payload).alias("row"))).alias("b"), F.count("*").alias("eligible_count"))
    return best.select(*keys, "eligible_count", "b.row.*")


def top_contracts(rows: DataFrame, keys: list[str], mode: str, n: int = 5, salts: int = 8) -> DataFrame:
    """First ``n`` ranked contracts per key.

    Ranked inside hashed slices first, so a key with most of the rows is cut
    down in parallel before the final ordering of n rows per slice.
    """
    k = rows.withColumn("_k", packed_key(mode)).withColumn("_s", F.pmod(F.xxhash64("contract_symbol", "strike", "expiration"), F.lit(salts)))
    part = k.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_k"))).filter(F.col("_r") <= n)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_k"))).filter(F.col("rank") <= n).drop("_k", "_s", "_r")


def selection_audit(rows: DataFrame, keys: list[str], target_abs_delta: float, tolerance: float = DELTA_TOLERANCE, preferred_dte: int = PREFERRED_DTE, n: int = 5, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """Per key and mode, the first ``n`` ranked contracts with identity and metrics.

    Each row also has the key's number of eligible contracts, whether some are not
    shown, the first contract under either mode, and the policy. ``rows`` are
    eligible contracts, stored before, since their numbers are counted first: one
    shuffle by key serves both rankings, and only if a key has more than
    ``busy_rows`` contracts are keys cut down in hashed slices before.
    """
    metrics = selection_metrics(target_abs_delta, tolerance, preferred_dte)
    places = {mode: f"_{mode}" for mode in MODES}

    def placed(df: DataFrame, *by: str) -> DataFrame:
        # Dealt as they are; metrics and keys are made where they are used.
        df = df.repartition(*by).withColumns(metrics)
        for mode, place in places.items():
            df = df.withColumn("_key", packed_key(mode)).withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy("_key"))).drop("_key")
        return df

    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    shown = reduce(or_, [F.col(place) <= n for place in places.values()])
    df = rows.withColumn("_n", F.lit(1).cast("long"))
    if most > busy_rows:
        df = df.withColumn("_slice", F.pmod(F.xxhash64("contract_symbol", "strike", "expiration"), F.lit(-(-most // busy_rows))))
        df = placed(df, *keys, "_slice").withColumn("_n", F.sum("_n").over(Window.partitionBy(*keys, "_slice")))
        df = df.filter(shown).withColumn("_n", F.when(F.col(places["delta"]) == 1, F.col("_n"))).select(*rows.columns, "_n")
    w = Window.partitionBy(*keys)
    df = placed(df, *keys)
    first = {name: F.max(F.when(F.col(places[mode]) == 1, F.struct("contract_symbol", "expiration", "strike"))).over(w) for name, mode in (("_base", "delta"), ("_cost", "cost_aware"))}
    df = df.withColumns({"eligible_count": F.sum("_n").over(w), **first}).filter(shown)
    df = df.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(mode).alias("mode"), F.col(place).alias("rank")) for mode, place in places.items()]))).filter(F.col("_at.rank") <= n)
    named = [F.col(f"{at}.{c}").alias(f"{name}_{c.removesuffix('_symbol')}") for at, name in (("_base", "baseline"), ("_cost", "cost_aware")) for c in ("contract_symbol", "expiration", "strike")]
    policy = {
        "target_abs_delta": F.lit(float(target_abs_delta)), "delta_tolerance": F.lit(float(tolerance)), "preferred_dte": F.lit(preferred_dte).cast("long"), "contract_multiplier_assumption": F.lit(100).cast("long"),
        "quote_age_status": F.lit(QUOTE_AGE_STATUS), "selection_version": F.lit(SELECTION_VERSION), "validation_status": F.lit(VALIDATION_STATUS), "note": F.lit(AUDIT_NOTE),
    }
    return df.select(*rows.columns, *metrics, "_at.mode", "_at.rank", "eligible_count", (F.col("eligible_count") > n).alias("alternatives_truncated"), *named, *[c.alias(name) for name, c in policy.items()])


def rejection_tally(rows: DataFrame, keys: list[str], limits: Limits = Limits()) -> DataFrame:
    """Per key: how many contracts fail each screen; failures overlap."""
    ok_flags = (F.col("model_status") == "OK") & (F.col("liquidity_screen") == "PASS")
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col("screen_dte")).alias("f_dte"), F.count_if(~F.col("screen_spread")).alias("f_spread"),
        F.count_if(~F.col("screen_open_interest")).alias("f_oi"), F.count_if(~F.col("screen_volume")).alias("f_volume"),
        F.count_if(F.col("model_status") != "OK").alias("f_model"), F.count_if(ok_flags & ~eligible(limits)).alias("f_fields"),
        F.count_if(eligible(limits)).alias("n_eligible"),
    )
    names = {"f_dte": "DTE outside entry band", "f_spread": "spread", "f_oi": "open interest", "f_volume": "volume", "f_model": "unmodellable Greeks", "f_fields": "invalid contract fields"}
    parts = [F.when(F.col(c) > 0, F.concat(F.lit(f"{label}: "), F.col(c), F.lit("/"), F.col("n"))) for c, label in names.items()]
    return agg.withColumn("detail", F.concat_ws("; ", *parts))


def breakeven_move_pct() -> Column:
    """Underlying move that pays the round-trip cost, to first order."""
    d, c, s = F.col("delta"), F.col("round_trip_cost_1x"), F.col("underlying_close")
    ok = is_finite("delta") & is_finite("round_trip_cost_1x") & is_finite("underlying_close") & (d != 0) & (s > 0) & (c >= 0)
    return F.when(ok, F.abs(c / (F.abs(d) * 100.0) / s))


def option_summary(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("ticker").agg(
        F.count("*").alias("contracts"), F.count_if(F.col("model_status") != "NO_TWO_SIDED_QUOTE").alias("two_sided_quotes"),
        F.count_if(F.col("model_status") == "OK").alias("greeks_modelled"), F.count_if(F.col("liquidity_screen") == "PASS").alias("passed_liquidity_screen"),
        F.count_if(F.col("gate") == "PAPER_TRADE_CANDIDATE").alias("candidates"),
    )
