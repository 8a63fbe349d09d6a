"""Proposals and recorded abstentions, their integrity, and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.canonical import digest
from ..functions.guards import rounded
from ..functions.pricing import with_option_model, years_to_expiry
from ..session import materialize
from .features import CONVICTION_FLOOR
from .options import breakeven_move_pct, usable_quote

PICK_VERSION = "0.5.0"
HORIZON, PROFIT_TARGET, STOP_LOSS, DTE_FLOOR = 5, 0.50, -0.50, 21
MARK_RATE, ROUND_TRIP_FEES = 0.04, 1.6
CONTRACT = ("contract_symbol", "expiration", "strike", "dte", "bid", "ask", "mid", "delta", "iv_solved", "round_trip_cost_1x", "underlying_close")


def generate_picks(scores: DataFrame, best: DataFrame, tally: DataFrame, floor: float = CONVICTION_FLOOR) -> DataFrame:
    """One row per (variant, ticker, decision): a proposal or why there is none.

    ``scores``: ticker, decision_date, variant, score, missing, precondition.
    ``best``/``tally``: per (ticker, decision_date, kind), the top eligible
    contract and the failed-screen counts; variants share one delta target, so
    contracts are ranked once per name, day and side.
    """
    kind = F.when(F.col("score") > 0, "CALL").otherwise("PUT")
    keys = ["ticker", "decision_date", "kind"]
    df = scores.withColumn("kind", kind).join(best, keys, "left").join(tally.select(*keys, F.col("n").alias("n_kind"), "detail"), keys, "left")
    weak = F.abs("score") < floor
    none = F.concat(
        F.lit("no "), F.col("kind"), F.lit(" passed the liquidity screen with modellable Greeks ("), F.coalesce("n_kind", F.lit(0)).cast("string"), F.lit(" "), F.col("kind"), F.lit("s in the snapshot)"),
        F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(". Failed checks (can overlap): "), F.col("detail"))).otherwise(""),
    )
    reason = (
        F.when(F.col("precondition").isNotNull(), F.col("precondition"))
        .when(F.col("score").isNull(), F.concat(F.lit("insufficient history for: "), F.col("missing")))
        .when(weak, F.format_string(f"conviction %.2f below the variant's {floor:.2f} floor", rounded(F.abs("score"), 2)))
        .when(F.col("contract_symbol").isNull(), none)
    )
    go = reason.isNull()
    df = df.withColumn("reason", reason)
    go = F.col("reason").isNull()
    scored = F.col("precondition").isNull() & F.col("score").isNotNull()
    return df.select(
        "decision_date", "variant", "ticker", F.when(go, F.concat(F.lit("PAPER_LONG_"), F.col("kind"))).otherwise("ABSTAIN").alias("action"),
        F.when(scored, rounded("score", 4)).alias("composite_score"), "reason", F.when(go, F.when(F.col("kind") == "CALL", "BULLISH").otherwise("BEARISH")).alias("direction"),
        F.when(go, F.col("kind")).alias("kind"), *[F.when(go, F.col(c)).alias(c) for c in CONTRACT],
        F.when(go, F.col("ask")).alias("entry_fill"), F.when(go, rounded(breakeven_move_pct(), 6)).alias("breakeven_move_pct"),
        F.lit("delta").alias("selection_policy"), F.lit(PICK_VERSION).alias("contract_version"),
    )


def explain(picks: DataFrame) -> DataFrame:
    """Short justification text and a fingerprint of the facts behind it."""
    short = F.when(
        F.col("action") == "ABSTAIN", F.concat(F.col("ticker"), F.lit(": ABSTAIN. "), F.col("reason"))
    ).otherwise(
        F.concat(
            F.col("ticker"), F.lit(" scored "), F.format_string("%+.4f", "composite_score"), F.lit(" ("), F.lower("direction"), F.lit("). "), F.col("expiration").cast("string"), F.lit(" "),
            F.format_string("%.0f", "strike"), F.lit(" "), F.lower("kind"), F.lit(", "), F.col("dte").cast("string"), F.lit(" DTE, selected by "), F.col("selection_policy"),
            F.lit(". Paper hypothesis; not a profit guarantee."),
        )
    )
    facts = {c: F.col(c).cast("string") for c in ("decision_date", "variant", "ticker", "action", "direction", "contract_symbol")}
    return picks.withColumn("short_justification", short).withColumn("fingerprint", digest(**facts))


def pick_hash() -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("decision_date", "variant", "ticker", "action", "direction", "contract_symbol")]), 256)


def freeze(picks: DataFrame) -> DataFrame:
    """One envelope per decision date: counts and a digest of its picks.

    Pick hashes are combined word by word with exclusive-or, which needs no
    order and no gathering, then sealed into one record hash.
    """
    h = picks.withColumn("_h", pick_hash())
    words = [F.bit_xor(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"w{i}") for i in range(4)]
    env = h.groupBy("decision_date").agg(F.count_if(F.col("action") != "ABSTAIN").alias("n_picks"), F.count_if(F.col("action") == "ABSTAIN").alias("n_abstentions"), *words)
    body = F.concat_ws("-", *[F.col(f"w{i}").cast("string") for i in range(4)])
    env = env.select("decision_date", "n_picks", "n_abstentions", F.sha2(body, 256).alias("picks_sha256"))
    seal = F.concat_ws("|", F.col("decision_date").cast("string"), F.col("n_picks").cast("string"), F.col("n_abstentions").cast("string"), "picks_sha256")
    return env.withColumn("record_sha256", F.sha2(seal, 256))


def verify(picks: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Integrity per decision date: OK, or VOID when contents no longer match."""
    now = freeze(picks).select("decision_date", F.col("picks_sha256").alias("_p"), F.col("record_sha256").alias("_r"))
    j = envelopes.join(now, "decision_date", "left")
    ok = F.coalesce((F.col("picks_sha256") == F.col("_p")) & (F.col("record_sha256") == F.col("_r")), F.lit(False))
    return j.select(*envelopes.columns, F.when(ok, "OK").otherwise("VOID").alias("integrity"))


def pick_history(picks: DataFrame, envelopes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every pick and abstention with its run's integrity and, where it was a position, its outcome.

    A run whose contents no longer match its envelope, or that has none, is VOID
    on every row; it stays visible. ``trusted`` keeps it out of summaries.
    """
    keys = ["decision_date", "variant", "ticker"]
    checked = verify(picks, envelopes).select("decision_date", "integrity")
    results = outcomes.select(*keys, *[c for c in outcomes.columns if c not in picks.columns])
    rows = picks.join(checked, "decision_date", "left").join(results, keys, "left")
    return rows.withColumn("integrity", F.coalesce("integrity", F.lit("VOID")))


def trusted(history: DataFrame) -> DataFrame:
    return history.filter(F.col("integrity") == "OK")


def numbered_bars(bars: DataFrame) -> DataFrame:
    """Add ``known_upto``: bars with a close up to and including each row."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("known_upto", F.count("close").over(w))


def mark_path(picks: DataFrame, bars: DataFrame, chain: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Each proposal's first ``horizon`` sessions with a mark and its method.

    Sessions are matched by their running number, chain quotes by exact
    contract; the model price uses the entry volatility. The path, at most
    ``horizon`` rows a proposal, is stored, so that only quotes of its contracts
    are ordered and shuffled.
    """
    numbered = numbered_bars(bars.select("ticker", "date", "close"))
    start = numbered.select("ticker", F.col("date").alias("decision_date"), "known_upto")
    p = picks.filter(F.col("action") != "ABSTAIN").join(start, ["ticker", "decision_date"], "left")
    p = p.withColumn("day_no", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("bar_no", F.col("known_upto") + F.col("day_no"))
    fwd = numbered.filter(F.col("close").isNotNull()).select("ticker", F.col("known_upto").alias("bar_no"), F.col("date").alias("mark_date"), F.col("close").alias("spot"))
    p = p.join(fwd, ["ticker", "bar_no"], "left")
    contract = ["ticker", "mark_date", "kind", "expiration", "strike_key"]
    key = F.rint(F.col("strike") * 1e6).cast("long").alias("strike_key")
    p = materialize(p.select("*", key), "path")
    quotes = chain.filter((F.col("status") == "OK") & F.col("bid").isNotNull() & F.col("ask").isNotNull()).select(
        "ticker", F.col("snapshot_date").alias("mark_date"), "kind", "expiration", key, "line_no", "bid", "ask"
    ).join(p.select(*contract).distinct(), contract, "left_semi").groupBy(*contract).agg(F.min_by(F.struct("bid", "ask"), "line_no").alias("quote"))
    p = p.join(quotes, contract, "left")
    p = p.withColumn("t_left", years_to_expiry("mark_date", "expiration"))
    p = with_option_model(p, "spot", "strike", "t_left", F.lit(MARK_RATE), "iv_solved", F.lit(0.0), "kind", price="modelled")
    market = F.when((F.col("quote.bid") > 0) & (F.col("quote.ask") >= F.col("quote.bid")), F.col("quote.bid"))
    price = F.coalesce(market, F.col("modelled"))
    method = F.when(market.isNotNull(), "MARKET").when(F.col("t_left").isNull() | F.col("iv_solved").isNull(), "EXPIRED_OR_NO_ENTRY_IV").when(F.col("modelled").isNotNull(), "MODELLED").otherwise("REMARK_FAILED")
    marked = p.withColumn("mark", price).withColumn("method", method)
    rop = F.try_divide((F.col("mark") - F.col("entry_fill")) * 100.0 - ROUND_TRIP_FEES, F.col("entry_fill") * 100.0)
    left = F.datediff("expiration", "mark_date")
    trigger = (
        F.when(F.col("mark_date").isNull() | F.col("mark").isNull(), F.lit(None))
        .when((left > 0) & (left < DTE_FLOOR), "DTE_FLOOR").when(rop >= PROFIT_TARGET, "PROFIT_TARGET").when(rop <= STOP_LOSS, "STOP_LOSS").when(F.col("day_no") == horizon, "TIME_STOP")
    )
    return marked.withColumn("return_on_premium", rop).withColumn("trigger", trigger)


def resolve_picks(path: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """First exit rule that fires per proposal, and the horizon reading apart.

    At most ``horizon`` rows meet per pick, so folding them as one short array
    is bounded.
    """
    day = F.struct("day_no", "mark_date", "spot", "mark", "method", "return_on_premium", "trigger")
    keys = ["decision_date", "variant", "ticker"]
    carried = ["direction", "kind", "expiration", "strike", "entry_fill", "underlying_close", "selection_policy", "contract_version"]
    g = path.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried], F.array_sort(F.collect_list(F.when(F.col("mark_date").isNotNull(), day))).alias("days")
    )
    unmarked = F.element_at(F.filter("days", lambda d: d["mark"].isNull()), 1)
    fired = F.element_at(F.filter("days", lambda d: d["trigger"].isNotNull()), 1)
    g = g.withColumn("days", F.filter("days", lambda d: d.isNotNull())).select(
        "*", F.when(F.exists("days", lambda d: d["mark"].isNull()), unmarked).alias("_u"), F.when(F.exists("days", lambda d: d["trigger"].isNotNull()), fired).alias("_f")
    )
    blocked = F.col("_u").isNotNull() & (F.col("_f").isNull() | (F.col("_u.day_no") < F.col("_f.day_no")))
    status = F.when(F.size("days") == 0, "OPEN").when(F.col("entry_fill").isNull() | F.col("underlying_close").isNull() | blocked, "UNMARKABLE").when(F.col("_f").isNotNull(), "RESOLVED").otherwise("OPEN")
    g = g.withColumn("status", status)
    done = F.col("status") == "RESOLVED"
    methods = F.array_distinct(F.transform(F.filter("days", lambda d: d["day_no"] <= F.col("_f.day_no")), lambda d: d["method"]))
    last = F.when(F.size("days") >= horizon, F.element_at("days", -1))
    move = last["spot"] / F.col("underlying_close") - 1.0
    shown = lambda c: F.when(done, c)
    return g.select(
        *keys, *carried, "status", shown(F.col("_f.trigger")).alias("exit_trigger"), shown(F.col("_f.mark_date")).alias("exit_date"), shown(F.col("_f.day_no")).alias("days_held"),
        shown(rounded("_f.mark", 4)).alias("exit_price"), shown(F.col("_f.method")).alias("exit_mark_method"),
        shown(F.when(F.size(methods) > 1, "MIXED").when(methods[0] == "MARKET", "OBSERVED_ONLY").otherwise("MODELLED_ONLY")).alias("exit_path_provenance"),
        shown(rounded("_f.return_on_premium", 4)).alias("exit_return_on_premium"),
        shown(rounded((F.col("_f.mark") - F.col("entry_fill")) * 100.0 - ROUND_TRIP_FEES, 2)).alias("exit_pnl_per_contract"),
        shown(last["mark_date"]).alias("horizon_date"), shown(move).alias("underlying_move_pct"), shown((move > 0) == (F.col("direction") == "BULLISH")).alias("absolute_direction_correct"),
        shown(rounded(last["return_on_premium"], 4)).alias("horizon_return_on_premium"),
    )


def direction_labels(bars: DataFrame, benchmark: str, horizon: int = HORIZON) -> DataFrame:
    """Per (ticker, decision_date): excess log return over identical session windows.

    Null when the name and the benchmark do not share the same forward dates.
    """
    from .labels import forward_returns

    r = forward_returns(bars, horizon)
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1, horizon)
    seq = r.select(
        "ticker", F.col("date").alias("decision_date"), F.collect_list("date").over(w).alias("dates"), F.sum(F.log1p("forward_return")).over(w).alias("lr"), F.min("forward_return").over(w).alias("worst"),
    )
    bench = seq.filter(F.col("ticker") == benchmark).select("decision_date", F.col("dates").alias("b_dates"), F.col("lr").alias("b_lr"))
    same = (F.col("dates") == F.col("b_dates")) & (F.size("dates") == horizon) & (F.col("worst") > -1.0)
    j = seq.filter(F.col("ticker") != benchmark).join(F.broadcast(bench), "decision_date", "left")
    return j.select("ticker", "decision_date", F.when(same, F.col("lr") - F.col("b_lr")).alias("excess_log_return"))


def with_direction(outcomes: DataFrame, labels: DataFrame) -> DataFrame:
    j = outcomes.join(labels, ["ticker", "decision_date"], "left")
    up = F.col("excess_log_return") > 0
    ok = F.col("status") == "RESOLVED"
    return j.withColumn("direction_correct", F.when(ok & F.col("horizon_date").isNotNull(), up == (F.col("direction") == "BULLISH")))


def summarise(outcomes: DataFrame) -> DataFrame:
    """Resolved outcomes per variant, policy, version and provenance; never blended."""
    keys = ["variant", "selection_policy", "contract_version", "exit_path_provenance"]
    done = outcomes.filter(F.col("status") == "RESOLVED")
    r = F.col("exit_return_on_premium")
    base = done.groupBy(*keys).agg(
        F.count("*").alias("resolved"), F.count("direction_correct").alias("direction_scored"), F.count_if("direction_correct").alias("direction_hits"),
        F.avg(r).alias("mean_return"), F.max(r).alias("best_return"), F.min(r).alias("worst_return"), F.count_if(r > 0).alias("wins"), F.count_if(r <= 0).alias("losses"),
        F.count_if(F.col("exit_mark_method") == "MODELLED").alias("modelled_marks"),
    )
    # Four trigger names at most, so the histogram array is bounded.
    hist = done.groupBy(*keys, "exit_trigger").agg(F.count("*").alias("n")).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("exit_trigger", "n"))), lambda t: F.concat(t["exit_trigger"], F.lit(":"), t["n"].cast("string"))), ", ").alias("exit_triggers")
    )
    return base.join(hist, keys).withColumn("direction_hit_rate", F.try_divide(F.col("direction_hits"), F.col("direction_scored")))
