import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import pricing as PR
from tidemark.operators import gate as G
from tidemark.operators import options as O
from tidemark.operators import picks as PK

IN = "s double, k double, t double, r double, v double, q double, kind string"


def model(spark, rows):
    return PR.with_option_model(spark.createDataFrame(rows, IN), "s", "k", "t", "r", "v", "q", "kind", price="price", greeks=True)


def test_reference_prices_and_parity(spark):
    c, p = model(spark, [(100.0, 100.0, 1.0, 0.05, 0.2, 0.0, "CALL"), (100.0, 100.0, 1.0, 0.05, 0.2, 0.0, "PUT")]).orderBy("kind").collect()
    assert c.price == pytest.approx(10.450583572185565) and c.delta == pytest.approx(0.6368306511756191)
    assert p.price == pytest.approx(5.573526022256971) and p.delta == pytest.approx(c.delta - 1)
    assert c.gamma == pytest.approx(0.018762017345846895) and c.vega == pytest.approx(0.3752403469169379)


def test_generated_methods_stay_short_enough_to_be_compiled(spark, capsys):
    """The JVM interprets methods beyond 8,000 bytes."""
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(10).select(*[(F.col("id") + F.rand(i)).alias(c) for i, c in enumerate("sktrvq")], F.lit("CALL").alias("kind"), *[F.rand(90 + i).alias(f"x{i}") for i in range(14)])
        PR.with_option_model(rows, "s", "k", "t", "r", "v", "q", "kind", price="price", greeks=True).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


CHAIN = "ticker string, snapshot_date date, contract_symbol string, kind string, expiration date, strike double, bid double, ask double, mid double, volume long, open_interest long, status string"


def chain_rows(frame):
    rows = [("A", "2024-01-02", f"c{i}", "CALL" if i % 3 else "PUT", f"2024-02-{1 + i % 28:02d}", 90.0 + i % 20, 4.0, 4.1 + i % 7 / 10, 4.05 + i % 7 / 20, 40 + i % 30, 400 + 20 * i, "OK" if i % 9 else "UNKNOWN") for i in range(60)]
    return frame(rows, CHAIN), frame([("A", "2024-01-02", 100.0, 0.01)], "ticker string, snapshot_date date, underlying_close double, dividend_yield double")


def test_a_filter_on_the_model_compiles_to_short_methods(spark, frame, capsys):
    """The filter was carried down as copies of the columns' formulas: too long to compile, and then interpreted row by row."""
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        O.enrich_chain(*chain_rows(frame), liquid_only=True).filter(O.eligible()).select("contract_symbol", "delta", "round_trip_cost_1x").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_screening_before_the_solver_loses_no_eligible_contract(frame):
    chain, context = chain_rows(frame)
    plain, early = (O.enrich_chain(chain, context, liquid_only=x) for x in (False, True))
    assert 0 < early.count() < plain.count() == 60
    want = plain.filter(O.eligible()).orderBy("contract_symbol").collect()
    assert want and want == early.filter(O.eligible()).orderBy("contract_symbol").collect()


def test_status_of_all_contracts_needs_the_search_only_for_liquid_ones(frame):
    chain, context = chain_rows(frame)
    dear = chain.limit(1).withColumns({"contract_symbol": F.lit("dear"), "bid": F.lit(120.0), "ask": F.lit(121.0), "mid": F.lit(120.5), "status": F.lit("OK")})
    chain = chain.unionByName(dear)
    whole, part = ({r.contract_symbol: r for r in O.enrich_chain(chain, context, liquid_model=x).collect()} for x in (False, True))
    assert len(part) == 61 and {r.model_status for r in part.values()} == {"OK", "NO_TWO_SIDED_QUOTE", "IV_UNSOLVABLE_FROM_MID"}
    for name, r in part.items():
        if r.liquidity_screen == "PASS":
            assert r == whole[name]
        else:
            assert r.iv_solved is None and r.delta is None and (r.model_status, r.gate) == (whole[name].model_status, whole[name].gate)
    assert 0 < sum(r.iv_solved is not None for r in part.values()) < sum(r.iv_solved is not None for r in whole.values())


def test_contracts_are_screened_before_they_are_quoted(spark):
    from tidemark.sources import views as V

    sf, old = "/root/testdata/sf0.001", spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = V.chain(spark, sf, liquid_only=True)._jdf.queryExecution().executedPlan().toString()
        bars = V.raw_bars(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    steps = re.findall(r"ArrowEvalPython|\w*HashJoin|Filter [^\n]*l_quantity", plan)
    assert steps.index("ArrowEvalPython") < min(i for i, x in enumerate(steps) if "HashJoin" in x) < min(i for i, x in enumerate(steps) if x.startswith("Filter"))
    assert bars.count("l_shipdate#") and len(re.findall(r"FileScan parquet \[[^\]]*l_partkey", bars)) == 1
    key = ["contract_symbol", "snapshot_date", "bid", "ask"]
    few, all_ = V.chain(spark, sf, liquid_only=True), V.chain(spark, sf)
    assert few.count() < all_.count() and few.select(key).exceptAll(O.passes_unquoted(all_).select(key)).count() == 0 == O.passes_unquoted(all_).select(key).exceptAll(few.select(key)).count()


def test_solved_greeks_equal_the_model_at_the_solved_volatility(frame):
    chain, context = chain_rows(frame)
    e = O.enrich_chain(chain, context).filter("iv_solved is not null").drop("delta", "gamma", "theta_per_day", "vega", "rho", "price")
    got = O.enrich_chain(chain, context).select("contract_symbol", *PR.GREEKS)
    want = PR.with_option_model(e, "underlying_close", "strike", "t_years", F.lit(O.RISK_FREE), "iv_solved", "dividend_yield", "kind", greeks=True).select("contract_symbol", *[F.col(g).alias(f"w_{g}") for g in PR.GREEKS])
    rows = got.join(want, "contract_symbol", "left").collect()
    assert {r.delta is None for r in rows} == {True, False}
    assert all(r[g] == pytest.approx(r[f"w_{g}"], rel=1e-12) if r[f"w_{g}"] is not None else r[g] is None for r in rows for g in PR.GREEKS)


def test_solver_gives_the_midpoint_that_plain_bisection_ends_on():
    rng = np.random.default_rng(2)
    n = 400
    k, t, q, v = rng.uniform(60, 150, n), rng.integers(1, 400, n) / 365, rng.choice([0.0, 0.03], n), np.exp(rng.uniform(-4, 1.5, n))
    kind = pd.Series(rng.choice(["CALL", "PUT"], n))
    s, r, sign = np.full(n, 100.0), np.full(n, 0.04), np.where(kind == "CALL", 1.0, -1.0)
    o = PR._Options(s, k, t, r, q, sign)
    p = np.round(o.price(v), 4)
    got = PR.implied_volatility.func(*[pd.Series(a) for a in (p, s, k, t, r, q)], kind).to_numpy(dtype=float)
    solved = np.flatnonzero(np.isfinite(got))
    assert len(solved) > n / 2
    for i in solved:
        lo, hi, one = PR.MIN_VOL, PR.MAX_VOL, o.take([i])
        while True:
            mid = 0.5 * (lo + hi)
            at = one.price(np.array([mid]))[0]
            if abs(at - p[i]) < PR.TOLERANCE or hi - lo < PR.TOLERANCE:
                break
            lo, hi = (mid, hi) if at < p[i] else (lo, mid)
        assert got[i] == mid


def test_bad_inputs_price_to_null(spark):
    rows = [(float("nan"), 100.0, 1.0, 0.05, 0.2, 0.0, "CALL"), (100.0, 0.0, 1.0, 0.05, 0.2, 0.0, "CALL"), (100.0, 100.0, 1.0, 0.05, 0.2, 0.0, "STRADDLE"), (100.0, 100.0, None, 0.05, 0.2, 0.0, "PUT")]
    assert all(r.price is None and r.delta is None for r in model(spark, rows).collect())


def test_volatility_round_trip_and_arbitrage_bounds(spark):
    rows = [(100.0, float(k), t, 0.04, v, 0.01, kind) for k in (80, 100, 125) for t in (0.1, 0.5) for v in (0.15, 0.6) for kind in ("CALL", "PUT")]
    m = model(spark, rows).filter("price > 0.01")
    back = m.withColumn("iv", PR.implied_volatility("price", "s", "k", "t", "r", "q", "kind"))
    again = PR.with_option_model(back.drop("price", "delta", "gamma", "theta_per_day", "vega", "rho"), "s", "k", "t", "r", "iv", "q", "kind", price="p2").join(m, ["s", "k", "t", "r", "v", "q", "kind"])
    assert all(abs(r.p2 - r.price) < 5e-6 for r in again.collect())
    bad = spark.createDataFrame([(150.0, 100.0, 100.0, 0.5, 0.04, 0.0, "CALL"), (-1.0, 100.0, 100.0, 0.5, 0.04, 0.0, "CALL")], "p double, s double, k double, t double, r double, q double, kind string")
    assert [r[0] for r in bad.select(PR.implied_volatility("p", "s", "k", "t", "r", "q", "kind")).collect()] == [None, None]


PASSING = {"independent_events": 3.0, "evidence_confidence": 0.8, "dte": 30.0, "relative_spread": 0.05, "open_interest": 900.0, "daily_volume": 80.0, "expected_edge_after_costs": 0.1, "position_pct": 0.01, "portfolio_heat_pct": 0.03, "open_positions": 1.0}


@pytest.mark.parametrize(
    "change,failed,decision",
    [
        ({}, [], "PAPER_TRADE_CANDIDATE"), ({"dte": 10.0}, ["dte_out_of_band"], "WATCH"), ({"dte": None}, ["missing:dte"], "PASS"), ({"position_pct": float("nan")}, ["invalid_numeric:position_pct"], "PASS"),
        ({"expected_edge_after_costs": 0.0}, ["no_edge_after_costs"], "PASS"), ({"open_interest": 900.5}, ["invalid_numeric:open_interest"], "PASS"), ({"position_pct": 0.0}, ["invalid_numeric:position_pct"], "PASS"),
        ({"portfolio_heat_pct": 0.005}, ["invalid_numeric:portfolio_heat_pct"], "PASS"), ({"relative_spread": 0.2, "daily_volume": 1.0}, ["spread_too_wide", "insufficient_volume"], "WATCH"),
    ],
)
def test_gate(spark, change, failed, decision):
    v = {**PASSING, **change}
    row = G.with_gate(spark.range(1), {**{k: F.lit(x).cast("double") for k, x in v.items()}, "defined_risk": F.lit(True)}).first()
    assert (row.gate_failed, row.gate) == (",".join(failed), decision)


def test_undefined_risk_is_hard(spark):
    assert G.with_gate(spark.range(1), {k: F.lit(x) for k, x in PASSING.items()}).first().gate == "PASS"


def test_a_number_nobody_has_settles_the_decision(spark):
    row = G.with_gate(spark.range(1), {"dte": F.lit(5.0), "defined_risk": F.lit(True)}).first()
    assert row.gate == "PASS" and row.gate_failed.startswith("missing:independent_events,missing:evidence_confidence,dte_out_of_band,missing:relative_spread")


def test_limits_of_a_small_account(spark):
    v = {k: F.lit(x) for k, x in {**PASSING, "position_pct": 0.08, "portfolio_heat_pct": 0.1}.items()}
    assert G.with_gate(spark.range(1), {**v, "defined_risk": F.lit(True)}).first().gate == "PASS"
    assert G.with_gate(spark.range(1), {**v, "defined_risk": F.lit(True)}, G.SMALL_ACCOUNT).first().gate == "PAPER_TRADE_CANDIDATE"
    with pytest.raises(TypeError):
        G.Limits(max_everything=1)


ROW = dict(contract_symbol="a", kind="CALL", expiration="2024-03-15", dte=40, strike=100.0, bid=2.0, ask=2.1, mid=2.05, delta=0.35, gamma=0.02, theta_per_day=-0.02, vega=0.1, iv_solved=0.3, relative_spread=0.0488, open_interest=900, volume=100, model_status="OK", liquidity_screen="PASS", round_trip_cost_1x=11.6, underlying_close=98.0)
DDL = "contract_symbol string, kind string, expiration date, dte int, strike double, bid double, ask double, mid double, delta double, gamma double, theta_per_day double, vega double, iv_solved double, relative_spread double, open_interest long, volume long, model_status string, liquidity_screen string, round_trip_cost_1x double, underlying_close double"


@pytest.mark.parametrize("change", [{"delta": float("nan")}, {"ask": float("inf")}, {"volume": -1}, {"dte": 1}, {"expiration": None}, {"delta": -0.3}, {"ask": 1.0}, {"iv_solved": None}, {"gamma": float("inf")}, {"liquidity_screen": "FAIL"}])
def test_corrupt_rows_are_not_eligible(frame, change):
    assert frame([tuple(ROW.values())], DDL).filter(O.eligible()).count() == 1
    assert frame([tuple({**ROW, **change}.values())], DDL).filter(O.eligible()).count() == 0


def ranked(frame, rows, mode):
    df = frame([tuple({**ROW, **r}.values()) for r in rows], DDL)
    df = df.select("*", *[c.alias(n) for n, c in O.selection_metrics(0.35).items()])
    return [r.contract_symbol for r in O.top_contracts(df, ["kind"], mode).orderBy("rank").collect()]


def test_ranking_modes(frame):
    rows = [dict(contract_symbol="exact", delta=0.35, round_trip_cost_1x=30.0), dict(contract_symbol="cheap", delta=0.40, round_trip_cost_1x=5.0), dict(contract_symbol="far", delta=0.60, round_trip_cost_1x=1.0)]
    assert ranked(frame, rows, "delta") == ["exact", "cheap", "far"]
    assert ranked(frame, rows, "cost_aware") == ["cheap", "exact", "far"]
    assert ranked(frame, rows[::-1], "delta") == ["exact", "cheap", "far"]


def test_audit_shows_the_first_five_of_both_modes(frame):
    rows = [dict(contract_symbol=f"c{i}", delta=0.35 + i / 100, round_trip_cost_1x=30.0 - i, strike=100.0 + i) for i in range(7)]
    rows.append(dict(contract_symbol="put", kind="PUT", delta=-0.4, open_interest=700))
    df = frame([tuple({**ROW, **r}.values()) for r in rows], DDL)
    a = O.selection_audit(df, ["kind"], 0.35).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, O.selection_audit(df, ["kind"], 0.35, busy_rows=2).collect()))
    listed = lambda kind, mode: [r.contract_symbol for r in sorted((r for r in a if (r.kind, r.mode) == (kind, mode)), key=lambda r: r.rank)]
    assert listed("CALL", "delta") == ["c0", "c1", "c2", "c3", "c4"] and listed("CALL", "cost_aware") == ["c6", "c5", "c4", "c3", "c2"]
    assert listed("PUT", "delta") == listed("PUT", "cost_aware") == ["put"] and len(a) == 12
    call = next(r for r in a if (r.kind, r.mode, r.rank) == ("CALL", "cost_aware", 2))
    assert (call.eligible_count, call.alternatives_truncated, call.baseline_contract, call.baseline_strike, call.cost_aware_contract, call.cost_aware_strike) == (7, True, "c0", 100.0, "c6", 106.0)
    assert call.cost_aware_expiration.isoformat() == "2024-03-15" and call.strike == 105.0 and call.inside_delta_tolerance and call.dte_distance == 0
    assert abs(call.delta_gap - 0.05) < 1e-12 and abs(call.round_trip_cost_pct_premium - 25 / 2.1 / 100) < 1e-12 and abs(call.signed_theta_pct_premium_per_day + 0.02 / 2.1) < 1e-12
    put = next(r for r in a if r.kind == "PUT")
    assert (put.eligible_count, put.alternatives_truncated, put.open_interest, put.gamma, put.vega, put.iv_solved) == (1, False, 700, 0.02, 0.1, 0.3)


def test_registered_audit_has_the_alternatives(spark):
    from __spark_entry__ import queries

    a = queries()["selection_audit"](spark, "/root/testdata/sf0.001")
    assert {"mode", "rank", "contract_symbol", "expiration", "strike", "delta_gap", "eligible_count", "baseline_contract", "cost_aware_contract"} <= set(a.columns)
    shown = a.groupBy("ticker", "snapshot_date", "kind", "mode").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.min("eligible_count").alias("all"))
    assert shown.filter("n != last OR n != least(all, 5)").isEmpty()


def pick(frame, **change):
    base = dict(decision_date="2024-01-02", variant="v", ticker="A", action="PAPER_LONG_CALL", direction="BULLISH", kind="CALL", expiration="2024-02-16", strike=100.0, iv_solved=0.3, entry_fill=4.0, underlying_close=100.0, selection_policy="delta", contract_version="0.5.0")
    return frame([tuple({**base, **change}.values())], "decision_date date, variant string, ticker string, action string, direction string, kind string, expiration date, strike double, iv_solved double, entry_fill double, underlying_close double, selection_policy string, contract_version string")


CH = "ticker string, snapshot_date date, line_no long, kind string, expiration date, strike double, bid double, ask double, status string"


def outcome(frame, closes, p=None, quotes=()):
    from tests.test_bars_labels import days

    d = days(len(closes) + 1, __import__("datetime").date(2024, 1, 2))
    bars = frame([("A", d[0], 100.0)] + [("A", x, c) for x, c in zip(d[1:], closes)], "ticker string, date date, close double")
    chain = frame([("A", d[i], i, "CALL", "2024-02-16", 100.0, b, b + 0.1, "OK") for i, b in quotes], CH)
    return PK.resolve_picks(PK.mark_path(p if p is not None else pick(frame), bars, chain)).first()


def test_exit_rules(frame):
    assert outcome(frame, [112.0] * 5).exit_trigger == "PROFIT_TARGET"
    assert outcome(frame, [85.0] * 5).exit_trigger == "STOP_LOSS"
    flat = outcome(frame, [100.0] * 5)
    assert (flat.exit_trigger, flat.days_held, flat.exit_path_provenance) == ("TIME_STOP", 5, "MODELLED_ONLY")
    assert outcome(frame, [100.0] * 5, pick(frame, expiration="2024-01-24")).exit_trigger == "DTE_FLOOR"
    assert outcome(frame, [100.0] * 3).status == "OPEN" and outcome(frame, []).status == "OPEN"
    assert outcome(frame, [100.0] * 5, pick(frame, iv_solved=None)).status == "UNMARKABLE"


def test_observed_quote_beats_the_model(frame):
    r = outcome(frame, [100.0] * 5, quotes=[(1, 9.0)])
    assert (r.exit_trigger, r.exit_mark_method, r.exit_price, r.exit_path_provenance) == ("PROFIT_TARGET", "MARKET", 9.0, "OBSERVED_ONLY")
    assert outcome(frame, [100.0] * 5, quotes=[(1, 4.0)]).exit_path_provenance == "MIXED"


def test_tampered_picks_are_void(frame):
    p = pick(frame).withColumn("contract_symbol", F.lit("x"))
    env = PK.freeze(p)
    assert PK.verify(p, env).first().integrity == "OK"
    assert PK.verify(p.withColumn("direction", F.lit("BEARISH")), env).first().integrity == "VOID"
