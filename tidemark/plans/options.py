"""Option chains over the sample tables: pricing, enrichment, gate, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing as PR
from ..functions.guards import settled
from ..operators import gate as G
from ..operators import options as O
from ..sources import views as V
from .registry import R, S, fragment, query


def horner(coefficients, x: str) -> str:
    acc = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        acc = f"({acc} * {x} + {c!r}::DOUBLE)"
    return acc


def PHI(x: str) -> str:
    """SQL text of the normal distribution at column ``x``."""
    a = f"abs({x})"
    tail = f"({a} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        tail = f"({a} + {k} / {tail})"
    e = f"exp(-0.5::DOUBLE * {x} * {x})"
    up = f"(CASE WHEN {a} > 37 THEN 0 WHEN {a} < {PR.HART_SPLIT!r}::DOUBLE THEN {e} * {horner(PR.HART_NUMERATOR, a)} / {horner(PR.HART_DENOMINATOR, a)} ELSE {e} / {tail} / {PR.ROOT_TWO_PI!r}::DOUBLE END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {up} ELSE {up} END)"


def D1(s, k, t, r, v, q):
    return f"((ln({s} / {k}) + ({r} - {q} + 0.5::DOUBLE * {v} * {v}) * {t}) / ({v} * sqrt({t})))"


def price_sql(s, k, t, r, q, kind, d1="d1", d2="d2"):
    return (
        f"(CASE WHEN {kind} = 'CALL' THEN {s} * exp(-{q} * {t}) * {PHI(d1)} - {k} * exp(-{r} * {t}) * {PHI(d2)} "
        f"WHEN {kind} = 'PUT' THEN {k} * exp(-{r} * {t}) * {PHI(f'(-{d2})')} - {s} * exp(-{q} * {t}) * {PHI(f'(-{d1})')} END)"
    )


RF = "0.04::DOUBLE"
fragment(
    "chain0",
    f"""SELECT *, {D1('100.0::DOUBLE', 'strike', 't', RF, 'sigma', '0')} AS d1, {D1('100.0::DOUBLE', 'strike', 't', RF, 'sigma', '0')} - sigma * sqrt(t) AS d2 FROM
  (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS snapshot_date, (l_orderkey * 8 + l_linenumber) * 4096 + l_suppkey % 1000 * 4 AS line_no,
   'K' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS contract_symbol,
   CASE WHEN l_orderkey % 101 = 0 THEN 'X' WHEN l_returnflag = 'R' THEN 'PUT' ELSE 'CALL' END AS kind, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 80 AS INTEGER) AS expiration,
   80.0::DOUBLE + l_partkey % 41 AS strike, 0.15::DOUBLE + (l_partkey % 40) / 100.0::DOUBLE AS sigma, l_discount,
   CASE WHEN l_orderkey % 47 <> 0 THEN l_partkey * 37 % 4000 END AS open_interest, CASE WHEN l_orderkey % 59 <> 0 THEN CAST(l_quantity AS BIGINT) * 5 END AS volume,
   CASE WHEN l_orderkey % 80 > 0 THEN (l_orderkey % 80) / 365.0::DOUBLE END AS t FROM lineitem JOIN part ON l_partkey = p_partkey)""",
)
fragment(
    "chain",
    f"""SELECT ticker, snapshot_date, line_no, contract_symbol, kind, expiration, strike, sigma, open_interest, volume, CASE WHEN good THEN bid END AS bid, CASE WHEN good THEN ask END AS ask,
  CASE WHEN good THEN {R('(bid + ask) / 2', 4)} END AS mid, CASE WHEN good THEN 'OK' ELSE 'UNKNOWN' END AS status FROM
  (SELECT *, coalesce(bid > 0 AND ask >= bid, FALSE) AS good FROM (SELECT *, {S('fair * (1 - l_discount / 2)', 2)} AS bid, {S('fair * (l_discount / 2 + 1) + 0.01::DOUBLE', 2)} AS ask FROM
   (SELECT *, {price_sql('100.0::DOUBLE', 'strike', 't', RF, '0', "(CASE WHEN kind = 'X' THEN 'CALL' ELSE kind END)")} AS fair FROM chain0)))""",
    "chain0",
)
fragment(
    "context",
    """SELECT s.*, CASE WHEN underlying_close > 0 AND paid > 0 THEN paid / underlying_close ELSE 0 END AS dividend_yield FROM
  (SELECT d.ticker, d.date AS snapshot_date, k.date AS underlying_close_date, k.close AS underlying_close,
   (SELECT coalesce(sum(dividend), 0) FROM bars x WHERE x.ticker = d.ticker AND x.date < d.date AND x.date >= d.date - INTERVAL 1 YEAR) AS paid
   FROM (SELECT * FROM bars WHERE ticker <> 'MKT') d ASOF LEFT JOIN (SELECT * FROM bars WHERE close IS NOT NULL) k ON d.ticker = k.ticker AND d.date > k.date) s""",
    "bars",
)
fragment(
    "ready",
    f"""SELECT *, CASE WHEN kind = 'CALL' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM
  (SELECT c.*, x.underlying_close_date, x.underlying_close AS s, coalesce(dividend_yield, 0) AS q, CASE WHEN expiration > snapshot_date THEN (expiration - snapshot_date) / 365.0::DOUBLE END AS t,
   CASE WHEN expiration > snapshot_date THEN expiration - snapshot_date END AS dte, (ask - bid) / mid AS relative_spread FROM chain c LEFT JOIN context x USING (ticker, snapshot_date))""",
    "chain context",
)


def _px(v: str) -> str:
    return price_sql("s", "strike", "t", RF, "q", "kind", D1("s", "strike", "t", RF, v, "q"), f"({D1('s', 'strike', 't', RF, v, 'q')} - {v} * sqrt(t))")


def _mid_price() -> str:
    return price_sql("s", "strike", "t", RF, "q", "kind")


fragment(
    "iv0",
    f"""SELECT line_no, contract_symbol, kind, s, strike, t, q, mid, 0 AS step, 1e-4 AS lo, 5.0::DOUBLE AS hi FROM
  (SELECT *, s * exp(-q * t) AS fs, strike * exp(-{RF} * t) AS fk FROM ready WHERE status = 'OK' AND s IS NOT NULL AND t IS NOT NULL AND kind IN ('CALL', 'PUT'))
  WHERE mid BETWEEN greatest(sg * (fs - fk), 0) - 1e-6 AND CASE WHEN kind = 'CALL' THEN fs ELSE fk END + 1e-6
   AND mid BETWEEN {_px('1e-4')} - 1e-6 AND {_px('5.0::DOUBLE')} + 1e-6""".replace("ready WHERE", "ready WHERE"),
    "ready",
)
fragment(
    "ivr",
    f"""SELECT *, FALSE AS done FROM iv0 UNION ALL
  SELECT line_no, contract_symbol, kind, s, strike, t, q, mid, step + 1, CASE WHEN fin THEN lo WHEN p < mid THEN v ELSE lo END, CASE WHEN fin THEN hi WHEN p < mid THEN hi ELSE v END, fin FROM
  (SELECT *, abs(p - mid) < 1e-6 OR hi - lo < 1e-6 AS fin FROM (SELECT *, {_mid_price()} AS p FROM
   (SELECT *, {D1('s', 'strike', 't', RF, 'v', 'q')} AS d1, {D1('s', 'strike', 't', RF, 'v', 'q')} - v * sqrt(t) AS d2 FROM
    (SELECT *, 0.5::DOUBLE * (lo + hi) AS v FROM ivr WHERE NOT done AND step < 60))))""",
    "iv0",
)
fragment("iv", "SELECT line_no, contract_symbol, 0.5::DOUBLE * (lo + hi) AS iv FROM ivr WHERE done", "ivr")
fragment(
    "enriched0",
    f"""SELECT r.*, iv, {D1('s', 'strike', 't', RF, 'iv', 'q')} AS d1, {D1('s', 'strike', 't', RF, 'iv', 'q')} - iv * sqrt(t) AS d2 FROM ready r LEFT JOIN iv USING (line_no, contract_symbol)""",
    "ready iv",
)
PDF = f"(exp(-0.5::DOUBLE * d1 * d1) / {PR.ROOT_TWO_PI!r}::DOUBLE)"
EQ, ER = "exp(-q * t)", f"exp(-{RF} * t)"
fragment(
    "enriched",
    f"""SELECT *, CASE WHEN scr_dte AND scr_spread AND scr_oi AND scr_vol THEN 'PASS' ELSE 'FAIL' END AS liquidity_screen FROM (SELECT ticker, snapshot_date, line_no, contract_symbol, kind, expiration, strike, bid, ask, mid, volume, open_interest, status, dte, relative_spread, s AS underlying_close, underlying_close_date, iv AS iv_solved, t AS t_years,
  CASE WHEN kind = 'CALL' THEN {EQ} * {PHI('d1')} ELSE -{EQ} * {PHI('(-d1)')} END AS delta, {EQ} * {PDF} / (s * iv * sqrt(t)) AS gamma, s * {EQ} * {PDF} * sqrt(t) / 100 AS vega,
  CASE WHEN kind = 'CALL' THEN -(s * {EQ} * {PDF} * iv) / (2 * sqrt(t)) - {RF} * strike * {ER} * {PHI('d2')} + q * s * {EQ} * {PHI('d1')}
       ELSE -(s * {EQ} * {PDF} * iv) / (2 * sqrt(t)) + {RF} * strike * {ER} * {PHI('(-d2)')} - q * s * {EQ} * {PHI('(-d1)')} END / 365 AS theta_per_day,
  CASE WHEN kind = 'CALL' THEN strike * t * {ER} * {PHI('d2')} ELSE -strike * t * {ER} * {PHI('(-d2)')} END / 100 AS rho,
  CASE WHEN status <> 'OK' OR mid IS NULL THEN 'NO_TWO_SIDED_QUOTE' WHEN s IS NULL THEN 'NO_AVAILABLE_UNDERLYING_BAR' WHEN t IS NULL THEN 'EXPIRED_OR_BAD_DATE'
   WHEN kind NOT IN ('CALL', 'PUT') THEN 'UNKNOWN_OPTION_TYPE' WHEN iv IS NULL THEN 'IV_UNSOLVABLE_FROM_MID' ELSE 'OK' END AS model_status,
  CASE WHEN bid > 0 AND ask >= bid THEN {R('(ask - bid) * 100 + 1.6::DOUBLE', 2)} END AS round_trip_cost_1x,
  coalesce(dte BETWEEN 21 AND 60, FALSE) AS scr_dte, coalesce(relative_spread <= 0.10::DOUBLE, FALSE) AS scr_spread, coalesce(open_interest >= 500, FALSE) AS scr_oi, coalesce(volume >= 50, FALSE) AS scr_vol FROM enriched0)""",
    "enriched0",
)
fragment(
    "eligible",
    f"""SELECT *, {R('abs(abs(delta) - 0.35::DOUBLE)', 9)} AS gap, abs(abs(delta) - 0.35::DOUBLE) <= 0.080000000001::DOUBLE AS inside, {R('round_trip_cost_1x / ask / 100', 9)} AS cost_pct,
  {R('greatest(-theta_per_day, 0) / ask', 9)} AS theta_pct, {R('relative_spread', 9)} AS rs, abs(dte - 40)::DOUBLE AS dd FROM enriched
  WHERE model_status = 'OK' AND liquidity_screen = 'PASS' AND iv_solved > 0 AND strike > 0 AND underlying_close > 0 AND bid > 0 AND bid <= mid AND mid <= ask AND round_trip_cost_1x >= 0
  AND CASE WHEN kind = 'CALL' THEN delta > 0 AND delta <= 1 ELSE delta >= -1 AND delta < 0 END AND (ask - bid) / ((ask + bid) / 2) <= 0.10::DOUBLE""",
    "enriched",
)
ORDER = {
    "delta": "gap, rs, CAST(expiration AS VARCHAR), strike, kind, contract_symbol",
    "cost_aware": "CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN 0 ELSE gap END, cost_pct, gap, theta_pct, dd, rs, -open_interest, -volume, CAST(expiration AS VARCHAR), strike, kind, contract_symbol",
}


@query(
    "option_price",
    f"SELECT contract_symbol, {S('fair', 6)} AS fair FROM (SELECT *, {price_sql('100.0::DOUBLE', 'strike', 't', RF, '0', 'kind')} AS fair FROM chain0)",
    "chain0",
)
def option_price(spark, sf):
    c = V.chain(spark, sf).withColumn("s", F.lit(100.0)).withColumn("t", PR.years_to_expiry("snapshot_date", "expiration"))
    c = PR.with_option_model(c, "s", "strike", "t", F.lit(0.04), "sigma", F.lit(0.0), "kind", price="fair")
    return c.select("contract_symbol", settled("fair", 6).alias("fair"))


@query(
    "option_greeks",
    f"""SELECT contract_symbol, {S('delta', 6)} AS delta, {S('gamma', 6)} AS gamma, {S('vega', 6)} AS vega, {S('theta', 6)} AS theta_per_day, {S('rho', 6)} AS rho FROM
    (SELECT contract_symbol, CASE kind WHEN 'CALL' THEN {PHI('d1')} WHEN 'PUT' THEN -{PHI('(-d1)')} END AS delta,
      CASE WHEN kind IN ('CALL', 'PUT') THEN {PDF} / (100 * sigma * sqrt(t)) END AS gamma, CASE WHEN kind IN ('CALL', 'PUT') THEN {PDF} * sqrt(t) END AS vega,
      CASE kind WHEN 'CALL' THEN -(100 * {PDF} * sigma) / (2 * sqrt(t)) - {RF} * strike * {ER} * {PHI('d2')} WHEN 'PUT' THEN -(100 * {PDF} * sigma) / (2 * sqrt(t)) + {RF} * strike * {ER} * {PHI('(-d2)')} END / 365 AS theta,
      CASE kind WHEN 'CALL' THEN strike * t * {ER} * {PHI('d2')} WHEN 'PUT' THEN -strike * t * {ER} * {PHI('(-d2)')} END / 100 AS rho FROM chain0)""",
    "chain0",
)
def option_greeks(spark, sf):
    c = V.chain(spark, sf).withColumn("s", F.lit(100.0)).withColumn("t", PR.years_to_expiry("snapshot_date", "expiration"))
    c = PR.with_option_model(c, "s", "strike", "t", F.lit(0.04), "sigma", F.lit(0.0), "kind", greeks=True)
    return c.select("contract_symbol", *[settled(n, 6).alias(n) for n in ("delta", "gamma", "theta_per_day", "vega", "rho")])


@query(
    "implied_volatility",
    f"SELECT contract_symbol, kind, {S('iv_solved', 4)} AS iv_solved FROM enriched WHERE status = 'OK'",
    "enriched",
)
def implied_volatility(spark, sf):
    return V.enriched_chain(spark, sf).filter(F.col("status") == "OK").select("contract_symbol", "kind", settled("iv_solved", 4).alias("iv_solved"))


@query(
    "dividend_yield",
    f"SELECT ticker, snapshot_date, underlying_close_date, underlying_close, {S('dividend_yield', 8)} AS dividend_yield FROM context",
    "context",
)
def dividend_yield(spark, sf):
    b = V.bars_table(spark, sf)
    days = b.filter(F.col("ticker") != V.BENCHMARK).select("ticker", F.col("date").alias("snapshot_date"))
    return O.underlying_context(days, b).withColumn("dividend_yield", settled("dividend_yield", 8))


@query(
    "enrich_chain",
    f"""SELECT ticker, contract_symbol, CAST(dte AS BIGINT) AS dte, underlying_close, {S('relative_spread', 6)} AS relative_spread, {S('delta', 4)} AS delta, {S('gamma', 4)} AS gamma, {S('vega', 4)} AS vega,
    {S('theta_per_day', 4)} AS theta_per_day, {S('rho', 4)} AS rho, model_status, round_trip_cost_1x, scr_dte AS screen_dte, scr_spread AS screen_spread, scr_oi AS screen_open_interest, scr_vol AS screen_volume, liquidity_screen,
    'PASS' AS gate FROM enriched""",
    "enriched",
)
def enrich_chain(spark, sf):
    e = V.enriched_chain(spark, sf)
    greeks = ["delta", "gamma", "vega", "theta_per_day", "rho"]
    return e.select(
        "ticker", "contract_symbol", F.col("dte").cast("long").alias("dte"), "underlying_close", settled("relative_spread", 6).alias("relative_spread"), *[settled(c, 4).alias(c) for c in greeks],
        "model_status", "round_trip_cost_1x", "screen_dte", "screen_spread", "screen_open_interest", "screen_volume", "liquidity_screen", "gate",
    )


@query(
    "option_summary",
    """SELECT ticker, count(*) AS contracts, count(*) FILTER (WHERE model_status <> 'NO_TWO_SIDED_QUOTE') AS two_sided_quotes, count(*) FILTER (WHERE model_status = 'OK') AS greeks_modelled,
    count(*) FILTER (WHERE liquidity_screen = 'PASS') AS passed_liquidity_screen, 0::BIGINT AS candidates FROM enriched GROUP BY 1""",
    "enriched",
)
def option_summary(spark, sf):
    return O.option_summary(V.enriched_chain(spark, sf, liquid_model=True))


@query(
    "execution_costs",
    f"""SELECT contract_symbol, CASE WHEN bid > 0 AND ask >= bid THEN {R('(ask - bid) * 100 * 3 + 4.8::DOUBLE', 2)} END AS cost_3x,
    CASE WHEN bid > 0 AND ask >= bid THEN {R('(bid + ask) / 2 + (ask - bid) / 2 * 0.5', 4)} END AS buy_fill, {S('strike + strike * 0.0001::DOUBLE + 0.05::DOUBLE / 2 * 0.5', 6)} AS equity_buy,
    CASE WHEN bid <= 0 OR ask <= 0 THEN 'non-positive quote' WHEN ask < bid THEN 'crossed quote' WHEN volume > 60 THEN 'stale quote' WHEN (ask - bid) / ((bid + ask) / 2) > 0.10::DOUBLE THEN 'spread too wide' END AS reason FROM chain""",
    "chain",
)
def execution_costs(spark, sf):
    c = V.chain(spark, sf).withColumn("side", F.lit("BUY")).withColumn("spread", F.lit(0.05))
    return c.select(
        "contract_symbol", O.round_trip_cost(3).alias("cost_3x"), O.half_spread_fill("side").alias("buy_fill"),
        settled(O.equity_fill("strike", "side", "spread"), 6).alias("equity_buy"), O.tradeable_reason("volume").alias("reason"),
    )


GATE_IN = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 9 <> 0 THEN (l_partkey % 7 - 1)::DOUBLE END AS independent_events, CASE WHEN l_suppkey % 8 <> 0 THEN (l_suppkey % 12) / 10.0::DOUBLE END AS evidence_confidence,
  l_partkey % 13 = 0 AS unresolved_contradictions, l_partkey % 31 = 0 AS cutoff_violations, (l_orderkey % 90)::DOUBLE + CASE WHEN l_orderkey % 37 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS dte, l_discount * 1.5::DOUBLE - 0.01::DOUBLE AS relative_spread,
  (l_partkey * 3 % 3000)::DOUBLE AS open_interest, l_quantity * 4 AS daily_volume, l_orderkey % 19 <> 0 AS defined_risk, CASE WHEN l_orderkey % 23 = 0 THEN 'nan'::DOUBLE ELSE l_tax - 0.02::DOUBLE END AS expected_edge_after_costs,
  (l_suppkey % 4) / 100.0::DOUBLE AS position_pct, (l_suppkey % 9) / 100.0::DOUBLE AS portfolio_heat_pct, (l_orderkey % 7)::DOUBLE AS open_positions FROM lineitem"""


def _need(k: str, cond: str, name: str) -> str:
    return f"CASE WHEN {k} IS NULL THEN 'missing:{k}' WHEN isnan({k}) OR isinf({k}) THEN 'invalid_numeric:{k}' WHEN {cond} THEN '{name}' END"


def _iff(cond: str, name: str) -> str:
    return f"CASE WHEN {cond} THEN '{name}' END"


GATE_CHECKS = [
    _need("independent_events", "independent_events < 2", "insufficient_independent_evidence"), _need("evidence_confidence", "evidence_confidence < 0.6", "low_evidence_confidence"),
    _iff("unresolved_contradictions", "unresolved_contradictions"), _iff("cutoff_violations", "cutoff_violation"), _need("dte", "dte < 21 OR dte > 60", "dte_out_of_band"),
    _need("relative_spread", "relative_spread > 0.1::DOUBLE", "spread_too_wide"), _need("open_interest", "open_interest < 500", "insufficient_open_interest"), _need("daily_volume", "daily_volume < 50", "insufficient_volume"),
    _iff("NOT defined_risk", "undefined_risk_structure"), _need("expected_edge_after_costs", "expected_edge_after_costs <= 0", "no_edge_after_costs"), _need("position_pct", "position_pct > 0.02::DOUBLE", "position_too_large"),
    _need("portfolio_heat_pct", "portfolio_heat_pct > 0.06::DOUBLE", "portfolio_heat_exceeded"), _need("open_positions", "open_positions >= 5", "max_positions_reached"),
    *[_iff(f"{k} < 0 OR {k} <> floor({k})", f"invalid_numeric:{k}") for k in ("independent_events", "dte", "open_interest", "daily_volume", "open_positions")],
    *[_iff(f"{k} < 0 OR {k} > 1", f"invalid_numeric:{k}") for k in ("evidence_confidence", "position_pct", "portfolio_heat_pct")],
    _iff("position_pct = 0", "invalid_numeric:position_pct"), _iff("portfolio_heat_pct < position_pct", "invalid_numeric:portfolio_heat_pct"), _iff("relative_spread < 0", "invalid_numeric:relative_spread"),
]


@query(
    "risk_gate",
    f"""WITH g AS ({GATE_IN}), f AS (SELECT *, concat_ws(',', {', '.join(GATE_CHECKS)}) AS failed FROM g)
    SELECT l_orderkey, l_linenumber, l_partkey, failed, CASE WHEN failed = '' THEN 'PAPER_TRADE_CANDIDATE' WHEN regexp_matches(failed, 'missing:|invalid_numeric:|cutoff_violation|no_edge_after_costs|undefined_risk_structure|position_too_large|portfolio_heat_exceeded|max_positions_reached')
    THEN 'PASS' ELSE 'WATCH' END AS decision FROM f""",
)
def risk_gate(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    inputs = {
        "independent_events": F.when(pk % 9 != 0, (pk % 7 - 1).cast("double")), "evidence_confidence": F.when(sk % 8 != 0, sk % 12 / 10.0),
        "unresolved_contradictions": pk % 13 == 0, "cutoff_violations": pk % 31 == 0, "dte": (ok % 90).cast("double") + F.when(ok % 37 == 0, 0.5).otherwise(0.0),
        "relative_spread": F.col("l_discount") * 1.5 - 0.01, "open_interest": pk * 3 % 3000, "daily_volume": F.col("l_quantity") * 4, "defined_risk": ok % 19 != 0,
        "expected_edge_after_costs": F.when(ok % 23 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax") - 0.02), "position_pct": sk % 4 / 100.0, "portfolio_heat_pct": sk % 9 / 100.0, "open_positions": ok % 7,
    }
    df = G.with_gate(li, inputs)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.col("gate_failed").alias("failed"), F.col("gate").alias("decision"))


@query(
    "eligible_contracts",
    f"SELECT contract_symbol, ticker, snapshot_date, kind, {S('delta', 4)} AS delta, round_trip_cost_1x FROM eligible",
    "eligible",
)
def eligible_contracts(spark, sf):
    e = V.enriched_chain(spark, sf, liquid_only=True).filter(O.eligible())
    return e.select("contract_symbol", "ticker", "snapshot_date", "kind", settled("delta", 4).alias("delta"), "round_trip_cost_1x")


@query(
    "selection_metrics",
    f"""SELECT contract_symbol, {S('abs(abs(delta) - 0.35::DOUBLE)', 4)} AS delta_gap, {S('round_trip_cost_1x / ask / 100', 6)} AS round_trip_cost_pct_premium, {S('greatest(-theta_per_day, 0) / ask', 4)} AS theta_pct_premium_per_day, CAST(dd AS BIGINT) AS dte_distance,
    {S('round_trip_cost_1x / (abs(delta) * 100) / underlying_close', 4)} AS breakeven_move_pct FROM eligible""",
    "eligible",
)
def selection_metrics(spark, sf):
    e = V.enriched_chain(spark, sf, liquid_only=True).filter(O.eligible())
    m = O.selection_metrics(0.35)
    return e.select(
        "contract_symbol", settled(m["delta_gap"], 4).alias("delta_gap"), settled(m["round_trip_cost_pct_premium"], 6).alias("round_trip_cost_pct_premium"),
        settled(m["theta_pct_premium_per_day"], 4).alias("theta_pct_premium_per_day"), m["dte_distance"].cast("long").alias("dte_distance"), settled(O.breakeven_move_pct(), 4).alias("breakeven_move_pct"),
    )


def _metrics(df, target=0.35):
    return df.select("*", *[c.alias(n) for n, c in O.selection_metrics(target).items()])


@query(
    "rank_contracts",
    " UNION ALL ".join(
        f"SELECT ticker, kind, '{m}' AS mode, CAST(k AS BIGINT) AS rank, contract_symbol FROM (SELECT *, row_number() OVER (PARTITION BY ticker, kind ORDER BY {o}) AS k FROM eligible) WHERE k <= 5" for m, o in ORDER.items()
    ),
    "eligible",
)
def rank_contracts(spark, sf):
    from ..session import materialize

    needed = ["ticker", "contract_symbol", "kind", "expiration", "strike", "relative_spread", "open_interest", "volume", *O.selection_metrics(0.35)]
    e = materialize(_metrics(V.enriched_chain(spark, sf, liquid_only=True).filter(O.eligible())).select(*needed), "eligible")
    parts = [O.top_contracts(e, ["ticker", "kind"], m).select("ticker", "kind", F.lit(m).alias("mode"), F.col("rank").cast("long").alias("rank"), "contract_symbol") for m in ORDER]
    return parts[0].unionByName(parts[1])


AUDIT_METRICS = {
    "delta_gap": ("abs(abs(delta) - 0.35::DOUBLE)", 4), "round_trip_cost_pct_premium": ("round_trip_cost_1x / ask / 100", 6), "theta_pct_premium_per_day": ("greatest(-theta_per_day, 0) / ask", 4),
    "signed_theta_pct_premium_per_day": ("theta_per_day / ask", 4), "relative_spread": ("relative_spread", 6), "iv_solved": ("iv_solved", 4), "gamma": ("gamma", 4), "vega": ("vega", 4),
}
AUDIT_PLAIN = "ticker, snapshot_date, kind, eligible_count, alternatives_truncated, " + ", ".join(f"{m}_{c}" for m in ("baseline", "cost_aware") for c in ("contract", "expiration", "strike")) + ", contract_symbol, expiration, strike, open_interest, volume"


def audit_sql(mode: str) -> str:
    metrics = ", ".join(f"{S(x, digits)} AS {name}" for name, (x, digits) in AUDIT_METRICS.items())
    return f"""SELECT {AUDIT_PLAIN}, '{mode}' AS mode, CAST(k_{mode} AS BIGINT) AS rank, {metrics}, inside AS inside_delta_tolerance, CAST(dte AS BIGINT) AS dte, CAST(dd AS BIGINT) AS dte_distance,
    0.35::DOUBLE AS target_abs_delta, 0.08::DOUBLE AS delta_tolerance, 40::BIGINT AS preferred_dte, 100::BIGINT AS contract_multiplier_assumption, '{O.QUOTE_AGE_STATUS}' AS quote_age_status,
    '{O.SELECTION_VERSION}' AS selection_version, '{O.VALIDATION_STATUS}' AS validation_status, '{O.AUDIT_NOTE}' AS note FROM audited WHERE k_{mode} <= 5"""


def _first_sql(mode: str, name: str) -> str:
    return ", ".join(f"first_value({c}) OVER (PARTITION BY ticker, snapshot_date, kind ORDER BY {ORDER[mode]}) AS {name}_{c.removesuffix('_symbol')}" for c in ("contract_symbol", "expiration", "strike"))


@query(
    "selection_audit",
    f"""WITH audited AS (SELECT *, count(*) OVER (PARTITION BY ticker, snapshot_date, kind) AS eligible_count, count(*) OVER (PARTITION BY ticker, snapshot_date, kind) > 5 AS alternatives_truncated,
     {_first_sql("delta", "baseline")}, {_first_sql("cost_aware", "cost_aware")}, {", ".join(f"row_number() OVER (PARTITION BY ticker, snapshot_date, kind ORDER BY {o}) AS k_{m}" for m, o in ORDER.items())} FROM eligible)
    {" UNION ALL ".join(audit_sql(m) for m in ORDER)}""",
    "eligible",
)
def selection_audit(spark, sf):
    from ..session import materialize

    needed = [
        "ticker", "snapshot_date", "contract_symbol", "kind", "expiration", "strike", "ask", "delta", "theta_per_day", "round_trip_cost_1x", "dte", "relative_spread", "open_interest", "volume", "iv_solved", "gamma", "vega",
    ]
    e = materialize(V.enriched_chain(spark, sf, liquid_only=True).filter(O.eligible()).select(*needed), "eligible")
    a = O.selection_audit(e, ["ticker", "snapshot_date", "kind"], 0.35)
    exact = {c: F.col(c).cast("long") for c in ("rank", "dte", "dte_distance")}
    return a.drop("ask", "delta", "theta_per_day", "round_trip_cost_1x").withColumns({**exact, **{c: settled(c, digits) for c, (_, digits) in AUDIT_METRICS.items()}})


def tally_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE NOT scr_dte) AS f1, count(*) FILTER (WHERE NOT scr_spread) AS f2, count(*) FILTER (WHERE NOT scr_oi) AS f3, count(*) FILTER (WHERE NOT scr_vol) AS f4,
    count(*) FILTER (WHERE model_status <> 'OK') AS f5, count(*) FILTER (WHERE model_status = 'OK' AND liquidity_screen = 'PASS' AND contract_symbol NOT IN (SELECT contract_symbol FROM eligible)) AS f6,
    count(*) FILTER (WHERE contract_symbol IN (SELECT contract_symbol FROM eligible)) AS n_eligible FROM enriched GROUP BY {keys}"""


LABELS = ("DTE outside entry band", "spread", "open interest", "volume", "unmodellable Greeks", "invalid contract fields")
DETAIL = "concat_ws('; ', " + ", ".join(f"CASE WHEN f{i + 1} > 0 THEN '{n}: ' || f{i + 1} || '/' || n END" for i, n in enumerate(LABELS)) + ")"


@query("rejection_tally", f"SELECT ticker, kind, n, n_eligible, {DETAIL} AS detail FROM ({tally_sql('ticker, kind')})", "enriched eligible")
def rejection_tally(spark, sf):
    return O.rejection_tally(V.enriched_chain(spark, sf, liquid_model=True), ["ticker", "kind"]).select("ticker", "kind", "n", "n_eligible", "detail")


@query(
    "account_feasibility",
    f"""SELECT c_custkey, equity_usd, option_mid, contracts, {R('cost', 2)} AS one_contract_cost_usd, {R('equity_usd * 0.02::DOUBLE', 2)} AS standard_budget_usd, cost <= equity_usd * 0.02::DOUBLE AS affordable,
    {R('cost / equity_usd', 4)} AS pct_of_account, {R('cost * 0.101::DOUBLE', 2)} AS round_trip_cost_usd, {R('cost * 0.101::DOUBLE / equity_usd', 4)} AS cost_pct_of_account,
    CAST(floor(equity_usd * 0.06::DOUBLE / cost) AS BIGINT) AS max_positions, CASE WHEN cost > equity_usd * 0.02::DOUBLE THEN 'STANDARD_LIMITS_INFEASIBLE' ELSE 'STANDARD_LIMITS_FEASIBLE' END AS verdict FROM
    (SELECT *, option_mid * 100.0::DOUBLE * contracts AS cost FROM (SELECT c_custkey, abs(c_acctbal) * 3 + 500 AS equity_usd, (c_custkey % 40) / 10.0::DOUBLE + 0.15::DOUBLE AS option_mid, c_custkey % 3 + 1 AS contracts FROM customer))""",
)
def account_feasibility(spark, sf):
    i = F.col("c_custkey")
    s = V.table(spark, sf, "customer").select("c_custkey", (F.abs("c_acctbal") * 3 + 500).alias("equity_usd"), (i % 40 / 10.0 + 0.15).alias("option_mid"), (i % 3 + 1).alias("contracts"))
    return G.account_feasibility(s)
