"""Proposals, integrity, outcomes and summaries over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.guards import settled
from ..operators import features as FE
from ..operators import picks as PK
from ..sources import views as V
from .options import D1, ORDER, PHI, tally_sql, DETAIL
from .registry import R, S, fragment, query
from .study import score_sql

fragment(
    "tally",
    f"SELECT ticker, decision_date, kind, n, {DETAIL} AS detail FROM ({tally_sql('ticker, snapshot_date, kind')}) t(ticker, decision_date, kind, n, f1, f2, f3, f4, f5, f6, n_eligible)",
    "enriched eligible",
)
fragment("best", f"SELECT * FROM (SELECT *, snapshot_date AS decision_date, row_number() OVER (PARTITION BY ticker, snapshot_date, kind ORDER BY {ORDER['delta']}) AS k FROM eligible) WHERE k = 1", "eligible")
fragment(
    "scores",
    " UNION ALL ".join(
        f"""SELECT ticker, decision_date, '{v}' AS variant, {S(score_sql(w), 8)} AS score, concat_ws(', ', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in w)}) AS missing FROM decision_feat WHERE ticker <> 'MKT'"""
        for v, w in FE.VARIANT_WEIGHTS.items()
    ),
    "decision_feat",
)
fragment(
    "picks",
    f"""SELECT s.decision_date, s.variant, s.ticker, s.kind AS k, score, b.contract_symbol IS NOT NULL AND go AS hit, CASE WHEN dayofweek(s.decision_date) IN (0, 6) THEN 'market closed: decision date is a weekend'
   WHEN score IS NULL THEN 'insufficient history for: ' || missing WHEN abs(score) < 0.2 THEN printf('conviction %.2f below the variant''s 0.20 floor', {R('abs(score)', 2)})
   WHEN b.contract_symbol IS NULL THEN 'no ' || s.kind || ' passed the liquidity screen with modellable Greeks (' || coalesce(n, 0) || ' ' || s.kind || 's in the snapshot)' || CASE WHEN coalesce(detail, '') <> '' THEN '. Failed checks (can overlap): ' || detail ELSE '' END END AS reason,
   CASE WHEN b.contract_symbol IS NOT NULL AND go THEN b.contract_symbol END AS contract_symbol, b.expiration, b.strike, b.dte, b.ask AS entry, b.iv_solved, b.underlying_close, b.delta, b.round_trip_cost_1x FROM
   (SELECT *, CASE WHEN score > 0 THEN 'CALL' ELSE 'PUT' END AS kind, coalesce(abs(score) >= 0.2 AND dayofweek(decision_date) NOT IN (0, 6), FALSE) AS go FROM scores) s
   LEFT JOIN best b ON b.ticker = s.ticker AND b.decision_date = s.decision_date AND b.kind = s.kind LEFT JOIN tally t ON t.ticker = s.ticker AND t.decision_date = s.decision_date AND t.kind = s.kind""",
    "scores best tally",
)
ACTION = "CASE WHEN hit THEN 'PAPER_LONG_' || k ELSE 'ABSTAIN' END"
DIRECTION = "CASE WHEN hit THEN CASE WHEN k = 'CALL' THEN 'BULLISH' ELSE 'BEARISH' END END"


@query(
    "generate_picks",
    f"""SELECT decision_date, variant, ticker, {ACTION} AS action, {DIRECTION} AS direction, reason, CASE WHEN dayofweek(decision_date) NOT IN (0, 6) THEN {R('score', 4)} END AS composite_score, contract_symbol,
    CASE WHEN hit THEN entry END AS entry_fill, CASE WHEN hit THEN {S(R('round_trip_cost_1x / (abs(delta) * 100) / underlying_close', 6), 4)} END AS breakeven_move_pct FROM picks""",
    "picks",
)
def generate_picks(spark, sf):
    picks, _, _ = V.picks_inputs(spark, sf)
    return picks.select(
        "decision_date", "variant", "ticker", "action", "direction", "reason", "composite_score", "contract_symbol", "entry_fill",
        settled("breakeven_move_pct", 4).alias("breakeven_move_pct"),
    )


@query(
    "pick_runs",
    f"""SELECT decision_date, count(*) FILTER (WHERE hit) AS n_picks, count(*) FILTER (WHERE NOT hit) AS n_abstentions,
    sha256(concat_ws('-', {', '.join(f"bit_xor(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT))" for i in range(4))})) AS picks_sha256, 'OK' AS integrity FROM
    (SELECT *, sha256(concat_ws('|', decision_date, variant, ticker, {ACTION}, coalesce({DIRECTION}, ''), coalesce(contract_symbol, ''))) AS h FROM picks) GROUP BY 1""",
    "picks",
)
def pick_runs(spark, sf):
    picks, _, _ = V.picks_inputs(spark, sf)
    return PK.verify(picks, PK.freeze(picks)).select("decision_date", "n_picks", "n_abstentions", "picks_sha256", "integrity")


@query(
    "explanations",
    f"""SELECT decision_date, variant, ticker, CASE WHEN hit THEN printf('%s scored %+.4f (%s). %s %.0f %s, %d DTE, selected by delta. Paper hypothesis; not a profit guarantee.', ticker, {R('score', 4)}, lower({DIRECTION}), CAST(expiration AS VARCHAR), strike, lower(k), CAST(dte AS BIGINT))
     ELSE ticker || ': ABSTAIN. ' || reason END AS short_justification,
    sha256('{{"action":"' || {ACTION} || '","contract_symbol":' || coalesce('"' || contract_symbol || '"', 'null') || ',"decision_date":"' || decision_date || '","direction":' || coalesce('"' || {DIRECTION} || '"', 'null')
     || ',"ticker":"' || ticker || '","variant":"' || variant || '"}}') AS fingerprint FROM picks""",
    "picks",
)
def explanations(spark, sf):
    picks, _, _ = V.picks_inputs(spark, sf)
    return PK.explain(picks).select("decision_date", "variant", "ticker", "short_justification", "fingerprint")


BSD = D1("spot", "strike", "tl", "0.04::DOUBLE", "iv_solved", "0")
fragment("numbered", "SELECT ticker, date, close, count(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS upto FROM bars", "bars")
fragment(
    "marks",
    f"""SELECT *, CASE WHEN mark_date IS NULL OR mark IS NULL THEN NULL WHEN dl > 0 AND dl < 21 THEN 'DTE_FLOOR' WHEN rop >= 0.5 THEN 'PROFIT_TARGET' WHEN rop <= -0.5 THEN 'STOP_LOSS' WHEN day_no = 5 THEN 'TIME_STOP' END AS trig FROM
   (SELECT *, ((mark - entry) * 100 - 1.6::DOUBLE) / (entry * 100) AS rop FROM (SELECT *, coalesce(mbid, model) AS mark, CASE WHEN mbid IS NOT NULL THEN 'MARKET' ELSE 'MODELLED' END AS method FROM
   (SELECT *, CASE WHEN tl IS NULL THEN NULL WHEN k = 'CALL' THEN spot * {PHI('d1')} - strike * exp(-0.04::DOUBLE * tl) * {PHI('d2')} ELSE strike * exp(-0.04::DOUBLE * tl) * {PHI('(-d2)')} - spot * {PHI('(-d1)')} END AS model FROM
   (SELECT *, {BSD} AS d1, {BSD} - iv_solved * sqrt(tl) AS d2 FROM (SELECT p.*, day_no, f.date AS mark_date, f.close AS spot, p.expiration - f.date AS dl, CASE WHEN p.expiration > f.date THEN (p.expiration - f.date) / 365.0::DOUBLE END AS tl, q.bid AS mbid FROM
    (SELECT * FROM picks WHERE hit) p JOIN numbered s ON s.ticker = p.ticker AND s.date = p.decision_date CROSS JOIN (SELECT unnest(range(1, 6)) AS day_no)
    LEFT JOIN (SELECT * FROM numbered WHERE close IS NOT NULL) f ON f.ticker = p.ticker AND f.upto = s.upto + day_no
    LEFT JOIN (SELECT ticker, snapshot_date, kind, expiration, strike, arg_min(bid, line_no) AS bid FROM chain WHERE status = 'OK' GROUP BY ALL) q ON q.ticker = p.ticker AND q.snapshot_date = f.date AND q.kind = p.k AND q.expiration = p.expiration AND q.strike = p.strike)))))""",
    "picks numbered chain",
)
fragment(
    "dirlabel",
    """SELECT a.ticker, a.date, CASE WHEN a.ds = m.ds AND len(a.ds) = 5 THEN a.lr - m.lr END AS excess FROM
  (SELECT * FROM dl0 WHERE ticker <> 'MKT') a LEFT JOIN (SELECT * FROM dl0 WHERE ticker = 'MKT') m USING (date)""",
    "dl0",
)
fragment(
    "dl0",
    """SELECT ticker, date, list(date) OVER w AS ds, sum(ln(1 + fr)) OVER w AS lr FROM (SELECT *, coalesce(r, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) AS fr FROM bars WHERE close IS NOT NULL)
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""",
    "bars",
)
fragment(
    "outcomes",
    f"""SELECT *, CASE WHEN status = 'RESOLVED' AND nd >= 5 AND excess IS NOT NULL THEN (excess > 0) = (k = 'CALL') END AS dir_ok FROM (SELECT g.*, l.excess, CASE WHEN nd = 0 THEN 'OPEN' WHEN un IS NOT NULL AND (fd IS NULL OR un < fd) THEN 'UNMARKABLE' WHEN fd IS NOT NULL THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM
  (SELECT decision_date, variant, ticker, any_value(k) AS k, any_value(entry) AS entry, any_value(underlying_close) AS s0, count(mark_date) AS nd, min(day_no) FILTER (WHERE mark_date IS NOT NULL AND mark IS NULL) AS un, min(day_no) FILTER (WHERE trig IS NOT NULL) AS fd,
   arg_min(trig, day_no) FILTER (WHERE trig IS NOT NULL) AS trig, arg_min(mark_date, day_no) FILTER (WHERE trig IS NOT NULL) AS xd, arg_min(mark, day_no) FILTER (WHERE trig IS NOT NULL) AS xp, arg_min(method, day_no) FILTER (WHERE trig IS NOT NULL) AS xm,
   arg_min(rop, day_no) FILTER (WHERE trig IS NOT NULL) AS xr, list(method ORDER BY day_no) AS ms, max(mark_date) FILTER (WHERE day_no = 5) AS hd, max(spot) FILTER (WHERE day_no = 5) AS hs FROM marks GROUP BY 1, 2, 3) g
  LEFT JOIN dirlabel l ON l.ticker = g.ticker AND l.date = g.decision_date)""",
    "marks dirlabel",
)
PROV = "CASE WHEN len(list_distinct(list_slice(ms, 1, fd))) > 1 THEN 'MIXED' WHEN ms[1] = 'MARKET' THEN 'OBSERVED_ONLY' ELSE 'MODELLED_ONLY' END"


def _outcomes(spark, sf):
    picks, b, c = V.picks_inputs(spark, sf)
    out = PK.resolve_picks(PK.mark_path(picks, b, c))
    return PK.with_direction(out, PK.direction_labels(b, V.BENCHMARK))


@query(
    "resolve_picks",
    f"""SELECT decision_date, variant, ticker, status, CASE WHEN status = 'RESOLVED' THEN trig END AS exit_trigger, CASE WHEN status = 'RESOLVED' THEN xd END AS exit_date, CASE WHEN status = 'RESOLVED' THEN fd END AS days_held,
    CASE WHEN status = 'RESOLVED' THEN {S(R('xp', 4), 3)} END AS exit_price, CASE WHEN status = 'RESOLVED' THEN xm END AS exit_mark_method, CASE WHEN status = 'RESOLVED' THEN {PROV} END AS exit_path_provenance,
    CASE WHEN status = 'RESOLVED' THEN hd END AS horizon_date, CASE WHEN status = 'RESOLVED' AND nd >= 5 THEN {S('hs / s0 - 1', 8)} END AS underlying_move_pct, dir_ok AS direction_correct FROM outcomes""",
    "outcomes",
)
def resolve_picks(spark, sf):
    return _outcomes(spark, sf).select(
        "decision_date", "variant", "ticker", "status", "exit_trigger", "exit_date", F.col("days_held").cast("long").alias("days_held"), settled("exit_price", 3).alias("exit_price"), "exit_mark_method",
        "exit_path_provenance", "horizon_date", settled("underlying_move_pct", 8).alias("underlying_move_pct"), "direction_correct",
    )


@query(
    "summarise_outcomes",
    f"""WITH d AS (SELECT *, {PROV} AS prov, {R('xr', 4)} AS r FROM outcomes WHERE status = 'RESOLVED'),
    h AS (SELECT variant, prov, string_agg(trig || ':' || n, ', ' ORDER BY trig) AS exit_triggers FROM (SELECT variant, prov, trig, count(*) AS n FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT d.variant, 'delta' AS selection_policy, d.prov AS exit_path_provenance, count(*) AS resolved, count(dir_ok) AS direction_scored, count(*) FILTER (WHERE dir_ok) AS direction_hits, {S('avg(r)', 4)} AS mean_return,
    {S('max(r)', 3)} AS best_return, {S('min(r)', 3)} AS worst_return, count(*) FILTER (WHERE r > 0) AS wins, count(*) FILTER (WHERE r <= 0) AS losses, any_value(exit_triggers) AS exit_triggers FROM d JOIN h USING (variant, prov) GROUP BY 1, 2, 3""",
    "outcomes",
)
def summarise_outcomes(spark, sf):
    s = PK.summarise(_outcomes(spark, sf))
    return s.select(
        "variant", "selection_policy", "exit_path_provenance", "resolved", "direction_scored", "direction_hits", settled("mean_return", 4).alias("mean_return"), settled("best_return", 3).alias("best_return"),
        settled("worst_return", 3).alias("worst_return"), "wins", "losses", "exit_triggers",
    )


VOIDED = "day(decision_date) % 5 = 0"


def _history(spark, sf):
    """Runs of some days carry an altered seal."""
    picks, b, c = V.picks_inputs(spark, sf)
    sealed = PK.freeze(picks)
    altered = sealed.withColumn("picks_sha256", F.when(F.dayofmonth("decision_date") % 5 == 0, F.sha2("picks_sha256", 256)).otherwise(F.col("picks_sha256")))
    out = PK.with_direction(PK.resolve_picks(PK.mark_path(picks, b, c)), PK.direction_labels(b, V.BENCHMARK))
    return PK.pick_history(picks, altered, out)


@query(
    "pick_history",
    f"""SELECT decision_date, variant, ticker, action, CASE WHEN {VOIDED} THEN 'VOID' ELSE 'OK' END AS integrity, status
    FROM (SELECT decision_date, variant, ticker, {ACTION} AS action FROM picks) LEFT JOIN (SELECT decision_date, variant, ticker, status FROM outcomes) USING (decision_date, variant, ticker)""",
    "picks outcomes",
)
def pick_history(spark, sf):
    return _history(spark, sf).select("decision_date", "variant", "ticker", "action", "integrity", "status")


@query(
    "pick_performance",
    f"""WITH d AS (SELECT *, {PROV} AS prov, {R('xr', 4)} AS r FROM outcomes WHERE status = 'RESOLVED' AND NOT ({VOIDED}))
    SELECT variant, prov AS exit_path_provenance, count(*) AS resolved, count(*) FILTER (WHERE dir_ok) AS direction_hits, {S('avg(r)', 4)} AS mean_return, count(*) FILTER (WHERE r > 0) AS wins FROM d GROUP BY 1, 2""",
    "outcomes",
)
def pick_performance(spark, sf):
    """Summaries over trusted runs alone."""
    s = PK.summarise(PK.trusted(_history(spark, sf)))
    return s.groupBy("variant", "exit_path_provenance").agg(
        F.sum("resolved").alias("resolved"), F.sum("direction_hits").alias("direction_hits"), settled(F.sum(F.col("mean_return") * F.col("resolved")) / F.sum("resolved"), 4).alias("mean_return"), F.sum("wins").alias("wins")
    )
