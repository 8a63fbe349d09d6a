"""Bars, features, labels, splits, evaluation and rank IC over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.guards import rounded, settled
from ..operators import bars as B
from ..operators import calendar as C
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import labels as L
from ..operators import rank_ic as IC
from ..sources import views as V
from .registry import ET, R, S, fragment, query

CLOSE_SQL = R("100 * (1 + (sd - st) / (n * 100.0::DOUBLE))", 4)

fragment(
    "sums",
    """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS sd,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS st,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, CAST(sum(l_orderkey) AS BIGINT) AS ok
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
fragment(
    "raw_bars",
    f"""SELECT ticker, date, CASE WHEN ok % 97 <> 0 THEN {CLOSE_SQL} END AS close, volume,
  CASE WHEN ok % 61 = 0 THEN 0.25::DOUBLE END AS dividend,
  CASE WHEN ok % 83 = 0 THEN [10.0, 1.25, 2.0, -1.0][(ok // 83) % 4 + 1]::DOUBLE END AS split FROM sums
  UNION ALL
  SELECT 'MKT', date, {CLOSE_SQL}, volume, NULL, NULL FROM
  (SELECT date, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sd) AS BIGINT) AS sd, CAST(sum(st) AS BIGINT) AS st,
   CAST(sum(volume) AS BIGINT) AS volume FROM sums GROUP BY 1)""",
    "sums",
)
fragment(
    "lagged",
    "SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM raw_bars",
    "raw_bars",
)
SUSPECT_SQL = (
    "(split > 0 AND NOT (split > 0.5 AND split < 2.0) AND close > 0 AND prev > 0 "
    "AND abs(close / prev - 1 / split) <= 1 / split * 0.15::DOUBLE)"
)
fragment(
    "bars",
    f"""SELECT ticker, date, close, volume,
  CASE WHEN close IS NOT NULL THEN coalesce(dividend, 0) END AS dividend,
  CASE WHEN close IS NOT NULL AND prev > 0 AND NOT coalesce({SUSPECT_SQL}, FALSE)
       THEN (close + coalesce(dividend, 0)) / prev - 1 END AS r,
  CASE WHEN close IS NULL THEN 'UNKNOWN' WHEN coalesce({SUSPECT_SQL}, FALSE) THEN 'SPLIT_UNADJUSTED'
       WHEN prev > 0 THEN 'OK' ELSE 'NO_PRIOR_CLOSE' END AS status FROM lagged""",
    "lagged",
)


fragment(
    "split_lagged",
    """SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM
  (SELECT * REPLACE (CASE WHEN split = 2 THEN close / 2 ELSE close END AS close) FROM raw_bars)""",
    "raw_bars",
)
fragment(
    "priced",
    f"""SELECT *, close IS NOT NULL AS known, close IS NOT NULL AND coalesce({SUSPECT_SQL}, FALSE) AS suspect FROM split_lagged""",
    "split_lagged",
)


@query(
    "normalize_bars",
    f"""SELECT ticker, date, CASE WHEN known THEN {ET('date', 960)} END AS event_time, CASE WHEN known THEN {ET('date', 1980)} END AS available_time,
    {R('close + (volume % 3 - 1) / 100.0::DOUBLE', 4)} AS open, {R('close + (volume % 7) / 100.0::DOUBLE', 4)} AS high, {R('close - (volume % 5) / 100.0::DOUBLE', 4)} AS low, close, volume, CASE WHEN known THEN coalesce(dividend, 0) END AS dividend,
    CASE WHEN known AND prev > 0 AND NOT suspect THEN {S('(close + coalesce(dividend, 0)) / prev - 1', 9)} END AS daily_total_return,
    CASE WHEN NOT known THEN 'UNKNOWN' WHEN suspect THEN 'SPLIT_UNADJUSTED' WHEN prev > 0 THEN 'OK' ELSE 'NO_PRIOR_CLOSE' END AS status, CASE WHEN suspect THEN split END AS split_ratio,
    CASE WHEN suspect THEN printf('a split of %.2f was announced and the close moved by a factor of %.4f', split, {R('close / prev', 4)}) END AS reason FROM priced""",
    "priced",
)
def normalize_bars(spark, sf):
    """Bars of a vendor that does not adjust its two-for-one splits."""
    v = F.col("volume")
    priced = V.split_bars(spark, sf).select("*", *[rounded(F.col("close") + d / F.lit(100.0), 4).alias(c) for c, d in (("open", v % 3 - 1), ("high", v % 7), ("low", -(v % 5)))])
    return B.normalize_bars(priced).withColumn("daily_total_return", settled("daily_total_return", 9))


@query(
    "bar_clocks",
    f"""SELECT date, {ET('date', 960)} AS event_time, {ET('date', 1980)} AS available_time,
    {ET('date', 945)} AS decision_time, count(*) AS bars FROM bars GROUP BY date""",
    "bars",
)
def bar_clocks(spark, sf):
    from ..functions import clock

    days = V.bars(spark, sf).groupBy("date").agg(F.count("*").alias("bars"))
    return days.select(
        "date", clock.bar_event_time("date").alias("event_time"), clock.bar_available_time("date").alias("available_time"),
        clock.decision_time("date").alias("decision_time"), "bars",
    )


@query(
    "daily_total_return",
    f"""SELECT ticker, date, {S('CASE WHEN close IS NOT NULL AND prev > 0 THEN (close + coalesce(dividend, 0)) / prev - 1 END', 9)}
    AS daily_total_return FROM lagged""",
    "lagged",
)
def daily_total_return(spark, sf):
    df = B.daily_total_return(V.raw_bars(spark, sf))
    return df.select("ticker", "date", settled("daily_total_return", 9).alias("daily_total_return"))


@query(
    "check_split_adjustment",
    f"""WITH h AS (SELECT ticker, date, split, CASE WHEN split = 2.0 THEN close / 2 ELSE close END AS close FROM raw_bars),
    p AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM h),
    s AS (SELECT *, split > 0.5 AND split < 2.0 AS small, coalesce(close > 0 AND prev > 0, FALSE) AS usable FROM p WHERE split IS NOT NULL)
    SELECT ticker, date, split AS ratio,
    CASE WHEN NOT split > 0 THEN 'UNCHECKABLE' WHEN small THEN 'IMMATERIAL' WHEN NOT usable THEN 'UNCHECKABLE'
         WHEN abs(close / prev - 1 / split) <= 1 / split * 0.15::DOUBLE THEN 'UNADJUSTED' ELSE 'ADJUSTED' END AS verdict,
    {S('CASE WHEN split > 0 AND NOT small AND usable THEN close / prev END', 6)} AS observed_ratio,
    {S('CASE WHEN split > 0 THEN 1 / split END', 6)} AS expected_if_raw FROM s""",
    "raw_bars",
)
def check_split_adjustment(spark, sf):
    v = B.split_verdicts(V.split_bars(spark, sf))
    return v.withColumn("observed_ratio", settled("observed_ratio", 6)).withColumn("expected_if_raw", settled("expected_if_raw", 6))


# ---- features -------------------------------------------------------------

W = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
fragment(
    "feat0",
    f"""SELECT ticker, date, close,
  CASE WHEN count(r) OVER {W.format(19)} = 20 THEN product(1 + r) OVER {W.format(19)} - 1 END AS return_20d,
  CASE WHEN count(r) OVER {W.format(59)} = 60 THEN product(1 + r) OVER {W.format(59)} - 1 END AS return_60d,
  CASE WHEN count(close) OVER {W.format(49)} = 50 AND min(close) OVER {W.format(49)} > 0
       THEN close / avg(close) OVER {W.format(49)} - 1 END AS distance_from_sma50,
  CASE WHEN count(r) OVER {W.format(19)} = 20 THEN stddev_samp(r) OVER {W.format(19)} * sqrt(252) END AS vol_20d,
  close / max(close) OVER {W.format(251)} - 1 AS drawdown_252d,
  row_number() OVER (PARTITION BY ticker ORDER BY date) AS bars_available FROM bars WHERE close IS NOT NULL""",
    "bars",
)
fragment(
    "feat1",
    """SELECT a.ticker, a.date, any_value(a.cur) AS cur, count(b.vol_20d) AS vols,
  count(b.vol_20d) FILTER (WHERE b.vol_20d <= a.cur) AS le FROM
  (SELECT *, last_value(round_even(vol_20d * 1e12, 0) IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS cur FROM feat0) a
  JOIN (SELECT ticker, date, round_even(vol_20d * 1e12, 0) AS vol_20d FROM feat0) b ON a.ticker = b.ticker AND b.date <= a.date GROUP BY 1, 2""",
    "feat0",
)
fragment(
    "raw_feat",
    """SELECT f.*, CASE WHEN bars_available >= 83 AND vols >= 20 THEN le / vols::DOUBLE END AS vol_percentile
  FROM feat0 f JOIN feat1 USING (ticker, date)""",
    "feat0 feat1",
)
CLIP = "CASE WHEN {0} IS NOT NULL THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {1})) END"
fragment(
    "scaled_feat",
    f"""SELECT *, {CLIP.format('return_20d', 'return_20d / 0.10::DOUBLE')} AS momentum_20d,
  {CLIP.format('return_60d', 'return_60d / 0.20::DOUBLE')} AS momentum_60d,
  {CLIP.format('distance_from_sma50', 'distance_from_sma50 / 0.10::DOUBLE')} AS trend_50d,
  {CLIP.format('vol_percentile', '1 - 2 * vol_percentile')} AS low_volatility,
  {CLIP.format('drawdown_252d', '-drawdown_252d / 0.20::DOUBLE')} AS reversion FROM raw_feat""",
    "raw_feat",
)
fragment(
    "decision_feat",
    """SELECT b.ticker, b.date AS decision_date, f.date AS as_of_date, f.* EXCLUDE (ticker, date)
  FROM bars b ASOF LEFT JOIN scaled_feat f ON b.ticker = f.ticker AND b.date > f.date""",
    "bars scaled_feat",
)


def _rounded(df, digits, *names):
    for n in names:
        df = df.withColumn(n, settled(n, digits))
    return df


@query(
    "trailing_features",
    f"""SELECT ticker, date, {S('return_20d', 8)} AS return_20d, {S('return_60d', 8)} AS return_60d,
    {S('distance_from_sma50', 8)} AS distance_from_sma50, {S('vol_20d', 8)} AS vol_20d,
    {S('drawdown_252d', 8)} AS drawdown_252d, bars_available FROM feat0""",
    "feat0",
)
def trailing_features(spark, sf):
    names = ["return_20d", "return_60d", "distance_from_sma50", "vol_20d", "drawdown_252d"]
    return _rounded(FE.raw_features(V.bars(spark, sf)).select("ticker", "date", *names, "bars_available"), 8, *names)


@query(
    "volatility_percentile",
    f"SELECT ticker, date, {S('vol_percentile', 8)} AS vol_percentile FROM raw_feat",
    "raw_feat",
)
def volatility_percentile(spark, sf):
    df = FE.raw_features(V.bars(spark, sf))
    return df.select("ticker", "date", settled("vol_percentile", 8).alias("vol_percentile"))


@query(
    "decision_components",
    f"""SELECT ticker, decision_date, as_of_date, bars_available, {', '.join(f'{S(c, 8)} AS {c}' for c in FE.COMPONENTS)} FROM decision_feat""",
    "decision_feat",
)
def decision_components(spark, sf):
    df = FE.decision_features(V.bars_table(spark, sf))
    return df.select(
        "ticker", "decision_date", "as_of_date", "bars_available",
        *[settled(c, 8).alias(c) for c in FE.COMPONENTS],
    )


def score_sql(weights: dict[str, float], missing_as_zero: bool = False) -> str:
    total = sum(abs(w) for w in weights.values())
    term = "coalesce({c}, 0) * {w!r}::DOUBLE" if missing_as_zero else "{c} * {w!r}::DOUBLE"
    return " + ".join(term.format(c=c, w=w / total) for c, w in weights.items())


@query(
    "variant_scores",
    " UNION ALL ".join(
        f"""SELECT ticker, decision_date, '{name}' AS variant, {S(score_sql(w), 8)} AS score,
        concat_ws(', ', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in w)}) AS missing FROM decision_feat"""
        for name, w in FE.VARIANT_WEIGHTS.items()
    ),
    "decision_feat",
)
def variant_scores(spark, sf):
    return FE.variant_scores(FE.decision_features(V.bars_table(spark, sf))).withColumn("score", settled("score", 8))


@query(
    "study_weighted_score",
    f"SELECT ticker, decision_date, {S(score_sql(FE.VARIANT_WEIGHTS['balanced'], True), 8)} AS score FROM decision_feat",
    "decision_feat",
)
def study_weighted_score(spark, sf):
    df = FE.decision_features(V.bars_table(spark, sf))
    return df.select("ticker", "decision_date", settled(FE.weighted_columns(FE.VARIANT_WEIGHTS["balanced"], True), 8).alias("score"))


_BAL = FE.VARIANT_WEIGHTS["balanced"]


@query(
    "contributions",
    f"""WITH u AS ({' UNION ALL '.join(
        f"SELECT ticker, decision_date, '{c}' AS indicator, {S(f'{c} * {w!r}::DOUBLE', 8)} AS x FROM decision_feat" for c, w in _BAL.items())}),
    k AS (SELECT *, row_number() OVER (PARTITION BY ticker, decision_date ORDER BY abs(x) DESC, indicator) AS rk FROM u WHERE x IS NOT NULL)
    SELECT d.ticker, d.decision_date, coalesce(string_agg(indicator, ',' ORDER BY rk) FILTER (WHERE rk <= 3), '') AS top_drivers,
    count(x) AS n_usable, coalesce({S('sum(x)', 6)}, 0) AS contribution_sum
    FROM decision_feat d LEFT JOIN k USING (ticker, decision_date) GROUP BY 1, 2""",
    "decision_feat",
)
def contributions(spark, sf):
    df = FE.decision_features(V.bars_table(spark, sf))
    # Rounded inputs make near-equal contributions order the same everywhere.
    df = df.select("ticker", "decision_date", *[(settled(F.col(c) * w, 8) / w).alias(c) for c, w in _BAL.items()])
    out = FE.contributions(df, _BAL)
    return out.select(
        "ticker", "decision_date", F.array_join(F.transform("top", lambda t: t["indicator"]), ",").alias("top_drivers"),
        F.col("n_usable").cast("long").alias("n_usable"), settled("contribution_sum", 6).alias("contribution_sum"),
    )


# ---- labels ----------------------------------------------------------------

FW = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
fragment(
    "labels0",
    f"""SELECT ticker, date, count(*) OVER {FW} AS nf, count(r) OVER {FW} AS ni, count(br) OVER {FW} AS nb,
  sum(ln(1 + r)) OVER {FW} AS ilr, sum(ln(1 + br)) OVER {FW} AS blr
  FROM (SELECT b.*, m.r AS br FROM bars b LEFT JOIN (SELECT date, r FROM bars WHERE ticker = 'MKT') m USING (date))""",
    "bars",
)
fragment(
    "labels",
    """SELECT ticker, date AS decision_date, status, CASE WHEN status = 'OK' THEN excess END AS excess,
  CASE WHEN status = 'OK' THEN CAST(excess > 0 AS BIGINT) END AS y, status = 'OK' AS usable FROM
  (SELECT *, CASE WHEN nf < 5 THEN 'INSUFFICIENT_FORWARD_BARS' WHEN ni < 5 THEN 'RETURN_GAP_UNRESOLVED'
    WHEN ticker <> 'MKT' AND nb < 5 THEN 'RETURN_GAP_UNRESOLVED' ELSE 'OK' END AS status,
    CASE WHEN ticker = 'MKT' THEN ilr ELSE ilr - blr END AS excess FROM labels0)""",
    "labels0",
)


@query(
    "build_labels",
    f"""SELECT ticker, decision_date, {ET('decision_date', 945)} AS decision_time_utc, y,
    {S('excess', 9)} AS excess_log_return, status, usable FROM labels""",
    "labels",
)
def build_labels(spark, sf):
    df = L.build_labels(V.bars_table(spark, sf), V.BENCHMARK)
    return df.withColumn("excess_log_return", settled("excess_log_return", 9)).withColumn("y", F.col("y").cast("long"))


@query(
    "excess_return_pct",
    f"""SELECT ticker, decision_date, {S('exp(excess) - 1', 8)} AS excess_return_pct, status FROM labels""",
    "labels",
)
def excess_return_pct(spark, sf):
    df = L.with_excess_return(L.build_labels(V.bars_table(spark, sf), V.BENCHMARK))
    return df.select("ticker", "decision_date", settled("excess_return_pct", 8).alias("excess_return_pct"), "status")


@query(
    "label_coverage",
    f"""WITH b AS (SELECT ticker, count(*) AS bars, min(date) AS first_date, max(date) AS last_date,
      arg_max(close, date) FILTER (WHERE close IS NOT NULL) AS last_close, count(r) AS usable_returns,
      count(*) - count(r) AS gap_rows FROM bars GROUP BY 1),
    l AS (SELECT ticker, count(*) AS labels_total, count(*) FILTER (WHERE usable) AS labels_usable,
      count(*) FILTER (WHERE y = 1) AS ones FROM labels GROUP BY 1)
    SELECT b.*, labels_total, labels_usable, labels_total - labels_usable AS labels_unresolved,
    {S('ones / nullif(labels_usable, 0)::DOUBLE', 8)} AS base_rate_y1 FROM b JOIN l USING (ticker)""",
    "bars labels",
)
def label_coverage(spark, sf):
    b = V.bars_table(spark, sf)
    return L.label_coverage(b, L.build_labels(b, V.BENCHMARK)).withColumn("base_rate_y1", settled("base_rate_y1", 8))


@query(
    "forward_return_chain",
    f"""SELECT ticker, date, {S('coalesce(r, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1)', 9)} AS forward_return
    FROM bars WHERE close IS NOT NULL""",
    "bars",
)
def forward_return_chain(spark, sf):
    return L.forward_returns(V.bars(spark, sf)).select("ticker", "date", settled("forward_return", 9).alias("forward_return"))


@query(
    "missing_benchmark",
    """SELECT ticker, count(*) AS labels FROM labels WHERE ticker = 'NONE' OR
    (SELECT count(r) FROM bars WHERE ticker = 'NONE') > 0 GROUP BY 1
    UNION ALL SELECT 'with_benchmark', count(*) FROM labels WHERE (SELECT count(r) FROM bars WHERE ticker = 'MKT') > 0""",
    "bars labels",
)
def missing_benchmark(spark, sf):
    b = V.bars_table(spark, sf)
    labels = L.build_labels(b, V.BENCHMARK)
    none = L.usable_against(b, labels, "NONE").groupBy("ticker").agg(F.count("*").alias("labels"))
    some = L.usable_against(b, labels, V.BENCHMARK).agg(F.count("*").alias("labels"))
    return none.unionByName(some.select(F.lit("with_benchmark").alias("ticker"), "labels"))


# Delisting: brands whose last bar is old stop trading; the exit return is key-derived for some.
fragment(
    "delist",
    """SELECT ticker, date AS decision_date, nf,
  list_slice(list(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 2, 6) AS inst,
  list_slice(list(br) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 2, 6) AS bench,
  nf < 5 AND ticker <> 'MKT' AS delisted,
  CASE WHEN ticker <= 'Brand#2' THEN -0.30::DOUBLE END AS dlret, volume % 41 <> 0 AS resolved FROM
  (SELECT b.*, m.r AS br, count(*) OVER (PARTITION BY b.ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nf
   FROM bars b LEFT JOIN (SELECT date, r FROM bars WHERE ticker = 'MKT') m USING (date))""",
    "bars",
)


@query(
    "delisting_labels",
    f"""WITH i AS (SELECT *, delisted AND dlret IS NULL AS imputed,
      CASE WHEN delisted AND dlret IS NULL THEN list_append(inst, -1.0::DOUBLE)
           WHEN delisted AND len(inst) = 0 THEN [dlret]
           WHEN delisted THEN list_append(list_slice(inst, 1, len(inst) - 1), (inst[len(inst)] + 1.0) * (dlret + 1.0) - 1.0)
           ELSE inst END AS a FROM delist),
    j AS (SELECT *, list_slice(bench, 1, greatest(len(a), 1)) AS bs FROM i),
    k AS (SELECT *, CASE WHEN list_contains(list_transform(a, lambda x: x IS NULL), TRUE) AND NOT
            coalesce(list_position(list_transform(a, lambda x: coalesce(x <= -1.0, FALSE)), TRUE) < list_position(list_transform(a, lambda x: x IS NULL), TRUE), FALSE) THEN NULL
          WHEN list_contains(list_transform(a, lambda x: coalesce(x <= -1.0, FALSE)), TRUE) THEN '-inf'::DOUBLE
          ELSE coalesce(list_sum(list_transform(a, lambda x: ln(1 + x))), 0) END AS ilr,
        CASE WHEN list_contains(list_transform(bs, lambda x: x IS NULL), TRUE) THEN NULL
          ELSE coalesce(list_sum(list_transform(bs, lambda x: ln(1 + x))), 0) END AS blr FROM j),
    s AS (SELECT *, CASE WHEN NOT resolved THEN 'CORPORATE_ACTION_UNRESOLVED'
      WHEN NOT delisted AND len(a) < 5 THEN 'INSUFFICIENT_FORWARD_BARS'
      WHEN len(bench) < least(len(a), 5) THEN 'INSUFFICIENT_FORWARD_BARS'
      WHEN ilr IS NULL THEN 'RETURN_GAP_UNRESOLVED' WHEN ticker <> 'MKT' AND blr IS NULL THEN 'RETURN_GAP_UNRESOLVED'
      ELSE 'OK' END AS status, CASE WHEN ticker = 'MKT' THEN ilr ELSE ilr - blr END AS e FROM k)
    SELECT ticker, decision_date, status, CASE WHEN status = 'OK' THEN CAST(e > 0 AS BIGINT) END AS y,
    CASE WHEN status = 'OK' THEN CASE WHEN isinf(e) THEN -999.0::DOUBLE ELSE {S('e', 9)} END END AS excess_log_return,
    status = 'OK' AND imputed AS imputed, status = 'OK' AND NOT imputed AS usable FROM s""",
    "delist",
)
def delisting_labels(spark, sf):
    b = L.with_benchmark(V.bars_table(spark, sf), V.BENCHMARK)
    w = B.by_ticker().rowsBetween(1, L.HORIZON)
    # Forward windows of five rows: the arrays are bounded by the horizon.
    pairs = F.collect_list(F.struct("daily_total_return", "bench_return")).over(w)
    delisted = (F.size("p") < L.HORIZON) & (F.col("ticker") != V.BENCHMARK)
    inputs = b.withColumn("p", pairs).select(
        "ticker", F.col("date").alias("decision_date"),
        F.transform("p", lambda x: x["daily_total_return"]).alias("fwd_returns"),
        F.transform("p", lambda x: x["bench_return"]).alias("bench_returns"),
        (F.col("volume") % 41 != 0).alias("corporate_action_resolved"), delisted.alias("delisted"),
        F.when(F.col("ticker") <= "Brand#2", F.lit(-0.30)).alias("delisting_return"),
    )
    out = L.labels_from_arrays(inputs, V.BENCHMARK)
    shown = F.when(F.abs("excess_log_return") == float("inf"), F.lit(-999.0)).otherwise(settled("excess_log_return", 9))
    return out.select(
        "ticker", "decision_date", "status", F.col("y").cast("long").alias("y"), shown.alias("excess_log_return"),
        F.col("delisting_return_imputed").alias("imputed"), "usable",
    )


# ---- calendar and splits ---------------------------------------------------

fragment("cal", "SELECT date AS session_date, row_number() OVER (ORDER BY date) - 1 AS session_idx FROM (SELECT DISTINCT date FROM bars)", "bars")
fragment(
    "splits",
    """SELECT f.fold, a.session_date AS train_start, b.session_date AS train_end, c.session_date AS test_start, d.session_date AS test_end
  FROM (SELECT unnest(generate_series(0, ((SELECT count(*) FROM cal) - 215) // 32)) AS fold) f
  JOIN cal a ON a.session_idx = f.fold * 32 JOIN cal b ON b.session_idx = f.fold * 32 + 179
  JOIN cal c ON c.session_idx = f.fold * 32 + 185 JOIN cal d ON d.session_idx = f.fold * 32 + 214
  WHERE (SELECT count(*) FROM cal) >= 215""",
    "cal",
)


@query("trading_calendar", "SELECT * FROM cal", "cal")
def trading_calendar(spark, sf):
    return V.calendar(spark, sf)


@query(
    "session_index",
    """SELECT CAST(o_orderdate AS DATE) AS order_date, count(*) AS orders, any_value(session_idx) AS session_idx,
    any_value(session_idx) IS NULL AS not_a_session FROM orders LEFT JOIN cal ON CAST(o_orderdate AS DATE) = session_date GROUP BY 1""",
    "cal",
)
def session_index(spark, sf):
    days = V.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("order_date")).agg(F.count("*").alias("orders"))
    return C.session_index(days, V.calendar(spark, sf), "order_date")


@query("make_splits", "SELECT CAST(fold AS BIGINT) AS fold, train_start, train_end, test_start, test_end FROM splits", "splits")
def make_splits(spark, sf):
    return C.make_splits(V.calendar(spark, sf)).withColumn("fold", F.col("fold").cast("long"))


@query(
    "sessions_between",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS opened, CAST(o_orderdate AS DATE) + CAST(o_custkey % 20 - 4 AS INTEGER) AS closed,
    (SELECT count(*) FROM cal WHERE session_date < CAST(o_orderdate AS DATE) + CAST(o_custkey % 20 - 4 AS INTEGER)) - (SELECT count(*) FROM cal WHERE session_date <= CAST(o_orderdate AS DATE)) AS gap_sessions,
    CAST(o_orderdate AS DATE) >= (SELECT min(session_date) FROM cal) AND CAST(o_orderdate AS DATE) + CAST(o_custkey % 20 - 4 AS INTEGER) <= (SELECT max(session_date) FROM cal) AS in_calendar
    FROM orders""",
    "cal",
)
def sessions_between(spark, sf):
    cal = V.calendar(spark, sf)
    o = V.table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("opened"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 20 - 4).cast("int")).alias("closed"),
    )
    return C.spans(C.sessions_between(o, cal, "opened", "closed"), cal, "opened", "closed")


@query(
    "validate_splits",
    """WITH bent AS (SELECT fold, train_end + CAST(fold % 5 * 4 AS INTEGER) AS train_end, test_start - CAST(fold % 3 * 3 AS INTEGER) AS test_start,
      CASE WHEN fold % 11 = 0 THEN test_start - 30 ELSE test_end END AS test_end FROM splits)
    SELECT CAST(fold AS BIGINT) AS fold, train_end, test_start, test_end, gap_sessions,
    CASE WHEN train_end >= test_start THEN 'OVERLAP' WHEN test_end <= test_start THEN 'EMPTY_TEST'
      WHEN train_end < (SELECT min(session_date) FROM cal) OR test_start > (SELECT max(session_date) FROM cal) THEN 'OUTSIDE_CALENDAR'
      WHEN gap_sessions < 5 THEN 'PURGE_TOO_SHORT' ELSE 'OK' END AS verdict FROM
    (SELECT *, (SELECT count(*) FROM cal WHERE session_date < test_start) - (SELECT count(*) FROM cal WHERE session_date <= train_end) AS gap_sessions FROM bent)""",
    "splits",
)
def validate_splits(spark, sf):
    cal = V.calendar(spark, sf)
    s = C.make_splits(cal)
    bent = s.select(
        F.col("fold").cast("long").alias("fold"), F.date_add("train_end", F.col("fold") % 5 * 4).alias("train_end"),
        F.date_sub("test_start", F.col("fold") % 3 * 3).alias("test_start"),
        F.when(F.col("fold") % 11 == 0, F.date_sub("test_start", 30)).otherwise(F.col("test_end")).alias("test_end"),
    )
    return C.validate_splits(bent, cal)


fragment(
    "obs",
    f"""SELECT l.ticker, l.decision_date, l.y, {S('excess', 8)} AS x, {', '.join(f'{S(c, 6)} AS {c}' for c in FE.COMPONENTS)}
  FROM labels l JOIN decision_feat USING (ticker, decision_date)
  WHERE usable AND l.ticker <> 'MKT' AND {' AND '.join(f'{c} IS NOT NULL' for c in FE.COMPONENTS)}""",
    "labels decision_feat",
)
fragment(
    "tagged",
    """SELECT fold, 'train' AS role, o.* FROM obs o JOIN splits ON decision_date BETWEEN train_start AND train_end
  UNION ALL SELECT fold, 'test', o.* FROM obs o JOIN splits ON decision_date BETWEEN test_start AND test_end""",
    "obs splits",
)
fragment(
    "folded",
    """SELECT * FROM tagged WHERE fold IN (SELECT fold FROM tagged GROUP BY 1
  HAVING count(*) FILTER (WHERE role = 'train') > 0 AND count(*) FILTER (WHERE role = 'test') > 0)""",
    "tagged",
)


@query(
    "build_observations",
    f"SELECT ticker, decision_date, y, x AS excess_log_return, {', '.join(FE.COMPONENTS)} FROM obs",
    "obs",
)
def build_observations(spark, sf):
    return V.observations(V.bars_table(spark, sf)).withColumn("y", F.col("y").cast("long"))


@query(
    "assign_folds",
    """SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS rows, CAST(sum(y) AS BIGINT) AS ones, min(decision_date) AS first_date,
    max(decision_date) AS last_date, count(DISTINCT decision_date) AS dates FROM folded GROUP BY 1, 2""",
    "folded",
)
def assign_folds(spark, sf):
    obs, cal, splits = V.study_inputs(spark, sf)
    tagged = C.assign_folds(obs, cal, splits)
    # Counting a fold's dates after (fold, role, date) pre-aggregation keeps the shuffle small.
    daily = tagged.groupBy("fold", "role", "decision_date").agg(F.count("*").alias("rows"), F.sum("y").alias("ones"))
    return daily.groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(
        F.sum("rows").alias("rows"), F.sum("ones").alias("ones"), F.min("decision_date").alias("first_date"),
        F.max("decision_date").alias("last_date"), F.count("*").alias("dates"),
    )


@query(
    "fold_chronology",
    """SELECT CAST(fold AS BIGINT) AS fold, last_train, first_test, gap_sessions,
    CASE WHEN last_train >= first_test THEN 'NOT_CHRONOLOGICAL' WHEN gap_sessions < 5 THEN 'PURGE_TOO_SHORT' ELSE 'OK' END AS verdict FROM
    (SELECT *, (SELECT count(*) FROM cal WHERE session_date > last_train AND session_date < first_test) AS gap_sessions FROM
     (SELECT fold, max(decision_date) FILTER (WHERE role = 'train') AS last_train, min(decision_date) FILTER (WHERE role = 'test') AS first_test FROM folded GROUP BY 1))""",
    "folded cal",
)
def fold_chronology(spark, sf):
    obs, cal, splits = V.study_inputs(spark, sf)
    tagged = C.assign_folds(obs, cal, splits)
    return C.fold_chronology(tagged, cal).withColumn("fold", F.col("fold").cast("long"))


@query(
    "assessment_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS decided,
    (SELECT d FROM (SELECT CAST(o_orderdate AS DATE) + CAST(i AS INTEGER) AS d FROM range(1, 18) t(i)) WHERE dayofweek(d) NOT IN (0, 6) ORDER BY d LIMIT 1 OFFSET 4) AS assessed FROM orders""",
)
def assessment_dates(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("decided"))
    return o.select("*", C.add_weekdays("decided", 5).alias("assessed"))


# ---- evaluation ------------------------------------------------------------

PERMS = 20
fragment(
    "slots",
    f"""SELECT *, CASE WHEN perm = 0 THEN old_start ELSE coalesce(sum(n) OVER (PARTITION BY perm, fold, role ORDER BY key, block, decision_date
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS new_start FROM
  (SELECT *, md5(concat_ws(':', 7, perm, fold, role, block)) AS key FROM
   (SELECT *, coalesce(sum(n) OVER (PARTITION BY fold, role ORDER BY decision_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old_start,
     (row_number() OVER (PARTITION BY fold, role ORDER BY decision_date) - 1) // 10 AS block FROM
    (SELECT fold, role, decision_date, count(*) AS n FROM folded GROUP BY 1, 2, 3)) CROSS JOIN (SELECT unnest(range(0, {PERMS + 1})) AS perm))""",
    "folded",
)
fragment("placed", "SELECT *, row_number() OVER (PARTITION BY fold, role, decision_date ORDER BY ticker) - 1 AS idx FROM folded", "folded")
fragment(
    "permuted",
    """SELECT a.*, b.y_perm FROM
  (SELECT perm, old_start + idx AS pos, p.* FROM placed p JOIN slots USING (fold, role, decision_date)) a
  JOIN (SELECT perm, fold, role, new_start + idx AS pos, y AS y_perm FROM placed p JOIN slots USING (fold, role, decision_date)) b
  USING (perm, fold, role, pos)""",
    "placed slots",
)
STUDY_VARIANTS = FE.VARIANT_WEIGHTS
fragment(
    "scored",
    " UNION ALL ".join(f"SELECT '{v}' AS variant, perm, fold, role, y_perm, {S(score_sql(w), 9)} AS score FROM permuted" for v, w in STUDY_VARIANTS.items()),
    "permuted",
)
fragment(
    "cuts",
    """SELECT variant, perm, fold, min(score) AS lowest, any_value(ones) AS ones, max(correct) AS best, arg_min(score, (-correct, score)) AS cut FROM
  (SELECT *, sum(n0) OVER w + sum(n1) OVER (PARTITION BY variant, perm, fold) - sum(n1) OVER w AS correct, sum(n1) OVER (PARTITION BY variant, perm, fold) AS ones FROM
   (SELECT variant, perm, fold, score, count(*) FILTER (WHERE y_perm = 0) AS n0, count(*) FILTER (WHERE y_perm = 1) AS n1
    FROM scored WHERE role = 'train' GROUP BY 1, 2, 3, 4)
   WINDOW w AS (PARTITION BY variant, perm, fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1, 2, 3""",
    "scored",
)
fragment(
    "fold_res",
    """SELECT s.variant, s.perm, s.fold, count(*) AS n, count(*) FILTER (WHERE y_perm = 1) AS ones,
  count(*) FILTER (WHERE y_perm = CAST(CASE WHEN ones >= best THEN score >= lowest ELSE score > cut END AS BIGINT)) AS correct
  FROM scored s JOIN cuts USING (variant, perm, fold) WHERE role = 'test' GROUP BY 1, 2, 3""",
    "scored cuts",
)


def _study(spark, sf, variants=STUDY_VARIANTS, permutations=PERMS):
    return E.fold_results(*V.study_inputs(spark, sf), variants, permutations)


@query(
    "grouped_block_permutation",
    """SELECT perm, CAST(fold AS BIGINT) AS fold, role, decision_date, count(*) AS rows, CAST(sum(y_perm) AS BIGINT) AS ones, string_agg(CAST(y_perm AS VARCHAR), '' ORDER BY ticker) AS labels FROM permuted GROUP BY 1, 2, 3, 4""",
    "permuted",
)
def grouped_block_permutation(spark, sf):
    """Each date's labels under every permutation, in order of ticker."""
    obs, cal, splits = V.study_inputs(spark, sf)
    rows = E.permute_labels(C.assign_folds(obs, cal, splits), PERMS)
    dated = rows.groupBy(F.col("perm").cast("long").alias("perm"), F.col("fold").cast("long").alias("fold"), "role", "decision_date")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ticker", "y_perm"))), lambda r: r["y_perm"].cast("string")), "")
    return dated.agg(F.count("*").alias("rows"), F.sum("y_perm").cast("long").alias("ones"), letters.alias("labels"))


@query(
    "label_matrix",
    """SELECT CAST(fold AS BIGINT) AS fold, role, decision_date, string_agg(labels, ',' ORDER BY ticker) AS labels FROM
    (SELECT fold, role, decision_date, ticker, string_agg(CAST(y_perm AS VARCHAR), '' ORDER BY perm) AS labels FROM permuted GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
    "permuted",
)
def label_matrix(spark, sf):
    """The packed labels of each date's rows, read back bit by bit."""
    obs, cal, splits = V.study_inputs(spark, sf)
    packed = E.label_matrix(C.assign_folds(obs, cal, splits).select("fold", "role", "decision_date", "ticker", "y"), PERMS)
    width = PERMS // 8 + 1
    bit = f"cast(shiftright(cast(conv(hex(substring(bits, r * {width} + p div 8 + 1, 1)), 16, 10) as int), p % 8) & 1 as string)"
    letters = F.expr(f"array_join(transform(sequence(0, length(bits) div {width} - 1), r -> array_join(transform(sequence(0, {PERMS}), p -> {bit}), '')), ',')")
    return packed.select(F.col("fold").cast("long").alias("fold"), "role", "decision_date", letters.alias("labels"))


@query(
    "best_threshold",
    """SELECT variant, CAST(fold AS BIGINT) AS fold, CASE WHEN ones >= best THEN lowest ELSE cut END AS threshold, ones >= best AS inclusive,
    CAST(greatest(ones, best) AS BIGINT) AS train_correct FROM cuts WHERE perm = 0""",
    "cuts",
)
def best_threshold(spark, sf):
    obs, cal, splits = V.study_inputs(spark, sf)
    tagged = C.assign_folds(obs, cal, splits)
    scored = E.score_variants(tagged.filter(F.col("role") == "train"), STUDY_VARIANTS, ["fold", "y"])
    return E.best_thresholds(scored, ["variant", "fold"], label="y").withColumn("fold", F.col("fold").cast("long"))


@query(
    "walk_forward_folds",
    "SELECT variant, CAST(perm AS BIGINT) AS perm, CAST(fold AS BIGINT) AS fold, n, correct, ones FROM fold_res",
    "fold_res",
)
def walk_forward_folds(spark, sf):
    return _study(spark, sf).select(
        "variant", F.col("perm").cast("long").alias("perm"), F.col("fold").cast("long").alias("fold"), "n", "correct", "ones"
    )


REPORT_SQL = f"""WITH runs AS (SELECT variant, perm, sum(n)::DOUBLE AS n, sum(correct)::DOUBLE AS c, sum(ones)::DOUBLE AS o, count(*) AS folds,
      max(correct / n::DOUBLE) - min(correct / n::DOUBLE) AS spread FROM fold_res GROUP BY 1, 2),
    rl AS (SELECT *, c / n AS acc, greatest(o, n - o) / n AS maj FROM runs WHERE perm = 0),
    st AS (SELECT r.variant, avg(r.c / r.n) AS m, stddev_pop(r.c / r.n) AS sd, (count(*) FILTER (WHERE r.c / r.n >= acc) + 1) / (count(*) + 1)::DOUBLE AS p,
      count(*) AS k FROM runs r JOIN rl USING (variant) WHERE r.perm > 0 GROUP BY 1),
    z AS (SELECT *, CASE WHEN sd < 1e-12 THEN 0 ELSE (acc - m) / sd END AS z FROM rl JOIN st USING (variant))
    SELECT variant, CAST(n AS BIGINT) AS observations, folds, {S('acc', 8)} AS accuracy, {S('maj', 8)} AS majority_rate, {S('spread', 8)} AS fold_accuracy_spread,
    {S('m', 8)} AS permutation_mean, {S('sd', 7)} AS permutation_std, {S('p', 8)} AS p_value, k AS permutations, {S('z', 5)} AS z_vs_noise,
    CASE WHEN acc <= maj THEN 'NO_EDGE_MAJORITY' WHEN p > 0.05 THEN 'NO_EDGE_CHANCE' WHEN z < 2 THEN 'INCONCLUSIVE' ELSE 'SIGNAL_CANDIDATE' END AS verdict FROM z"""


@query("walk_forward_report", REPORT_SQL, "fold_res")
def walk_forward_report(spark, sf):
    r = E.evaluation_report(_study(spark, sf))
    r = _rounded(r, 8, "accuracy", "majority_rate", "fold_accuracy_spread", "permutation_mean", "p_value")
    return _rounded(_rounded(r, 7, "permutation_std"), 5, "z_vs_noise")


fragment(
    "long_obs",
    " UNION ALL ".join(f"SELECT '{c}' AS component, ticker, decision_date, {c} AS v, x FROM obs" for c in FE.COMPONENTS),
    "obs",
)
SPEARMAN = """CASE WHEN count(*) >= 3 AND sum(rx * rx) - {c} > 0 AND sum(ry * ry) - {c} > 0
  THEN (sum(rx * ry) - {c}) / (sqrt(sum(rx * rx) - {c}) * sqrt(sum(ry * ry) - {c})) END""".format(c="count(*) * (count(*) + 1) * (count(*) + 1) / 4.0::DOUBLE")


def _rank_sql(part: str, value: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0::DOUBLE"


fragment(
    "daily_ic",
    f"""SELECT component, decision_date, count(*) AS n, {SPEARMAN} AS ic FROM
  (SELECT *, {_rank_sql('component, decision_date', 'v')} AS rx, {_rank_sql('component, decision_date', 'x')} AS ry FROM long_obs) GROUP BY 1, 2""",
    "long_obs",
)
fragment(
    "fold_ic",
    """SELECT component, fold, avg(ic) AS ic, count(ic) AS daily_readings, list_sort(list(n))[len(list(n)) // 2 + 1] AS width
  FROM daily_ic JOIN splits ON decision_date BETWEEN test_start AND test_end GROUP BY 1, 2 HAVING sum(n) >= 3 AND avg(ic) IS NOT NULL""",
    "daily_ic splits",
)


@query("daily_rank_ic", f"SELECT component, decision_date, n, {S('ic', 8)} AS ic FROM daily_ic", "daily_ic")
def daily_rank_ic(spark, sf):
    return _rounded(IC.daily_ic(V.observations(V.bars_table(spark, sf))), 8, "ic")


@query(
    "rank_ic_by_fold",
    f"SELECT component, CAST(fold AS BIGINT) AS fold, {S('ic', 8)} AS ic, daily_readings, width FROM fold_ic",
    "fold_ic",
)
def rank_ic_by_fold(spark, sf):
    df = IC.fold_ic(*V.study_inputs(spark, sf))
    return _rounded(df.drop("rows"), 8, "ic").withColumn("fold", F.col("fold").cast("long"))


SUMMARY_SQL = f"""SELECT component, folds, {{m}} AS mean_ic, {{s}} AS stdev_ic, {{h}} AS hit_rate, {{t}} AS t_stat,
    CAST(daily_readings AS BIGINT) AS daily_readings, median_universe, median_universe < 5 AS thin_universe FROM
    (SELECT component, count(*) AS folds, avg(ic) AS m, stddev_samp(ic) AS s, sum(daily_readings) AS daily_readings,
     list_sort(list(width))[len(list(width)) // 2 + 1] AS median_universe, count(*) FILTER (WHERE ic > 0) AS pos FROM fold_ic GROUP BY 1)""".format(
    m=S("m", 8), s=S("s", 8), h=S("CASE WHEN m > 0 THEN pos / folds::DOUBLE WHEN m < 0 THEN (folds - pos) / folds::DOUBLE END", 8),
    t=S("CASE WHEN s > 0 THEN m / (s / sqrt(folds)) END", 5),
)


@query("rank_ic_summary", SUMMARY_SQL, "fold_ic")
def rank_ic_summary(spark, sf):
    df = IC.ic_summary(IC.fold_ic(*V.study_inputs(spark, sf)))
    return _rounded(_rounded(df, 8, "mean_ic", "stdev_ic", "hit_rate"), 5, "t_stat")


WEIGHTS_SQL = ", ".join(f"('{v}', '{c}', {float(w)!r}::DOUBLE)" for v, own in STUDY_VARIANTS.items() for c, w in own.items())


@query(
    "study_result",
    f"""WITH report AS ({REPORT_SQL}), summary AS ({SUMMARY_SQL}), sides AS (SELECT count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test FROM folded),
    extent AS (SELECT count(*) AS study_rows, count(DISTINCT ticker) AS instruments, min(decision_date) AS first_decision, max(decision_date) AS last_decision, (SELECT count(*) FROM cal) AS sessions FROM obs)
    SELECT w.variant, w.component, w.weight, mean_ic, i.t_stat, i.folds AS ic_folds, thin_universe, r.folds, accuracy, majority_rate, p_value, z_vs_noise, permutations, study_rows, instruments, first_decision, last_decision, sessions, n_train, n_test,
    CASE WHEN n_train >= 20 AND n_test >= 20 THEN 'STUDY_REPORT' ELSE 'INSUFFICIENT_ELIGIBLE_DATA' END AS status, CASE WHEN n_train >= 20 AND n_test >= 20 THEN verdict END AS verdict
    FROM (VALUES {WEIGHTS_SQL}) w(variant, component, weight) LEFT JOIN summary i USING (component) LEFT JOIN report r USING (variant), extent, sides""",
    "fold_res fold_ic folded obs cal",
)
def study_result(spark, sf):
    """Every variant's verdict beside the rank IC of the components it weighs, from one set of observations."""
    obs, cal, splits = V.study_inputs(spark, sf)
    report = E.evaluation_report(E.fold_results(obs, cal, splits, STUDY_VARIANTS, PERMS))
    ic = IC.ic_summary(IC.fold_ic(obs, cal, splits))
    df = E.study_result(obs, splits, cal, report, ic, STUDY_VARIANTS)
    df = _rounded(_rounded(df, 8, "mean_ic", "accuracy", "majority_rate", "p_value"), 5, "t_stat", "z_vs_noise")
    return df.select(
        "variant", "component", "weight", "mean_ic", "t_stat", "ic_folds", "thin_universe", "folds", "accuracy", "majority_rate", "p_value", "z_vs_noise", "permutations", "study_rows", "instruments",
        "first_decision", "last_decision", "sessions", "n_train", "n_test", "status", "verdict",
    )


@query(
    "rank_ic_pooled",
    f"""SELECT * FROM (SELECT component, CAST(fold AS BIGINT) AS fold, count(*) AS n, {S(SPEARMAN, 8)} AS ic FROM
    (SELECT *, {_rank_sql('component, fold', 'v')} AS rx, {_rank_sql('component, fold', 'x')} AS ry FROM
     (SELECT fold, l.* FROM long_obs l JOIN splits ON decision_date BETWEEN test_start AND test_end)) GROUP BY 1, 2) WHERE ic IS NOT NULL""",
    "long_obs splits",
)
def rank_ic_pooled(spark, sf):
    df = IC.pooled_ic(*V.study_inputs(spark, sf))
    return _rounded(df, 8, "ic").withColumn("fold", F.col("fold").cast("long"))


@query(
    "tie_average_ranks",
    f"SELECT ticker, decision_date, {_rank_sql('decision_date', 'reversion')} AS avg_rank FROM obs",
    "obs",
)
def tie_average_ranks(spark, sf):
    return IC.tie_ranks(V.observations(V.bars_table(spark, sf)), ["decision_date"], "reversion", "avg_rank").select("ticker", "decision_date", "avg_rank")
