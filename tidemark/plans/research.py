"""Technical scores and research studies over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.guards import settled
from ..operators import research as RS
from ..operators import technical as TE
from ..sources import views as V
from .registry import S, fragment, query

P = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
fragment(
    "known",
    "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM bars WHERE close IS NOT NULL",
    "bars",
)
fragment(
    "ewm",
    """SELECT ticker, n, date, close AS e12, close AS e26, 0.0::DOUBLE AS sig FROM known WHERE n = 1 UNION ALL
  SELECT k.ticker, k.n, k.date, a, b, e.sig + (a - b - e.sig) * 0.2::DOUBLE FROM (SELECT k.*, e.sig, e.e12 + (k.close - e.e12) * 2 / 13.0::DOUBLE AS a, e.e26 + (k.close - e.e26) * 2 / 27.0::DOUBLE AS b
   FROM ewm e JOIN known k ON k.ticker = e.ticker AND k.n = e.n + 1) k JOIN ewm e ON e.ticker = k.ticker AND e.n = k.n - 1""".replace(" JOIN ewm e ON e.ticker = k.ticker AND e.n = k.n - 1", "").replace("e.sig + (a - b - e.sig)", "k.sig + (a - b - k.sig)"),
    "known",
)
fragment(
    "ind",
    f"""SELECT k.ticker, k.date, k.n, close, volume, e12 - e26 AS macd, sig AS signal, {', '.join(f'CASE WHEN k.n >= {w} THEN avg(close) OVER {P.format(w - 1)} END AS sma_{w}' for w in (20, 50, 200))},
  CASE WHEN k.n >= 20 THEN stddev_samp(close) OVER {P.format(19)} END AS bb_std, CASE WHEN k.n >= 20 THEN avg(volume) OVER {P.format(19)} END AS volume_sma,
  CASE WHEN k.n >= 21 THEN stddev_samp(close / pc - 1) OVER {P.format(19)} * sqrt(252) END AS volatility, CASE WHEN k.n >= 14 THEN avg(greatest(coalesce(close - pc, 0), 0)) OVER {P.format(13)} END AS g,
  CASE WHEN k.n >= 14 THEN avg(greatest(-coalesce(close - pc, 0), 0)) OVER {P.format(13)} END AS l, lag(close, 19) OVER (PARTITION BY k.ticker ORDER BY k.date) AS c19, lag(close, 49) OVER (PARTITION BY k.ticker ORDER BY k.date) AS c49
  FROM known k JOIN ewm USING (ticker, n)""".replace("PARTITION BY ticker ORDER BY date ROWS", "PARTITION BY k.ticker ORDER BY k.date ROWS"),
    "known ewm",
)
RSI = "CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0::DOUBLE END ELSE 100 - 100 / (1 + g / l) END"


@query(
    "technical_indicators",
    f"""SELECT ticker, date, {', '.join(f'{S(c, 6)} AS {c}' for c in ('sma_20', 'sma_50', 'sma_200', 'macd', 'signal', 'volatility'))}, {S(RSI, 6)} AS rsi, {S('sma_20 + 2 * bb_std', 6)} AS bb_upper,
    {S('sma_20 - 2 * bb_std', 6)} AS bb_lower, {S('volume / volume_sma', 6)} AS volume_ratio FROM ind""",
    "ind",
)
def technical_indicators(spark, sf):
    i = TE.indicators(V.bars(spark, sf))
    return i.select("ticker", "date", *[settled(c, 6).alias(c) for c in ("sma_20", "sma_50", "sma_200", "macd", "signal", "volatility", "rsi", "bb_upper", "bb_lower", "volume_ratio")])


SCORE_SQL = f"""SELECT ticker, date, n, CASE WHEN n < 50 THEN 50 ELSE greatest(0, least(100, 50 + CASE WHEN close > sma_50 AND sma_50 > sma_200 THEN 15 WHEN close < sma_50 AND sma_50 < sma_200 THEN -15 ELSE 0 END
    + CASE WHEN rsi < 30 THEN 10 WHEN rsi > 70 THEN -10 ELSE 0 END + CASE WHEN macd > signal THEN 10 ELSE -10 END)) END::DOUBLE AS technical,
    CASE WHEN n < 50 THEN 50 ELSE greatest(0, least(100, 50 + (close / c19 - 1) * 50 + (close / c49 - 1) * 25)) END::DOUBLE AS momentum, CASE WHEN n < 20 THEN 50 ELSE greatest(0, least(100, 50 - volatility * 100)) END::DOUBLE AS vs
    FROM (SELECT *, {RSI} AS rsi, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM ind) WHERE back = 1"""


@query(
    "unified_scores",
    f"SELECT ticker, date, technical, {S('momentum', 2)} AS momentum, {S('vs', 2)} AS volatility_score, {S('0.5::DOUBLE * technical + 0.35::DOUBLE * momentum + 0.15::DOUBLE * vs', 2)} AS overall FROM ({SCORE_SQL})",
    "ind",
)
def unified_scores(spark, sf):
    s = TE.scores(TE.indicators(V.bars(spark, sf)))
    return s.select("ticker", "date", "technical", *[settled(c, 2).alias(c) for c in ("momentum", "volatility_score", "overall")])


@query(
    "top_scores",
    f"SELECT ticker, {S('o', 2)} AS overall FROM (SELECT ticker, 0.5::DOUBLE * technical + 0.35::DOUBLE * momentum + 0.15::DOUBLE * vs AS o FROM ({SCORE_SQL})) ORDER BY o DESC, ticker LIMIT 3",
    "ind",
)
def top_scores(spark, sf):
    s = TE.scores(TE.indicators(V.bars(spark, sf)))
    return s.orderBy(F.desc("overall"), "ticker").limit(3).select("ticker", settled("overall", 2).alias("overall"))


@query(
    "raw_return_target",
    "SELECT ticker, date, CAST(lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 > 0.02::DOUBLE AS BIGINT) AS target FROM known",
    "known",
)
def raw_return_target(spark, sf):
    return TE.raw_return_target(V.bars(spark, sf)).withColumn("target", F.col("target").cast("long"))


@query("forest_signals")
def forest_signals(spark, sf):
    from ..session import materialize

    return TE.forest_signals(materialize(TE.indicators(V.bars(spark, sf)), "indicators"))


EDGES = {"train": ("1995-01-01", "1998-12-31"), "validation": ("1999-01-01", "2000-06-30"), "holdout": ("2000-07-01", "2001-12-31")}
FEATURES = ["momentum_20d", "trend_50d", "reversion"]
fragment(
    "rrows",
    """SELECT ticker || ':' || decision_date AS row_id, ticker, decision_date, day + INTERVAL 20 HOUR AS decision_utc, day + to_hours(CASE WHEN k % 41 = 0 THEN 30 ELSE 14 END) AS fa, day + to_days(CASE WHEN k % 53 = 0 THEN 0 ELSE 8 END) AS la,
  CASE WHEN k % 29 = 0 THEN 'SYNTHETIC_DEMO' ELSE 'OBSERVED_QUOTES' END AS provenance, CASE WHEN k % 67 <> 0 THEN x END AS net_return, momentum_20d, trend_50d, reversion FROM
  (SELECT *, CAST(decision_date AS TIMESTAMP) AS day, (decision_date - DATE '1995-01-01') * 31 + CAST(substr(ticker, 7, 3) AS INTEGER) AS k FROM obs)""",
    "obs",
)
fragment(
    "rjudged",
    """SELECT *, CASE WHEN fa > decision_utc OR la <= decision_utc OR la > TIMESTAMP '2001-12-31' THEN 'unavailable_or_invalid_time' WHEN provenance <> 'OBSERVED_QUOTES' THEN 'not_observed_quotes'
  WHEN net_return IS NULL THEN 'invalid_row' END AS reject_reason FROM rrows""",
    "rrows",
)
fragment(
    "segs",
    """SELECT *, CASE WHEN decision_date BETWEEN '1995-01-01' AND '1998-12-31' THEN CASE WHEN CAST(la AS DATE) >= '1999-01-01' THEN 'label_overlap_purged' ELSE 'train' END
  WHEN decision_date BETWEEN '1999-01-01' AND '2000-06-30' THEN CASE WHEN CAST(la AS DATE) >= '2000-07-01' THEN 'label_overlap_purged' ELSE 'validation' END
  WHEN decision_date BETWEEN '2000-07-01' AND '2001-12-31' THEN 'holdout' END AS role FROM rjudged WHERE reject_reason IS NULL""",
    "rjudged",
)


def _judged(spark, sf):
    return RS.eligibility(V.research_rows(spark, sf), FEATURES, F.lit("2001-12-31").cast("timestamp"))


def _segments(spark, sf):
    return RS.purged_segments(_judged(spark, sf).filter(F.col("reject_reason").isNull()), EDGES)


@query("research_eligibility", "SELECT coalesce(reject_reason, 'eligible') AS reason, count(*) AS rows FROM rjudged GROUP BY 1", "rjudged")
def research_eligibility(spark, sf):
    return _judged(spark, sf).groupBy(F.coalesce("reject_reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("rows"))


@query("purged_segments", "SELECT coalesce(role, 'none') AS role, count(*) AS rows, min(decision_date) AS first_day, max(decision_date) AS last_day FROM segs GROUP BY 1", "segs")
def purged_segments(spark, sf):
    day = F.to_date("decision_utc")
    return _segments(spark, sf).groupBy(F.coalesce("role", F.lit("none")).alias("role")).agg(F.count("*").alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query(
    "weighted_standardize",
    f"""WITH w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY decision_date, ticker) AS w0 FROM segs WHERE role = 'train'), v AS (SELECT *, w0 / sum(w0) OVER () AS w FROM w),
    m AS (SELECT {', '.join(f'sum(w * {f}) AS m_{f}, sqrt(sum(w * {f} * {f}) - sum(w * {f}) * sum(w * {f})) AS s_{f}' for f in FEATURES)} FROM v)
    SELECT row_id, {', '.join(f'{S(f"greatest(-10, least(10, ({f} - m_{f}) / greatest(1e-6, s_{f})))", 6)} AS {f}' for f in FEATURES)} FROM v, m""",
    "segs",
)
def weighted_standardize(spark, sf):
    from ..session import materialize

    train = materialize(_segments(spark, sf).filter(F.col("role") == "train"), "train").withColumn("day", F.to_date("decision_utc"))
    w = RS.inverse_group_weights(train, ["day", "ticker"])
    return RS.standardize(w, RS.weighted_moments(w, FEATURES, []), FEATURES).select("row_id", *[settled(f, 6).alias(f) for f in FEATURES])


HOLD = f"""SELECT decision_date AS day, avg(CASE WHEN pr >= 0.5 THEN net_return ELSE 0 END) AS dr, avg((pr - y) * (pr - y)) AS br, avg(-ln(greatest(1e-12, CASE WHEN y = 1 THEN pr ELSE 1 - pr END))) AS ll, count(*) AS n, count(*) FILTER (WHERE pr >= 0.5) AS en, avg(net_return) AS base FROM
    (SELECT *, 1 / (1 + exp(trend_50d - reversion)) AS pr, CAST(net_return > 0 AS DOUBLE) AS y FROM segs WHERE role = 'holdout') GROUP BY 1"""


def _days(spark, sf):
    h = _segments(spark, sf).filter(F.col("role") == "holdout").withColumn("p", F.lit(1.0) / (F.exp(F.col("trend_50d") - F.col("reversion")) + 1.0))
    return h


@query(
    "holdout_metrics",
    f"""WITH d AS ({HOLD}), c AS (SELECT *, sum(dr) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS cum FROM d), k AS (SELECT *, greatest(0, max(cum) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS peak FROM c)
    SELECT count(*) AS observations, CAST(sum(n) AS BIGINT) AS rows, {S('avg(dr)', 7)} AS net_expectancy, {S('least(0, min(cum - peak))', 7)} AS max_drawdown, {S('avg(br)', 7)} AS brier, {S('avg(ll)', 7)} AS log_loss, {S('sum(en) / sum(n)', 7)} AS trade_rate FROM k""",
    "segs",
)
def holdout_metrics(spark, sf):
    m = RS.holdout_metrics(RS.holdout_days(_days(spark, sf), "p", F.col("p") >= 0.5))
    return m.select("observations", "rows", *[settled(c, 7).alias(c) for c in ("net_expectancy", "max_drawdown", "brier", "log_loss", "trade_rate")])


@query(
    "bootstrap_lower",
    f"""WITH d AS ({HOLD}), s AS (SELECT row_number() OVER (ORDER BY day) - 1 AS pos, dr - base AS v FROM d), c AS (SELECT count(*) AS n FROM s),
    g AS (SELECT sample, (CAST('0x' || substr(md5(concat_ws(':', 61, sample, pos // 5)), 1, 12) AS BIGINT) % n + pos % 5) % n AS pos FROM s, c, (SELECT unnest(range(500)) AS sample)),
    m AS (SELECT sample, avg(v) AS m FROM g JOIN s USING (pos) GROUP BY 1) SELECT {S('m', 8)} AS lower FROM (SELECT m, row_number() OVER (ORDER BY m) AS k FROM m) WHERE k = 13""",
    "segs",
)
def bootstrap_lower(spark, sf):
    from ..session import materialize

    h = _days(spark, sf)
    d = RS.holdout_days(h, "p", F.col("p") >= 0.5).join(h.groupBy(F.to_date("decision_utc").alias("day")).agg(F.avg("net_return").alias("base")), "day")
    d = materialize(d.select("day", (F.col("day_return") - F.col("base")).alias("diff")), "differences")
    return RS.bootstrap_lower(d, "diff").select(settled("lower", 8).alias("lower"))


@query("logistic_challenger")
def logistic_challenger(spark, sf):
    from ..session import materialize

    seg = materialize(_segments(spark, sf), "segments").withColumn("day", F.to_date("decision_utc"))
    w = {r: RS.inverse_group_weights(seg.filter(F.col("role") == r), ["day", "ticker"]) for r in EDGES}
    moments = RS.weighted_moments(w["train"], FEATURES, [])
    z = {r: RS.standardize(d, moments, FEATURES) for r, d in w.items()}
    scored = RS.logistic_challenger(z["train"], z["validation"], z["holdout"], FEATURES)
    return RS.holdout_metrics(RS.holdout_days(scored, "probability", F.col("probability") >= 0.5))


EXP = """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name, d AS train_start, d + 100 AS train_end, d + 101 + CASE WHEN c_custkey % 7 = 0 THEN -5 ELSE 0 END AS validation_start, d + 150 AS validation_end, d + 160 AS holdout_start,
    d + 200 AS holdout_end, CASE c_custkey % 4 WHEN 0 THEN ['delta', 'dte'] WHEN 1 THEN ['delta', 'delta'] WHEN 2 THEN ['net_return'] ELSE ['reversion'] END AS features FROM (SELECT *, DATE '2000-01-01' + CAST(c_custkey % 300 AS INTEGER) AS d FROM customer)"""


@query(
    "experiment_checks",
    f"""SELECT id, CASE WHEN NOT (train_start <= train_end AND train_end < validation_start AND validation_start <= validation_end AND validation_end < holdout_start AND holdout_start <= holdout_end) THEN 'dates_not_chronological'
    WHEN name = '' THEN 'identity_missing' WHEN features = ['delta', 'delta'] OR features = ['net_return'] THEN 'features_not_allowed' END AS problem FROM ({EXP})""",
)
def experiment_checks(spark, sf):
    i = F.col("c_custkey")
    d = F.date_add(F.lit("2000-01-01").cast("date"), (i % 300).cast("int"))
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    e = V.table(spark, sf, "customer").select(
        i.alias("id"), F.when(i % 11 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit("h").alias("hypothesis"), F.lit("v").alias("signal_version"), d.alias("train_start"), F.date_add(d, 100).alias("train_end"),
        F.date_add(d, F.when(i % 7 == 0, 96).otherwise(101)).alias("validation_start"), F.date_add(d, 150).alias("validation_end"), F.date_add(d, 160).alias("holdout_start"), F.date_add(d, 200).alias("holdout_end"),
        F.when(i % 4 == 0, lits("delta", "dte")).when(i % 4 == 1, lits("delta", "delta")).when(i % 4 == 2, lits("net_return")).otherwise(lits("reversion")).alias("features"),
    )
    return e.select("id", RS.experiment_problem().alias("problem"))


@query(
    "promotion_blockers",
    """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 90 < 50 THEN 'insufficient_fresh_holdout_dates' END, CASE WHEN ok AND ce <= be THEN 'expectancy_not_improved' END, CASE WHEN ok AND cd < bd THEN 'drawdown_worse' END,
    CASE WHEN ok AND c_custkey % 3 = 0 THEN 'fresh_forward_holdout_not_verified' END, CASE WHEN ok AND c_custkey % 13 = 0 THEN 'different_or_unknown_cohort' END, CASE WHEN ok AND ce - be <= 0 THEN 'uncertainty_interval_includes_no_improvement' END,
    CASE WHEN NOT ok THEN 'invalid_or_missing_metrics' END) AS blockers FROM (SELECT *, cd <= 0 AND bd <= 0 AS ok FROM (SELECT c_custkey, c_acctbal / 1e5 AS ce, (c_custkey % 100) / 1e3 AS be, (c_custkey % 21 - 20) / 100.0::DOUBLE AS cd, (c_custkey % 17 - 15) / 100.0::DOUBLE AS bd FROM customer))""",
)
def promotion_blockers(spark, sf):
    i = F.col("c_custkey")
    e = V.table(spark, sf, "customer").select(
        "c_custkey", (i % 90).alias("challenger_observations"), (F.col("c_acctbal") / 1e5).alias("challenger_net_expectancy"), (i % 100 / 1e3).alias("baseline_net_expectancy"), ((i % 21 - 20) / 100.0).alias("challenger_max_drawdown"),
        ((i % 17 - 15) / 100.0).alias("baseline_max_drawdown"), (i % 3 != 0).alias("fresh_holdout"), F.when(i % 13 == 0, "b").otherwise("a").alias("challenger_cohort"), F.lit("a").alias("baseline_cohort"),
    ).withColumn("lower_improvement", F.col("challenger_net_expectancy") - F.col("baseline_net_expectancy"))
    return e.select("c_custkey", F.array_join(RS.promotion_blockers(), ",").alias("blockers"))
