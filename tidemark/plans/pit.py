"""Point-in-time reads, lineage and as-of joins over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..functions.guards import rounded  # noqa: F401
from ..operators import asof as A
from ..operators import pit as P
from ..sources import views as V
from .registry import ET, R, fragment, query

fragment(
    "evidence",
    """SELECT 'D' || doc_id AS record_id, source AS ticker_at_time, event_time, published_time, available_time, available_time + INTERVAL 1 MINUTE AS ingested_time,
  CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'unknown-' || doc_id ELSE md5(text) END AS lineage_cluster_id,
  CASE WHEN doc_id % 100 = 99 THEN 'X1' WHEN doc_id % 6 = 1 THEN 'D' || (doc_id - 1) WHEN doc_id % 12 = 2 THEN 'D' || (doc_id - 2) END AS supersedes_record_id,
  CASE WHEN doc_id % 13 = 0 THEN 'QUARANTINED' ELSE 'VALID' END AS validation_status, CAST(n_chars AS DOUBLE) AS numeric_value FROM
  (SELECT *, published_time + to_minutes(CASE WHEN doc_id % 60 = 59 THEN -1 ELSE doc_id % 11 END) AS available_time FROM
   (SELECT *, event_time + to_minutes(CASE WHEN doc_id % 50 = 49 THEN -5 ELSE doc_id % 7 END) AS published_time FROM
    (SELECT *, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 43200) AS event_time FROM documents)))""",
)
fragment(
    "hidden",
    """SELECT e.*, h.hidden_from FROM evidence e LEFT JOIN (SELECT supersedes_record_id AS record_id, min(available_time) AS hidden_from
  FROM evidence WHERE supersedes_record_id IS NOT NULL GROUP BY 1) h USING (record_id)""",
    "evidence",
)
DECISION = "2024-01-20 20:45:00"
fragment(
    "visible_many",
    """SELECT h.*, decision_time FROM hidden h JOIN (SELECT DISTINCT source AS ticker_at_time, unnest([TIMESTAMP '2024-01-05 20:45:00', TIMESTAMP '2024-01-12 20:45:00',
  TIMESTAMP '2024-01-20 20:45:00']) AS decision_time FROM documents) USING (ticker_at_time)
  WHERE validation_status <> 'QUARANTINED' AND available_time <= decision_time AND NOT coalesce(hidden_from <= decision_time, FALSE)""",
    "hidden",
)


def _decisions(spark, sf):
    times = F.array(*[F.lit(t).cast("timestamp") for t in ("2024-01-05 20:45:00", "2024-01-12 20:45:00", "2024-01-20 20:45:00")])
    return V.table(spark, sf, "documents").select(F.col("source").alias("ticker_at_time")).distinct().select("ticker_at_time", F.explode(times).alias("decision_time"))


def _visible(spark, sf):
    return P.as_of_many(V.evidence(spark, sf), _decisions(spark, sf))


def _counts(spark, sf):
    return P.visibility_counts(V.evidence(spark, sf), _decisions(spark, sf))


@query(
    "validate_evidence",
    """SELECT record_id, CASE WHEN published_time < event_time THEN 'published_before_event' WHEN available_time < published_time
    THEN 'available_before_published' END AS reject_reason, event_time, available_time FROM evidence""",
    "evidence",
)
def validate_evidence(spark, sf):
    return P.validate_evidence(V.evidence(spark, sf)).select("record_id", "reject_reason", "event_time", "available_time")


@query(
    "validate_revisions",
    """SELECT record_id, 'DUPLICATE_ID' AS violation FROM evidence GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT e.record_id, 'UNKNOWN_TARGET' FROM evidence e WHERE supersedes_record_id IS NOT NULL AND supersedes_record_id NOT IN (SELECT record_id FROM evidence)
    UNION ALL SELECT e.record_id, 'REVISION_BEFORE_ORIGINAL' FROM evidence e JOIN evidence p ON e.supersedes_record_id = p.record_id AND e.available_time < p.available_time
    UNION ALL SELECT record_id, 'SECOND_REVISION' FROM (SELECT record_id, row_number() OVER (PARTITION BY supersedes_record_id ORDER BY ingested_time, record_id) AS k
      FROM evidence WHERE supersedes_record_id IS NOT NULL) WHERE k > 1""",
    "evidence",
)
def validate_revisions(spark, sf):
    return P.validate_revisions(V.evidence(spark, sf))


@query(
    "as_of",
    f"""SELECT record_id, ticker_at_time, available_time, lineage_cluster_id, validation_status FROM hidden WHERE available_time <= TIMESTAMP '{DECISION}'
    AND validation_status <> 'QUARANTINED' AND NOT coalesce(hidden_from <= TIMESTAMP '{DECISION}', FALSE)""",
    "hidden",
)
def as_of(spark, sf):
    df = P.as_of(V.evidence(spark, sf), F.lit(DECISION).cast("timestamp"))
    return df.select("record_id", "ticker_at_time", "available_time", "lineage_cluster_id", "validation_status")


@query(
    "as_of_all_vintages",
    f"""SELECT ticker_at_time, validation_status, count(*) AS records, CAST(sum(numeric_value) AS BIGINT) AS total FROM evidence
    WHERE available_time <= TIMESTAMP '{DECISION}' GROUP BY 1, 2""",
    "evidence",
)
def as_of_all_vintages(spark, sf):
    df = P.as_of(V.evidence(spark, sf), F.lit(DECISION).cast("timestamp"), include_quarantined=True, latest_vintage_only=False)
    return df.groupBy("ticker_at_time", "validation_status").agg(F.count("*").alias("records"), F.sum("numeric_value").cast("long").alias("total"))


@query("as_of_many", "SELECT ticker_at_time, decision_time, record_id, available_time FROM visible_many", "visible_many")
def as_of_many(spark, sf):
    return _visible(spark, sf).select("ticker_at_time", "decision_time", "record_id", "available_time")


@query(
    "independent_events",
    "SELECT ticker_at_time, decision_time, count(DISTINCT coalesce(lineage_cluster_id, '~')) AS independent_events, count(*) AS records FROM visible_many GROUP BY 1, 2",
    "visible_many",
)
def independent_events(spark, sf):
    return _counts(spark, sf).select("ticker_at_time", "decision_time", "independent_events", "records")


UNRESOLVED = "(lineage_cluster_id IS NULL OR upper(lineage_cluster_id) LIKE 'UNKNOWN%')"


@query(
    "visibility_steps",
    """WITH e AS (SELECT ticker_at_time AS ticker, coalesce(lineage_cluster_id, '~') AS story, available_time AS a, hidden_from AS z FROM hidden WHERE validation_status <> 'QUARANTINED' AND (hidden_from IS NULL OR hidden_from > available_time)),
    t AS (SELECT DISTINCT ticker, unnest([a, z]) AS changed_at FROM e)
    SELECT t.ticker AS ticker_at_time, changed_at, count(e.a) AS records, count(DISTINCT story) AS independent_events FROM t LEFT JOIN e ON e.ticker = t.ticker AND a <= changed_at AND (z IS NULL OR z > changed_at) WHERE changed_at IS NOT NULL GROUP BY 1, 2""",
    "hidden",
)
def visibility_steps(spark, sf):
    """What every ticker shows from each instant on at which anything changes."""
    return P.visibility_steps(V.evidence(spark, sf)).select("ticker_at_time", "changed_at", "records", "independent_events")


@query(
    "independent_events_conservative",
    f"""SELECT ticker_at_time, decision_time, count(DISTINCT lineage_cluster_id) FILTER (WHERE NOT {UNRESOLVED}) AS confirmed_independent_events,
    count(*) FILTER (WHERE {UNRESOLVED}) AS unresolved_count, count(DISTINCT lineage_cluster_id) FILTER (WHERE NOT {UNRESOLVED}) + count(*) FILTER (WHERE {UNRESOLVED})
    AS optimistic_upper_bound FROM visible_many GROUP BY 1, 2""",
    "visible_many",
)
def independent_events_conservative(spark, sf):
    return _counts(spark, sf).drop("independent_events", "records")


@query(
    "lineage_breakdown",
    """SELECT ticker_at_time, decision_time, lineage_cluster_id, record_id, count(*) OVER w AS cluster_size, min(record_id) OVER w AS first_record_id
    FROM visible_many WINDOW w AS (PARTITION BY ticker_at_time, decision_time, lineage_cluster_id)""",
    "visible_many",
)
def lineage_breakdown(spark, sf):
    return P.lineage_breakdown(_visible(spark, sf), ["ticker_at_time", "decision_time"])


@query(
    "future_features",
    f"""SELECT contract_id, count(*) AS violations, min(available_utc) AS first_offender FROM
    (SELECT 'C' || (user_id % 4) AS contract_id, ts + to_seconds(event_id % 4 - CASE WHEN event_id % 37 = 0 THEN 9 ELSE 0 END) AS available_utc, ts FROM events)
    WHERE available_utc > ts + INTERVAL 2 SECOND GROUP BY 1""",
)
def future_features(spark, sf):
    q = V.quotes(spark, sf).withColumn("decision", F.col("observed_utc") + F.expr("INTERVAL '2' SECOND"))
    return P.future_features(q, ["contract_id"], "available_utc", "decision")


fragment(
    "vint",
    f"""SELECT ticker, date, vintage, {R("100 * (1 + (sd - st) / (n * 100.0::DOUBLE))", 4)} AS close,
  {ET("(CASE WHEN ok % 71 = 0 THEN date - 1 ELSE date END)", 960)} AS event_time,
  {ET('date', 1980)} + to_hours(CASE WHEN vintage = 2 AND ok % 3 = 0 THEN 1 ELSE vintage END) AS available_time FROM
  (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(l_linenumber % 3 AS BIGINT) AS vintage, count(*) AS n,
   sum(CAST(round(l_discount * 100) AS BIGINT)) AS sd, sum(CAST(round(l_tax * 100) AS BIGINT)) AS st, sum(l_orderkey) AS ok
   FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)""",
)


@query(
    "bars_as_known",
    f"""WITH seen AS (SELECT * FROM vint WHERE available_time <= TIMESTAMP '2000-01-03 15:30:00'),
    t AS (SELECT ticker, date, available_time, count(DISTINCT (close, event_time)) > 1 AS conflict, arg_min(close, vintage) AS close,
      arg_min(event_time, vintage) AS event_time, min(vintage) AS vintage FROM seen GROUP BY 1, 2, 3),
    l AS (SELECT ticker, date, arg_max(close, available_time) AS close, arg_max(event_time, available_time) AS event_time, arg_max(vintage, available_time) AS vintage,
      max(available_time) AS available_time, bool_or(conflict) AS conflict FROM t GROUP BY 1, 2)
    SELECT ticker, date, close, vintage, available_time, CASE WHEN available_time < event_time THEN 'AVAILABLE_BEFORE_EVENT'
      WHEN CAST(timezone('America/New_York', timezone('UTC', event_time)) AS DATE) <> date THEN 'DATE_EVENT_DISAGREE' WHEN conflict THEN 'CONFLICTING_VINTAGES' END AS fault FROM l""",
    "vint",
)
def bars_as_known(spark, sf):
    return P.bars_as_known(V.bar_vintages(spark, sf), F.lit("2000-01-03 15:30:00").cast("timestamp"))


@query(
    "slice_available",
    f"""WITH k AS (SELECT ticker, date, close, {ET('date', 1980)} AS available_time, row_number() OVER (PARTITION BY ticker ORDER BY date) AS bars_available
      FROM bars WHERE close IS NOT NULL),
    d AS (SELECT ticker, date AS decision_date, {ET('date', 945)} AS decision_time FROM bars)
    SELECT d.ticker, decision_date, decision_time, k.date AS last_available_date, k.close AS last_available_close, bars_available
    FROM d ASOF LEFT JOIN k ON d.ticker = k.ticker AND d.decision_time >= k.available_time""",
    "bars",
)
def slice_available(spark, sf):
    b = V.bars_table(spark, sf)
    from ..operators.bars import by_ticker

    known = b.filter(F.col("close").isNotNull()).select(
        "ticker", "available_time", F.col("date").alias("last_available_date"), F.col("close").alias("last_available_close"),
        F.row_number().over(by_ticker()).cast("long").alias("bars_available"),
    )
    d = b.select("ticker", F.col("date").alias("decision_date"), clock.decision_time("date").alias("decision_time"))
    return A.asof_backward(d, known, "ticker", "decision_time", "available_time", ["last_available_date", "last_available_close", "bars_available"], bucket_seconds=86400 * 90)


@query(
    "underlying_as_of",
    """WITH d AS (SELECT o_orderkey, 'Brand#' || (o_custkey % 25 + 1) AS ticker, CAST(o_orderdate AS DATE) AS snapshot_date FROM orders)
    SELECT o_orderkey, d.ticker, snapshot_date, k.date AS underlying_close_date, k.close AS underlying_close
    FROM d ASOF LEFT JOIN (SELECT * FROM bars WHERE close IS NOT NULL) k ON d.ticker = k.ticker AND d.snapshot_date > k.date""",
    "bars",
)
def underlying_as_of(spark, sf):
    k = V.bars(spark, sf).filter(F.col("close").isNotNull()).select("ticker", "date", F.col("date").alias("underlying_close_date"), F.col("close").alias("underlying_close"))
    d = V.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("snapshot_date")
    )
    return A.asof_backward(d, k, "ticker", "snapshot_date", "date", ["underlying_close_date", "underlying_close"], strict=True, bucket_seconds=86400 * 90)


fragment(
    "quotes",
    f"""SELECT event_id AS quote_no, 'C' || (user_id % 4) AS contract_id, CASE WHEN event_id % 43 <> 0 THEN 'feed' END AS source,
  CASE WHEN event_id % 23 = 0 THEN 'INDICATIVE' WHEN event_id % 3 = 0 THEN 'OPRA' WHEN event_id % 3 = 1 THEN 'NBBO' ELSE 'CONSOLIDATED' END AS feed_type,
  event_id % 29 = 0 AS delayed, bid, {R('bid + (event_id % 5) * 0.05::DOUBLE - 0.05::DOUBLE', 2)} AS ask, event_id % 20 AS bid_size, event_id % 30 AS ask_size,
  CASE WHEN event_id % 31 = 0 THEN 'SHARES' ELSE 'CONTRACTS' END AS size_units, ts AS observed_utc,
  ts + to_seconds(event_id % 4 - CASE WHEN event_id % 37 = 0 THEN 9 ELSE 0 END) AS available_utc,
  ts - to_seconds(event_id % 3) AS bid_utc, ts - to_seconds(event_id % 2) AS ask_utc FROM (SELECT *, {R('value', 2)} AS bid FROM events)""",
)
fragment(
    "sim_orders",
    f"""SELECT event_id AS order_id, 'C' || (user_id % 4) AS contract_id, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, event_id % 7 + 1 AS quantity,
  {R('value * CASE WHEN event_id % 2 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END', 2)} AS limit_price, ts AS submitted_utc, date_trunc('day', ts) + INTERVAL 21 HOUR AS session_close FROM events""",
)


@query(
    "latest_predecision_quote",
    """WITH e AS (SELECT contract_id, available_utc, observed_utc, quote_no, bid, ask FROM quotes WHERE observed_utc <= available_utc),
    m AS (SELECT order_id, max((observed_utc, e.available_utc, quote_no)) AS best FROM sim_orders o JOIN e ON o.contract_id = e.contract_id
      AND e.available_utc <= o.submitted_utc AND e.observed_utc > o.submitted_utc - INTERVAL 3 DAY GROUP BY 1)
    SELECT o.order_id, o.contract_id, o.submitted_utc, q.quote_no, q.observed_utc, q.bid, q.ask FROM sim_orders o LEFT JOIN m USING (order_id) LEFT JOIN quotes q ON q.quote_no = m.best[3]""",
    "quotes sim_orders",
)
def latest_predecision_quote(spark, sf):
    """Two clocks: the newest observation among quotes already received.

    Quotes are received within seconds of being observed, but not in order, so
    the match runs on receipt time and carries the newest observation so far.
    """
    from ..operators.quotes import latest_known_quotes

    o = V.orders_to_fill(spark, sf).select("order_id", "contract_id", "submitted_utc")
    return latest_known_quotes(o, V.quotes(spark, sf), "submitted_utc", ["quote_no", "observed_utc", "bid", "ask"], "quote_no")


@query(
    "containing_session",
    """WITH s AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 870 MINUTE AS open_utc, date_trunc('day', ts) + INTERVAL 21 HOUR AS close_utc,
      date_trunc('day', ts) + to_minutes(CASE WHEN dayofmonth(ts) % 7 = 0 THEN 1000 ELSE 0 END) AS available_utc FROM events),
    m AS (SELECT order_id, submitted_utc, count(open_utc) AS n_sessions, max(open_utc) AS session_open, max(close_utc) AS session_close, max(available_utc) AS av
      FROM sim_orders LEFT JOIN s ON submitted_utc >= open_utc AND submitted_utc < close_utc GROUP BY 1, 2)
    SELECT order_id, submitted_utc, n_sessions, session_open, session_close, CASE WHEN n_sessions <> 1 THEN 'NOT_ONE_SESSION'
      WHEN av > submitted_utc THEN 'SCHEDULE_NOT_KNOWN' ELSE 'OK' END AS session_status FROM m""",
    "sim_orders",
)
def containing_session(spark, sf):
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    s = V.table(spark, sf, "events").select(day.alias("d")).distinct().select(
        (F.col("d") + F.expr("INTERVAL '870' MINUTE")).alias("open_utc"), (F.col("d") + F.expr("INTERVAL '21' HOUR")).alias("close_utc"),
        (F.col("d") + F.make_dt_interval(mins=F.when(F.dayofmonth("d") % 7 == 0, 1000).otherwise(0))).alias("available_utc"), F.lit("exchange").alias("source"),
    )
    o = V.orders_to_fill(spark, sf).select("order_id", "submitted_utc")
    return A.containing_session(o.withColumn("row_id", F.col("order_id")), s, "submitted_utc", "submitted_utc").drop("row_id")


@query(
    "known_contracts",
    """WITH s AS (SELECT 'P' || p_partkey AS contract_id, p_brand AS underlying, TIMESTAMP '1995-01-01' + to_days(CAST(greatest(p_partkey * 31 % 2400, p_partkey * 17 % 2400) AS INTEGER)) AS usable_from
      FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 29 <> 0)
    SELECT underlying, decision_utc, count(*) AS contracts, min(usable_from) AS first_usable FROM s JOIN
    (SELECT DISTINCT date_trunc('month', o_orderdate) + INTERVAL 945 MINUTE AS decision_utc FROM orders) ON usable_from <= decision_utc GROUP BY 1, 2""",
)
def known_contracts(spark, sf):
    months = V.table(spark, sf, "orders").select((F.date_trunc("month", F.col("o_orderdate").cast("timestamp")) + F.expr("INTERVAL '945' MINUTE")).alias("decision_utc")).distinct()
    specs = V.contract_specs(spark, sf)
    # Every underlying is asked at every month end: a small decision table built per underlying.
    per = months.groupBy().agg(F.collect_set("decision_utc").alias("all"))
    d = specs.select("underlying").distinct().select("underlying", F.explode(per.scalar()).alias("decision_utc"))
    return P.known_contract_counts(specs, d)


@query(
    "precondition_reason",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1245 MINUTE AS decision_utc,
      CASE WHEN o_custkey % 6 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_minutes(1200 + (o_custkey % 5) * 30 - CASE WHEN o_custkey % 7 = 0 THEN 1440 ELSE 0 END) END AS snapshot_utc FROM orders),
    e AS (SELECT *, CAST(timezone('America/New_York', timezone('UTC', decision_utc)) AS DATE) AS dd, CAST(timezone('America/New_York', timezone('UTC', snapshot_utc)) AS DATE) AS sd FROM d)
    SELECT o_orderkey, decision_utc, snapshot_utc, CASE WHEN dayofweek(dd) IN (0, 6) THEN 'market closed: decision date is a weekend' WHEN snapshot_utc IS NULL THEN 'no option chain snapshot'
      WHEN snapshot_utc > decision_utc THEN 'option chain was captured after the decision cutoff' WHEN sd <> dd THEN 'option chain is stale' END AS reason FROM e""",
)
def precondition_reason(spark, sf):
    c = F.col("o_custkey")
    base = F.col("o_orderdate").cast("timestamp")
    o = V.table(spark, sf, "orders").select(
        "o_orderkey", (base + F.expr("INTERVAL '1245' MINUTE")).alias("decision_utc"),
        F.when(c % 6 != 0, base + F.make_dt_interval(mins=(F.lit(1200) + c % 5 * 30 - F.when(c % 7 == 0, 1440).otherwise(0)).cast("int"))).alias("snapshot_utc"),
    )
    return o.select("*", P.precondition_reason().alias("reason"))


@query(
    "dedupe_by_content",
    """SELECT content_sha, min(doc_id) AS kept_doc, count(*) - 1 AS duplicates FROM (SELECT doc_id, sha256(text) AS content_sha FROM documents) GROUP BY 1""",
)
def dedupe_by_content(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha"))
    return d.groupBy("content_sha").agg(F.min("doc_id").alias("kept_doc"), (F.count("*") - 1).alias("duplicates"))
