"""Raw payload normalizers over texts and documents derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards as GD
from ..operators import ingest as I
from ..sources import views as V
from .registry import ET, R, query


def _li(spark, sf, *cols):
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cols)


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


PXB = R("l_extendedprice / 5000", 2)
PXA = R("l_extendedprice / 5000 + l_tax - 0.03::DOUBLE", 2)


@query(
    "normalize_option_rows",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, strike, CASE WHEN ok THEN bid END AS bid, CASE WHEN ok THEN ask END AS ask, CASE WHEN ok THEN {R('(bid + ask) / 2', 4)} END AS mid, CASE WHEN l_suppkey % 11 <> 0 THEN CAST(floor(l_quantity * 1.5::DOUBLE) AS BIGINT) END AS volume,
    CASE WHEN l_suppkey % 13 <> 0 THEN l_partkey END AS open_interest, CASE WHEN l_suppkey % 7 <> 0 THEN l_discount + 0.1::DOUBLE END AS implied_volatility, CASE WHEN ok THEN 'OK' ELSE 'UNKNOWN' END AS status FROM
    (SELECT *, coalesce(bid > 0 AND ask > 0 AND ask >= bid AND strike IS NOT NULL, FALSE) AS ok FROM (SELECT *, CASE WHEN l_orderkey % 31 <> 0 THEN {PXB} END AS bid, CASE WHEN l_orderkey % 37 <> 0 THEN {PXA} END AS ask,
     CASE WHEN l_orderkey % 41 <> 0 THEN l_partkey::DOUBLE END AS strike FROM lineitem))""",
)
def normalize_option_rows(spark, sf):
    k, s = F.col("l_orderkey"), F.col("l_suppkey")
    li = _li(spark, sf, "l_extendedprice", "l_tax", "l_quantity", "l_discount")
    txt = lambda bad, junk, c: F.when(bad, junk).otherwise(c.cast("string"))
    raw = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", txt(k % 41 == 0, "n/a", F.col("l_partkey")).alias("strike"), txt(k % 31 == 0, "NaN", GD.rounded(F.col("l_extendedprice") / 5000, 2)).alias("bid"),
        txt(k % 37 == 0, "Infinity", GD.rounded(F.col("l_extendedprice") / 5000 + F.col("l_tax") - 0.03, 2)).alias("ask"), txt(s % 11 == 0, "-3", F.col("l_quantity") * 1.5).alias("volume"), txt(s % 13 == 0, "NaN", F.col("l_partkey")).alias("open_interest"),
        txt(s % 7 == 0, "0", F.col("l_discount") + 0.1).alias("implied_volatility"),
    )
    return I.normalize_option_rows(raw)


@query(
    "normalize_eod_contracts",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, 'E' || l_partkey AS contract, CASE WHEN l_returnflag = 'R' THEN 'PUT' ELSE 'CALL' END AS kind, l_partkey::DOUBLE AS strike, CAST(l_shipdate AS DATE) AS expiration, CASE WHEN ok THEN bid END AS bid, CASE WHEN ok THEN ask END AS ask,
    CASE WHEN ok THEN {R('(bid + ask) / 2', 4)} END AS mid, CAST(l_quantity AS BIGINT) AS volume, l_suppkey AS open_interest, CASE WHEN ok THEN 'OK' ELSE 'UNKNOWN' END AS status, CASE WHEN NOT ok THEN 'UNUSABLE_QUOTE' END AS reason
    FROM (SELECT *, bid > 0 AND ask > 0 AND ask >= bid AS ok FROM (SELECT *, {PXB} AS bid, {PXA} AS ask FROM lineitem))""",
)
def normalize_eod_contracts(spark, sf):
    li = _li(spark, sf, "l_extendedprice", "l_tax", "l_quantity", "l_returnflag", "l_shipdate")
    day, odd = F.to_date("l_shipdate").cast("string"), F.col("l_orderkey") % 2 == 1
    c = F.struct(
        F.when(odd, F.concat(F.lit("E"), F.col("l_partkey"))).alias("contract"), F.when(~odd, F.concat(F.lit("E"), F.col("l_partkey"))).alias("symbol"), F.col("l_partkey").cast("double").alias("strike"),
        GD.rounded(F.col("l_extendedprice") / 5000, 2).alias("bid"), GD.rounded(F.col("l_extendedprice") / 5000 + F.col("l_tax") - 0.03, 2).alias("ask"), F.col("l_quantity").cast("long").alias("volume"),
        F.when(odd, F.col("l_suppkey")).alias("openInterest"), F.when(~odd, F.col("l_suppkey")).alias("open_interest"), F.when(odd, day).alias("expirationDate"), F.when(~odd, day).alias("exp_date"),
    )
    put = F.col("l_returnflag") == "R"
    doc = _json(options=F.struct(F.when(~put, F.array(c)).alias("CALL"), F.when(put, F.array(c)).alias("PUT")))
    return I.normalize_eod_contracts(li.select("l_orderkey", "l_linenumber", "l_partkey", doc.alias("payload")))


REF = """SELECT p_partkey, CASE WHEN p_partkey % 19 <> 0 THEN 'O:' || upper(p_brand) || p_partkey END AS contract_symbol, upper(p_brand) AS underlying, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'PUT' ELSE 'CALL' END AS kind,
    CASE WHEN p_partkey % 23 <> 0 THEN p_retailprice END AS strike, CAST(DATE '2024-01-01' + CAST(p_partkey % 400 AS INTEGER) AS VARCHAR) AS expiration, CASE WHEN p_partkey % 3 <> 0 THEN 100 END AS shares, CASE WHEN p_partkey % 7 <> 0 THEN 'american' END AS style FROM part"""


def _reference(spark, sf):
    i = F.col("p_partkey")
    raw = V.table(spark, sf, "part").select(
        "p_partkey", F.when(i % 19 != 0, F.concat(F.lit("O:"), F.upper("p_brand"), i.cast("string"))).alias("ticker"), F.upper("p_brand").alias("underlying_ticker"),
        F.when(i % 5 == 0, "other").when(i % 5 == 1, "put").otherwise("call").alias("contract_type"), F.when(i % 23 != 0, F.col("p_retailprice").cast("string")).otherwise("NaN").alias("strike_price"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 400).cast("int")).cast("string").alias("expiration_date"), F.when(i % 3 == 0, "10.5").otherwise("100").alias("shares_per_contract"), F.when(i % 7 != 0, "American").alias("exercise_style"), F.lit("2024-03-01").cast("date").alias("as_of"),
    )
    return raw


@query(
    "contract_reference",
    f"""SELECT contract_symbol, underlying, kind, strike, expiration, style AS exercise_style, shares AS shares_per_contract, DATE '2024-03-01' AS as_of, CASE WHEN strike IS NOT NULL AND kind IS NOT NULL AND contract_symbol IS NOT NULL THEN 'OK' ELSE 'UNKNOWN' END AS status FROM ({REF})""",
)
def contract_reference(spark, sf):
    return I.normalize_contract_reference(_reference(spark, sf)).withColumn("shares_per_contract", F.col("shares_per_contract").cast("int"))


@query(
    "reference_scope",
    f"""WITH r AS (SELECT *, underlying AS requested, strike IS NOT NULL AND kind IS NOT NULL AND contract_symbol IS NOT NULL AND strike > 0 AND CAST(expiration AS DATE) >= DATE '2024-03-01' AS ok FROM ({REF}))
    SELECT requested, DATE '2024-03-01' AS as_of, count(*) AS rows, count(*) FILTER (WHERE ok IS NOT TRUE) AS bad_rows, CAST(count(*) - count(DISTINCT coalesce(contract_symbol, '~')) AS BIGINT) AS duplicates,
    CASE WHEN count(*) FILTER (WHERE ok IS NOT TRUE) > 0 THEN 'INVALID_CONTRACT_RESPONSE' WHEN count(*) > count(DISTINCT coalesce(contract_symbol, '~')) THEN 'DUPLICATE_CONTRACTS' ELSE 'ACCEPTED' END AS verdict FROM r GROUP BY 1""",
)
def reference_scope(spark, sf):
    return I.reference_scope(I.normalize_contract_reference(_reference(spark, sf)).withColumn("requested", F.col("underlying")))


@query(
    "option_aggregate_bars",
    f"""SELECT contract_symbol, date, open, high, low, vwap, close, volume, transactions, {ET('date', 960)} AS event_time, {ET('date', 1980)} AS available_time, CASE WHEN close > 0 THEN 'OK' ELSE 'UNKNOWN' END AS status FROM
    (SELECT 'A' || user_id AS contract_symbol, CAST(timezone('America/New_York', timezone('UTC', date_trunc('milliseconds', ts))) AS DATE) AS date, CASE WHEN event_id % 17 <> 0 THEN value END AS close, value AS open, CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS high, value / 2 AS low, value AS vwap, CASE WHEN event_id % 3 <> 0 THEN event_id % 500 END AS volume, event_id % 9 AS transactions FROM events)""",
)
def option_aggregate_bars(spark, sf):
    i = F.col("event_id")
    raw = V.table(spark, sf, "events").select(
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("contract_symbol"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("t"), F.when(i % 17 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("c"),
        F.when(i % 3 == 0, "1.5").otherwise((i % 500).cast("string")).alias("v"), (i % 9).cast("string").alias("n"), F.col("value").cast("string").alias("o"),
        F.when(i % 5 == 0, "inf").otherwise((F.col("value") * 2).cast("string")).alias("h"), (F.col("value") / 2).cast("string").alias("l"), F.col("value").cast("string").alias("vw"),
    )
    return I.normalize_option_aggs(raw)


@query(
    "occ_symbol",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 101 <> 0 AND CAST(round_even(l_extendedprice * 4 * 1000, 0) AS BIGINT) > 0 THEN 'O:BRAND' || strftime(l_shipdate, '%y%m%d') || CASE WHEN l_returnflag = 'R' THEN 'P' ELSE 'C' END
    || printf('%08d', CAST(round_even(l_extendedprice * 4 * 1000, 0) AS BIGINT)) END AS symbol FROM lineitem""",
)
def occ_symbol(spark, sf):
    li = _li(spark, sf, "l_extendedprice", "l_returnflag", "l_shipdate").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.lit("brand").alias("u"), F.to_date("l_shipdate").alias("e"),
        F.when(F.col("l_orderkey") % 101 == 0, "BOTH").when(F.col("l_returnflag") == "R", "put").otherwise("call").alias("k"), (F.col("l_extendedprice") * 4).alias("x"),
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", I.occ_symbol("u", "e", "k", "x").alias("symbol"))


@query(
    "select_expiries",
    """SELECT DISTINCT p_brand AS ticker, CAST(l_shipdate AS DATE) AS snapshot_date, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 90 - 5 AS INTEGER) AS expiration FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 90 - 5 BETWEEN 0 AND 60 AND l_orderkey % 41 <> 0""",
)
def select_expiries(spark, sf):
    part = V.table(spark, sf, "part").select("p_partkey", "p_brand")
    li = _li(spark, sf, "l_shipdate")
    e = F.date_add(F.to_date("l_shipdate"), (F.col("l_orderkey") % 90 - 5).cast("int"))
    df = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("snapshot_date"), F.when(F.col("l_orderkey") % 41 == 0, "bad date").otherwise(e.cast("string")).alias("expiration")
    )
    return I.select_expiries(df, ["ticker"], "expiration", "snapshot_date")


@query(
    "chain_snapshot_stats",
    """SELECT ticker, snapshot_date, count(*) FILTER (WHERE named) AS contract_count, count(*) FILTER (WHERE named AND status = 'OK') AS usable_quotes, count(*) FILTER (WHERE named AND expiration - snapshot_date BETWEEN 21 AND 60) AS contracts_in_entry_band,
    count(*) FILTER (WHERE NOT named) AS unreadable_rows FROM (SELECT *, coalesce(kind IN ('CALL', 'PUT'), FALSE) AND strike IS NOT NULL AND expiration IS NOT NULL AS named FROM chain) GROUP BY 1, 2""",
    "chain",
)
def chain_snapshot_stats(spark, sf):
    return I.chain_snapshot_stats(V.chain(spark, sf), ["ticker", "snapshot_date"])


ZONED = "timezone('UTC', timezone(CASE WHEN event_id % 3 = 1 THEN 'America/New_York' ELSE 'Europe/London' END, t))"


@query(
    "parse_calendar_text",
    f"""WITH d AS (SELECT *, date_trunc('second', ts) AS t, CASE WHEN event_id % 29 = 0 THEN 'INVALID_CALENDAR' WHEN event_id % 31 = 0 THEN 'UNSUPPORTED_RECURRING_CALENDAR' END AS reject_reason FROM events)
    SELECT event_id AS doc, 'u' || event_id AS event_id, 'CPI release ' || event_type AS title, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN t ELSE {ZONED} END AS event_utc,
    CASE WHEN event_id % 7 = 0 THEN strftime(t, '%Y%m%d') END AS event_date, CASE WHEN event_id % 5 = 0 THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status, reject_reason FROM d WHERE reject_reason IS NULL
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, reject_reason FROM d WHERE reject_reason IS NOT NULL
    UNION ALL SELECT event_id, 'second', 'Payrolls', t + INTERVAL 1 DAY, NULL, 'TENTATIVE', NULL FROM d WHERE reject_reason IS NULL AND event_id % 4 = 1""",
)
def parse_calendar_text(spark, sf):
    """Documents with folded lines, time zone rules, and one or two events."""
    i, at = F.col("event_id"), F.col("ts").cast("timestamp")
    t = F.date_format(at, "yyyyMMdd'T'HHmmss")
    start = F.when(i % 7 == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.substring(t, 1, 8))).when(i % 3 == 0, F.concat(F.lit("DTSTART:"), t, F.lit("Z"))).when(i % 3 == 1, F.concat(F.lit("DTSTART:"), t)).otherwise(F.concat(F.lit("DTSTART;TZID=Europe/London:"), t))
    nl = F.lit("\r\n")
    zone = F.when(i % 2 == 0, "BEGIN:VTIMEZONE\r\nTZID:Europe/London\r\nBEGIN:DAYLIGHT\r\nRRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=-1SU\r\nEND:DAYLIGHT\r\nEND:VTIMEZONE\r\n").otherwise("")
    second = F.concat(F.lit("BEGIN:VEVENT\r\nUID:second\r\nSUMMARY;LANGUAGE=en:Payrolls\r\nSTATUS:TENTATIVE\r\nDTSTART:"), F.date_format(at + F.expr("INTERVAL 1 DAY"), "yyyyMMdd'T'HHmmss"), F.lit("Z\r\nEND:VEVENT\r\n"))
    text = F.concat(
        F.when(i % 29 == 0, "BEGIN:VJOURNAL").otherwise("BEGIN:VCALENDAR"), nl, zone, F.lit("BEGIN:VEVENT"), nl, F.lit("UID:u"), i.cast("string"), nl, F.lit("SUMMARY:CPI\r\n  release "), F.col("event_type"), nl, start, nl,
        F.when(i % 5 == 0, "STATUS:CANCELLED\r\n").otherwise(""), F.when(i % 31 == 0, "RRULE:FREQ=DAILY\r\n").otherwise(""), F.lit("END:VEVENT\r\n"), F.when(i % 4 == 1, second).otherwise(""), F.lit("END:VCALENDAR\r\n"),
    )
    return I.parse_calendar_text(V.table(spark, sf, "events").select(i.alias("doc"), text.alias("text")))


@query(
    "parse_feed_xml",
    """WITH d AS (SELECT *, CASE WHEN event_id % 37 = 0 THEN 'UNSAFE_XML' WHEN event_id % 41 = 0 THEN 'INVALID_FEED' END AS reject_reason FROM events)
    SELECT event_id AS doc, 'Item & ' || event_type AS title, 'https://example.com/' || event_id AS url, CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) END AS published_utc, reject_reason FROM d WHERE reject_reason IS NULL
    UNION ALL SELECT event_id, NULL, NULL, NULL, reject_reason FROM d WHERE reject_reason IS NOT NULL
    UNION ALL SELECT event_id, '<b>' || event_type || '</b> & more', NULL, date_trunc('minute', ts) + INTERVAL 4 HOUR, NULL FROM d WHERE reject_reason IS NULL AND event_id % 3 = 0""",
)
def parse_feed_xml(spark, sf):
    """Feeds of one or two items with attributes, CDATA, entities, and dates of several zones."""
    i, at = F.col("event_id"), F.col("ts").cast("timestamp")
    said = F.when(i % 4 == 0, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(i % 4 == 1, F.concat(F.date_format(at - F.expr("INTERVAL 5 HOUR"), "d MMM yyyy HH:mm:ss"), F.lit(" EST")))
    said = said.when(i % 4 == 2, F.concat(F.date_format(at + F.expr("INTERVAL 330 MINUTE"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0530"))).otherwise(F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" Z")))
    pub = F.concat(F.lit("<pubDate>"), said, F.lit("</pubDate>"))
    second = F.concat(F.lit("<item rdf:about='x'><title><![CDATA[<b>"), F.col("event_type"), F.lit("</b> & more]]></title><pubDate>"), F.date_format(at, "d MMM yyyy HH:mm"), F.lit(" EDT</pubDate></item>"))
    text = F.concat(
        F.when(i % 37 == 0, '<!DOCTYPE x><rss version="2.0">').when(i % 41 == 0, "<html>").otherwise('<?xml version="1.0"?><rss version="2.0">'), F.lit("<channel><title>Feed</title><item><title>Item &amp; "), F.col("event_type"),
        F.lit("</title><link>https://example.com/"), i.cast("string"), F.lit("</link>"), F.when(i % 11 == 0, "").otherwise(pub), F.lit("</item>"), F.when(i % 3 == 0, second).otherwise(""), F.lit("</channel></rss>"),
    )
    return I.parse_feed_xml(V.table(spark, sf, "events").select(i.alias("doc"), text.alias("text")))


@query(
    "normalize_filings",
    """SELECT o_orderkey AS doc, CASE WHEN ok THEN o_orderkey || '-' || n END AS "accessionNumber", CASE WHEN ok THEN CASE n WHEN 1 THEN '10-K' ELSE '8-K' END END AS form, CASE WHEN ok THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS "filingDate",
    CASE WHEN ok THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T16:3' || n || ':00.000Z' END AS "acceptanceDateTime", CASE WHEN ok THEN 'd' || n END AS "primaryDocument", CASE WHEN ok THEN CAST(o_orderdate AS TIMESTAMP) + to_minutes(990 + n) END AS accepted_utc,
    CASE WHEN ok THEN 'RECENT_SUBMISSIONS_ONLY' END AS coverage, CASE WHEN ok THEN 'CONTEXT_ONLY' END AS usage, CASE WHEN o_orderkey % 19 = 0 THEN 'INVALID_RESPONSE' WHEN NOT ok THEN 'INCONSISTENT_ARRAYS' END AS reject_reason
    FROM (SELECT *, o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS ok FROM orders) CROSS JOIN (VALUES (1), (2)) v(n) WHERE ok OR n = 1""",
)
def normalize_filings(spark, sf):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate").cast("string")
    recent = {
        "accessionNumber": F.array(F.concat(k.cast("string"), F.lit("-1")), F.concat(k.cast("string"), F.lit("-2"))), "form": F.when(k % 17 == 0, F.array(F.lit("10-K"))).otherwise(F.array(F.lit("10-K"), F.lit("8-K"))),
        "filingDate": F.array(d, d), "acceptanceDateTime": F.array(*[F.concat(d, F.lit(f"T16:3{n}:00.000Z")) for n in (1, 2)]), "primaryDocument": F.array(F.lit("d1"), F.lit("d2")),
    }
    nested = F.struct(F.struct(*[v.alias(c) for c, v in recent.items()]).alias("recent"))
    doc = F.when(k % 19 == 0, _json(**recent)).otherwise(_json(filings=nested))  # a document without filings.recent is no answer
    return I.normalize_filings(V.table(spark, sf, "orders").select(k.alias("doc"), doc.alias("payload")))


@query(
    "normalize_macro_vintages",
    """SELECT o_orderkey AS doc, CASE WHEN ok THEN CAST(o_orderdate AS DATE) END AS date, CASE WHEN ok THEN CAST(o_custkey AS VARCHAR) END AS value, CASE WHEN ok THEN DATE '2024-01-01' + CAST(o_orderkey % 31 AS INTEGER) END AS requested_vintage, CASE WHEN ok THEN '2024-01-01' END AS realtime_start, CASE WHEN ok THEN '2024-02-01' END AS realtime_end,
    CASE WHEN NOT ok THEN 'INCOMPLETE_RESPONSE' END AS reject_reason FROM (SELECT *, o_orderkey % 13 <> 0 AS ok FROM orders)""",
)
def normalize_macro_vintages(spark, sf):
    k = F.col("o_orderkey")
    obs = F.array(F.struct(F.to_date("o_orderdate").cast("string").alias("date"), F.col("o_custkey").cast("string").alias("value"), F.lit("2024-01-01").alias("realtime_start"), F.lit("2024-02-01").alias("realtime_end")))
    doc = _json(count=F.when(k % 13 == 0, 2).otherwise(1), observations=obs)
    asked = F.date_add(F.lit("2024-01-01").cast("date"), (k % 31).cast("int"))
    return I.normalize_macro_vintages(V.table(spark, sf, "orders").select(k.alias("doc"), doc.alias("payload"), asked.alias("asked")), vintage="asked")


@query(
    "normalize_macro_series",
    """SELECT o_orderkey AS doc, 'S' || o_custkey AS series_id, '2024' AS year, 'M0' || n AS period, o_totalprice * n AS value, NULL::VARCHAR AS reject_reason FROM orders CROSS JOIN (VALUES (1), (2)) v(n) WHERE o_orderkey % 13 <> 0
    UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, 'REQUEST_FAILED' FROM orders WHERE o_orderkey % 13 = 0""",
)
def normalize_macro_series(spark, sf):
    k = F.col("o_orderkey")
    row = lambda n: F.struct(F.lit("2024").alias("year"), F.lit(f"M0{n}").alias("period"), (F.col("o_totalprice") * n).cast("string").alias("value"))
    doc = _json(
        status=F.when(k % 13 == 0, "REQUEST_FAILED").otherwise("REQUEST_SUCCEEDED"),
        Results=F.struct(F.array(F.struct(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("seriesID"), F.array(row(1), row(2)).alias("data"))).alias("series")),
    )
    return I.normalize_macro_series(V.table(spark, sf, "orders").select(k.alias("doc"), doc.alias("payload")))


@query(
    "normalize_vendor_quotes",
    f"""SELECT event_id AS doc, 'Q' || (event_id + n) AS symbol, {R('value', 2)} AS bid, {R('value + 0.05::DOUBLE', 2)} AS ask, date_trunc('milliseconds', ts) AS bid_utc, date_trunc('milliseconds', ts) + INTERVAL 1 SECOND AS ask_utc, event_id % 50 AS bid_size, CASE WHEN event_id % 3 <> 0 THEN event_id % 40 END AS ask_size,
    'DELAYED_SANDBOX' AS feed_type, 'UNVERIFIED_VENDOR_UNITS' AS size_units, FALSE AS executable_verified, NULL::VARCHAR AS reject_reason FROM events CROSS JOIN (VALUES (0), (1)) v(n) WHERE (n = 0 OR event_id % 2 = 0) AND event_id % 43 <> 0
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, FALSE, 'INVALID_RESPONSE' FROM events WHERE event_id % 43 = 0""",
)
def normalize_vendor_quotes(spark, sf):
    i, ms = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    q = lambda n: F.struct(
        F.concat(F.lit("Q"), (i + n).cast("string")).alias("symbol"), GD.rounded("value", 2).alias("bid"), GD.rounded(F.col("value") + 0.05, 2).alias("ask"), ms.alias("bid_date"), (ms + 1000).alias("ask_date"),
        (i % 50).alias("bidsize"), F.when(i % 3 != 0, i % 40).alias("asksize"),
    )
    doc = F.when(i % 43 == 0, '{"fault":"none"}').when(i % 2 == 0, _json(quotes=F.struct(F.array(q(0), q(1)).alias("quote")))).otherwise(_json(quotes=F.struct(q(0).alias("quote"))))
    return I.normalize_vendor_quotes(V.table(spark, sf, "events").select(i.alias("doc"), doc.alias("payload")))


@query(
    "normalize_snapshots",
    """SELECT event_id AS doc, event_id % 4 = 0 AS more_pages_available, NULL::VARCHAR AS reject_reason, 'C' || user_id AS contract_id, props AS snapshot, 'INDICATIVE' AS feed_type, FALSE AS executable_verified FROM (SELECT * REPLACE (replace(props, ' ', '') AS props) FROM events) WHERE event_id % 47 <> 0
    UNION ALL SELECT event_id, FALSE, 'INVALID_RESPONSE', NULL, NULL, NULL, FALSE FROM events WHERE event_id % 47 = 0""",
)
def normalize_snapshots(spark, sf):
    i = F.col("event_id")
    text = F.concat(F.lit('{"snapshots":{"C'), F.col("user_id").cast("string"), F.lit('":'), F.regexp_replace("props", " ", ""), F.lit("}"), F.when(i % 4 == 0, ',"next_page_token":"n"').otherwise(""), F.lit("}"))
    return I.normalize_snapshots(V.table(spark, sf, "events").select(i.alias("doc"), F.when(i % 47 == 0, "not json").otherwise(text).alias("payload")))


@query(
    "stamp_receipt",
    "SELECT event_id, TIMESTAMP '2024-02-01 12:00:00' AS available_utc, 'MANUAL_UNVERIFIED' AS provenance FROM events",
)
def stamp_receipt(spark, sf):
    rows = V.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("available_utc"))
    return I.stamp_receipt(rows, F.lit("2024-02-01 12:00:00").cast("timestamp"))


@query(
    "credential_scan",
    r"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'token' WHEN doc_id % 9 = 1 THEN 'api_key' END AS forbidden_key, contains(text, 'password') AS has_secret, md5('u?Token=<hidden>&x=1 ' || text) AS redacted FROM documents""",
)
def credential_scan(spark, sf):
    d = V.table(spark, sf, "documents")
    i = F.col("doc_id")
    payload = F.concat(F.lit('{"a":{"'), F.when(i % 9 == 0, "Token").when(i % 9 == 1, "api_key").otherwise("note"), F.lit('" : 1}}'))
    text = F.concat(F.lit("u?Token="), i.cast("string"), F.lit("&x=1 "), F.col("text"))
    return d.select("doc_id", I.forbidden_key(payload).alias("forbidden_key"), I.contains_secret("text", ["password"]).alias("has_secret"), F.md5(I.redact_urls(text)).alias("redacted"))


@query(
    "typed_number_checks",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_orderkey % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'boolean' WHEN 2 THEN 'not_a_number' WHEN 3 THEN 'not_finite' WHEN 4 THEN 'below_minimum' WHEN 5 THEN 'not_whole' END AS reason FROM lineitem""",
)
def typed_number_checks(spark, sf):
    m = F.col("l_orderkey") % 7
    text = F.when(m == 1, "true").when(m == 2, "12a").when(m == 3, "NaN").when(m == 4, "-5").when(m == 5, "2.5").when(m == 6, F.col("l_partkey").cast("string"))
    li = _li(spark, sf).withColumn("t", text)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", GD.number_reject_reason("t", 0, True).alias("reason"))


@query(
    "zoned_timestamps",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE END AS instant FROM events""",
)
def zoned_timestamps(spark, sf):
    i = F.col("event_id")
    base = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(base, F.when(i % 3 == 0, "Z").when(i % 3 == 1, "+05:30").otherwise(""))
    return V.table(spark, sf, "events").select("event_id", GD.zoned_timestamp(text).alias("instant"))
