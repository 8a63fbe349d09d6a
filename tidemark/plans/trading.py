"""Quotes, fills and account events over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.guards import settled
from ..operators import ledger as LG
from ..operators import quotes as Q
from ..sources import views as V
from .registry import R, S, fragment, query

AT = "2024-01-15 18:00:00"


def reject_sql(t: str, age: int = 60) -> str:
    return f"""CASE WHEN bid < 0 OR ask < 0 THEN 'malformed_quote' WHEN source IS NULL THEN 'missing_contract_or_source'
    WHEN available_utc < greatest(observed_utc, bid_utc, ask_utc) THEN 'impossible_availability'
    WHEN greatest(observed_utc, available_utc, bid_utc, ask_utc) > {t} THEN 'lookahead_quote'
    WHEN least(observed_utc, bid_utc, ask_utc) < {t} - INTERVAL {age} SECOND THEN 'stale_quote'
    WHEN ask <= 0 OR bid > ask THEN 'crossed_or_invalid_market' WHEN feed_type NOT IN ('OPRA', 'NBBO', 'CONSOLIDATED') OR delayed THEN 'non_executable_feed_type'
    WHEN size_units <> 'CONTRACTS' THEN 'unverified_size_units' END"""


@query(
    "quote_quality",
    f"""SELECT quote_no, contract_id, {reject_sql("observed_utc + INTERVAL 3 SECOND")} AS at_once, {reject_sql("observed_utc + INTERVAL 90 SECOND")} AS late FROM quotes""",
    "quotes",
)
def quote_quality(spark, sf):
    obs = F.col("observed_utc")
    return V.quotes(spark, sf).select(
        "quote_no", "contract_id", Q.quote_reject_reason(obs + F.expr("INTERVAL '3' SECOND")).alias("at_once"),
        Q.quote_reject_reason(obs + F.expr("INTERVAL '90' SECOND")).alias("late"),
    )


@query(
    "distinct_books",
    """SELECT contract_id, feed_type, count(*) AS books, CAST(sum(n) AS BIGINT) AS receipts FROM (SELECT contract_id, source, feed_type, bid, ask, bid_size, ask_size, bid_utc, ask_utc, observed_utc, count(*) AS n
    FROM (SELECT * FROM quotes UNION ALL SELECT * REPLACE (available_utc + INTERVAL 1 HOUR AS available_utc) FROM quotes) GROUP BY ALL) GROUP BY 1, 2""",
    "quotes",
)
def distinct_books(spark, sf):
    q = V.quotes(spark, sf)
    # Every book is read a second time an hour later, as a re-download would.
    twice = q.withColumn("available_utc", F.explode(F.array("available_utc", F.col("available_utc") + F.expr("INTERVAL '1' HOUR"))))
    d = twice.withColumn("quote_id", Q.quote_identity()).groupBy("quote_id", "contract_id", "feed_type").agg(F.count("*").alias("n"))
    return d.groupBy("contract_id", "feed_type").agg(F.count("*").alias("books"), F.sum("n").alias("receipts"))


@query(
    "simulate_fill",
    f"""WITH x AS (SELECT o.order_id, o.side, o.quantity, o.limit_price, o.submitted_utc, q.*, q.available_utc + INTERVAL 2 SECOND AS ex FROM sim_orders o JOIN quotes q ON o.order_id = q.quote_no),
    y AS (SELECT *, CASE WHEN side = 'BUY' THEN ask ELSE bid END AS price, CASE WHEN side = 'BUY' THEN ask_utc ELSE bid_utc END AS st,
      least(quantity, CASE WHEN side = 'BUY' THEN ask_size ELSE bid_size END) AS qty, {reject_sql('ex')} AS qr FROM (SELECT * REPLACE (submitted_utc - INTERVAL 2 SECOND AS submitted_utc) FROM x)),
    z AS (SELECT *, CASE WHEN NOT limit_price > 0 OR ex < submitted_utc THEN 'invalid_order' WHEN qr IS NOT NULL THEN qr WHEN st < submitted_utc + INTERVAL 1 SECOND THEN 'no_post_submission_quote'
      WHEN price <= 0 OR (side = 'BUY' AND price > limit_price) OR (side = 'SELL' AND price < limit_price) THEN 'not_marketable' WHEN qty <= 0 THEN 'insufficient_displayed_size' END AS reason FROM y)
    SELECT order_id, CASE WHEN reason IS NOT NULL THEN 'NO_FILL' WHEN qty = quantity THEN 'FILLED' ELSE 'PARTIAL_FILL' END AS status, reason,
    CASE WHEN reason IS NULL THEN qty END AS fill_quantity, CASE WHEN reason IS NULL THEN price END AS fill_price FROM z""",
    "quotes sim_orders",
)
def simulate_fill(spark, sf):
    o = V.orders_to_fill(spark, sf).drop("contract_id", "session_close").withColumn("submitted_utc", F.col("submitted_utc") - F.expr("INTERVAL '2' SECOND"))
    j = o.join(V.quotes(spark, sf), F.col("order_id") == F.col("quote_no"))
    return j.select("order_id", *[c.alias(n) for n, c in Q.fill_columns(F.col("available_utc") + F.expr("INTERVAL '2' SECOND")).items()])


TOL = 900


@query(
    "first_fill",
    f"""WITH p AS (SELECT o.order_id, o.side, o.quantity, o.limit_price, o.submitted_utc, q.* FROM sim_orders o JOIN quotes q ON o.contract_id = q.contract_id
      AND q.available_utc > o.submitted_utc AND q.available_utc < least(o.submitted_utc + INTERVAL {TOL} SECOND, o.session_close)),
    f AS (SELECT order_id, min((available_utc, observed_utc, quote_no, CASE WHEN side = 'BUY' THEN ask ELSE bid END)) AS f FROM p WHERE limit_price > 0 AND ({reject_sql('available_utc')}) IS NULL
      AND CASE WHEN side = 'BUY' THEN ask_utc ELSE bid_utc END >= submitted_utc + INTERVAL 1 SECOND
      AND CASE WHEN side = 'BUY' THEN ask > 0 AND ask <= limit_price AND ask_size >= quantity ELSE bid > 0 AND bid >= limit_price AND bid_size >= quantity END GROUP BY 1)
    SELECT order_id, CASE WHEN f IS NULL THEN 'NO_FILL' ELSE 'FILLED' END AS fill_status, f[1] AS fill_utc, f[3] AS fill_quote, f[4] AS fill_price FROM sim_orders LEFT JOIN f USING (order_id)""",
    "quotes sim_orders",
)
def first_fill(spark, sf):
    out = Q.first_fills(V.orders_to_fill(spark, sf), V.quotes(spark, sf), TOL)
    return out.select("order_id", "fill_status", "fill_utc", "fill_quote", "fill_price")


@query(
    "displayed_size_allocation",
    """WITH c AS (SELECT contract_id, date_trunc('day', submitted_utc) AS book, side, order_id, submitted_utc, quantity, 60 AS size FROM sim_orders)
    SELECT order_id, side, quantity, least(quantity, greatest(0, size - (sum(quantity) OVER (PARTITION BY contract_id, book, side ORDER BY submitted_utc, order_id) - quantity)))::BIGINT AS allocated FROM c""",
    "sim_orders",
)
def displayed_size_allocation(spark, sf):
    o = V.orders_to_fill(spark, sf).select(
        "contract_id", F.date_trunc("day", "submitted_utc").alias("book"), "side", "order_id", "submitted_utc", "quantity", F.lit(60).cast("long").alias("size")
    )
    out = Q.allocate_displayed_size(o, ["contract_id", "book", "side"], ["submitted_utc", "order_id"], F.hour("submitted_utc"))
    return out.select("order_id", "side", "quantity", F.col("allocated").cast("long").alias("allocated"))


@query(
    "conflicting_quotes",
    """SELECT contract_id, observed_utc, available_utc, count(*) AS versions FROM (SELECT * REPLACE (date_trunc('hour', observed_utc) AS observed_utc, date_trunc('hour', observed_utc) AS available_utc) FROM quotes)
    GROUP BY 1, 2, 3 HAVING count(DISTINCT quote_no) > 1""",
    "quotes",
)
def conflicting_quotes(spark, sf):
    q = V.quotes(spark, sf)
    hour = F.date_trunc("hour", "observed_utc")
    return Q.conflicting_versions(q.withColumn("bid_utc", F.col("observed_utc")).withColumn("available_utc", hour).withColumn("observed_utc", hour))


@query(
    "contract_spec_faults",
    """WITH s AS (SELECT 'P' || (p_partkey - p_partkey % 7 // 6) AS contract_id, p_brand AS underlying, p_type AS type, p_size AS strike FROM part)
    SELECT contract_id, 'DUPLICATE_CONTRACT' AS fault FROM s GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT contract_id, 'AMBIGUOUS_SPECIFICATION' FROM s WHERE (underlying, type, strike) IN (SELECT (underlying, type, strike) FROM s GROUP BY underlying, type, strike HAVING count(*) > 1)""",
)
def contract_spec_faults(spark, sf):
    i = F.col("p_partkey")
    s = V.table(spark, sf, "part").select(
        F.concat(F.lit("P"), (i - F.floor(i % 7 / 6)).cast("string")).alias("contract_id"), F.col("p_brand").alias("underlying"), F.col("p_type").alias("type"), F.col("p_size").alias("strike")
    )
    return Q.contract_spec_faults(s, ("underlying", "type", "strike"))


fragment(
    "fills",
    f"""SELECT account, contract, at_utc, fill_no, side, quantity, price, CAST(round(CAST(price AS DECIMAL(18,6)) * quantity * 10000, 0) AS BIGINT) AS money, quantity * 80 AS fee FROM
  (SELECT o_custkey AS account, 'C' || (l_partkey % 4) AS contract, at_utc + to_days(d) AS at_utc, no + n AS fill_no, side,
   CASE n WHEN 0 THEN q WHEN 1 THEN q // 2 ELSE q - q // 2 END AS quantity, CASE n WHEN 0 THEN p WHEN 1 THEN {R('p * 1.1::DOUBLE', 2)} ELSE {R('p * 0.95::DOUBLE', 2)} END AS price FROM
   (SELECT o_custkey, l_partkey, CAST(l_shipdate AS TIMESTAMP) AS at_utc, (l_orderkey * 8 + l_linenumber) * 4096 + l_suppkey % 1000 * 4 AS no, CAST(l_quantity AS BIGINT) AS q,
    {R('l_extendedprice / 1000', 2)} AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
   CROSS JOIN (VALUES (0, 0, 'BUY'), (1, 3, 'SELL'), (2, 9, 'SELL')) v(n, d, side)) WHERE quantity > 0""",
)


@query(
    "cash_and_position",
    """SELECT account, contract, fill_no, money AS money_cents, fee AS fee_cents,
    CAST(2000000 + sum(CASE WHEN side = 'BUY' THEN -money - fee ELSE money - fee END) OVER (PARTITION BY account ORDER BY at_utc, fill_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cash_cents,
    CAST(sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY account, contract ORDER BY at_utc, fill_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS position FROM fills""",
    "fills",
)
def cash_and_position(spark, sf):
    return LG.cash_and_quantity(V.fills(spark, sf), 2_000_000).select("account", "contract", "fill_no", "money_cents", "fee_cents", "cash_cents", "position")


@query(
    "realized_pnl",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY account, contract ORDER BY at_utc, fill_no) AS rn FROM fills),
    fold AS (SELECT account, contract, rn, fill_no, quantity AS held, money + fee AS cost, 0::BIGINT AS gain FROM o WHERE rn = 1
      UNION ALL SELECT o.account, o.contract, o.rn, o.fill_no, CASE WHEN side = 'BUY' THEN held + quantity ELSE held - quantity END,
        CASE WHEN side = 'BUY' THEN cost + money + fee ELSE cost - b END, CASE WHEN side = 'BUY' THEN 0 ELSE money - fee - b END FROM
        (SELECT o.*, f.held, f.cost, CASE WHEN o.side = 'BUY' THEN 0 WHEN o.quantity = f.held THEN f.cost ELSE CAST(round_even(f.cost * o.quantity / f.held::DOUBLE, 0) AS BIGINT) END AS b
         FROM fold f JOIN o ON o.account = f.account AND o.contract = f.contract AND o.rn = f.rn + 1) o)
    SELECT account, contract, fill_no, cost AS cost_cents, gain AS realized_cents FROM fold""",
    "fills",
)
def realized_pnl(spark, sf):
    return LG.realized_pnl(LG.with_trips(V.fills(spark, sf)))


fragment(
    "pending",
    f"""SELECT o_custkey AS account, 'C' || (l_partkey % 4) AS contract, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS remaining, {R('l_extendedprice / 1000', 2)} AS limit_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
NEED = "CAST(round(CAST(limit_price AS DECIMAL(18,6)) * remaining * 10000, 0) AS BIGINT) + remaining * 80"


@query(
    "reserved_cash",
    f"""SELECT account, CAST(coalesce(sum({NEED}) FILTER (WHERE side = 'BUY' AND remaining > 0), 0) AS BIGINT) AS reserved_cents,
    count(*) FILTER (WHERE side = 'BUY' AND remaining > 0) AS open_orders, count(DISTINCT contract) FILTER (WHERE side = 'BUY' AND remaining > 0) AS exposures FROM pending GROUP BY 1""",
    "pending",
)
def reserved_cash(spark, sf):
    return LG.reserved_cash(V.pending_orders(spark, sf))


@query(
    "proposal_context",
    f"""WITH r AS (SELECT account, CAST(coalesce(sum({NEED}) FILTER (WHERE side = 'BUY' AND remaining > 0), 0) AS BIGINT) AS open_risk FROM pending GROUP BY 1),
    x AS (SELECT c_custkey AS account, {R('c_acctbal', 2)} AS bal, c_custkey % 5 + 1 AS q, open_risk, CAST(round(CAST({R('abs(c_acctbal) / 500', 2)} AS DECIMAL(18,6)) * (c_custkey % 5 + 1) * 10000, 0) AS BIGINT) AS cost
      FROM customer JOIN r ON c_custkey = account)
    SELECT account, cost AS proposed_cents, {S('cost / 2000000.0::DOUBLE', 6)} AS position_pct, {S('(open_risk + cost) / 2000000.0::DOUBLE', 6)} AS portfolio_heat_pct,
    CAST(round(CAST(bal AS DECIMAL(18,6)) * 100, 0) AS BIGINT) >= cost AS cash_sufficient FROM x""",
    "pending",
)
def proposal_context(spark, sf):
    r = LG.reserved_cash(V.pending_orders(spark, sf)).select("account", F.col("reserved_cents").alias("open_risk_cents"))
    from ..functions.guards import rounded

    c = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account"), F.round(rounded("c_acctbal", 2).cast("decimal(18,6)") * 100, 0).cast("long").alias("cash_cents"),
        F.lit(2_000_000).alias("equity_cents"), rounded(F.abs("c_acctbal") / 500, 2).alias("entry_price"), (F.col("c_custkey") % 5 + 1).alias("quantity"),
    )
    df = LG.proposal_context(c.join(r, "account"))
    return df.select("account", "proposed_cents", settled("position_pct", 6).alias("position_pct"), settled("portfolio_heat_pct", 6).alias("portfolio_heat_pct"), "cash_sufficient")


@query(
    "liquidation_equity",
    f"""WITH pos AS (SELECT account, contract, CAST(sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS BIGINT) AS quantity FROM fills WHERE at_utc <= TIMESTAMP '1998-06-30' GROUP BY 1, 2),
    held AS (SELECT * FROM pos WHERE quantity > 0),
    m AS (SELECT * FROM quotes WHERE quote_no IN (SELECT arg_max(quote_no, (observed_utc, available_utc, quote_no)) FROM quotes WHERE observed_utc <= available_utc AND available_utc <= TIMESTAMP '{AT}' GROUP BY contract_id)),
    j AS (SELECT h.*, m.bid, coalesce(({reject_sql(f"TIMESTAMP '{AT}'", 7200)}) IS NULL AND m.contract_id IS NOT NULL, FALSE) AS fresh FROM held h LEFT JOIN m ON m.contract_id = h.contract)
    SELECT account, CASE WHEN bool_and(fresh) THEN CAST(1000000 + sum(CAST(round(CAST(bid AS DECIMAL(18,6)) * quantity * 10000, 0) AS BIGINT)) AS BIGINT) END AS equity_cents,
    count(*) AS positions, count(*) FILTER (WHERE NOT fresh) AS stale_marks FROM j GROUP BY 1""",
    "fills quotes",
)
def liquidation_equity(spark, sf):
    f = V.fills(spark, sf).filter(F.col("at_utc") <= F.lit("1998-06-30").cast("timestamp"))
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    held = f.groupBy("account", "contract").agg(F.sum(signed).alias("quantity")).filter("quantity > 0").withColumn("cash_cents", F.lit(1_000_000).cast("long"))
    at_utc = F.lit(AT).cast("timestamp")
    q = V.quotes(spark, sf).filter((F.col("observed_utc") <= F.col("available_utc")) & (F.col("available_utc") <= at_utc))
    marks = q.groupBy("contract_id").agg(F.max_by(F.struct(*[c for c in q.columns if c != "contract_id"]), F.struct("observed_utc", "available_utc", "quote_no")).alias("m")).select("contract_id", "m.*")
    return LG.liquidation_equity(held, marks, at_utc, 7200)


@query(
    "audit_hash_chain",
    """WITH RECURSIVE e AS (SELECT l_orderkey AS chain, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
      concat_ws(':', l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS request FROM lineitem),
    c AS (SELECT chain, seq, request, '' AS previous_hash, sha256(concat_ws('|', seq, request, '')) AS event_hash FROM e WHERE seq = 1
      UNION ALL SELECT e.chain, e.seq, e.request, c.event_hash, sha256(concat_ws('|', e.seq, e.request, c.event_hash)) FROM c JOIN e ON e.chain = c.chain AND e.seq = c.seq + 1)
    SELECT chain, seq, TRUE AS link_ok, (chain * 7 + seq) % 53 <> 0 AS digest_ok, FALSE AS sequence_gap FROM c""",
)
def audit_hash_chain(spark, sf):
    return LG.audit_hash_chain(V.chained_events(spark, sf))


@query(
    "command_idempotency",
    """WITH e AS (SELECT o_custkey AS account, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, 'cmd' || (o_orderkey % 7) AS command_id,
      o_orderpriority AS request, CAST(o_orderdate AS TIMESTAMP) AS at_utc FROM orders),
    f AS (SELECT *, first_value(request) OVER w AS fr, first_value(seq) OVER w AS fs, max(at_utc) OVER (PARTITION BY account ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx
      FROM e WINDOW w AS (PARTITION BY account, command_id ORDER BY seq))
    SELECT account, seq, command_id, CASE WHEN seq > fs AND request = fr THEN 'DUPLICATE' WHEN seq > fs THEN 'REUSED_ID' WHEN at_utc < mx THEN 'TIME_BACKWARDS' ELSE 'ACCEPTED' END AS status FROM f""",
)
def command_idempotency(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    e = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("account"), F.row_number().over(w).cast("long").alias("seq"), F.concat(F.lit("cmd"), (F.col("o_orderkey") % 7).cast("string")).alias("command_id"),
        F.col("o_orderpriority").alias("request"), F.col("o_orderdate").cast("timestamp").alias("at_utc"),
    )
    return LG.command_status(e).select("account", "seq", "command_id", "status")


@query(
    "day_order_expiry",
    """SELECT order_id, CASE WHEN order_id % 3 = 0 THEN 'DONE' WHEN submitted_utc + INTERVAL 2 HOUR >= session_close THEN 'EXPIRED_DAY_ORDER' ELSE 'LIVE' END AS status FROM sim_orders""",
    "sim_orders",
)
def day_order_expiry(spark, sf):
    o = V.orders_to_fill(spark, sf).withColumn("remaining", F.when(F.col("order_id") % 3 == 0, 0).otherwise(F.col("quantity")))
    return o.select("order_id", LG.day_order_status(F.col("submitted_utc") + F.expr("INTERVAL '2' HOUR")).alias("status"))
