import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import ledger as LG
from tidemark.operators import pit as P
from tidemark.operators import quotes as Q

EV = "record_id string, ticker_at_time string, event_time timestamp, published_time timestamp, available_time timestamp, ingested_time timestamp, lineage_cluster_id string, supersedes_record_id string, validation_status string"


def rec(rid, at, cluster="c", sup=None, status="VALID", ticker="A", published=None):
    return (rid, ticker, published or at, published or at, at, at, cluster, sup, status)


def ids(df):
    return sorted(r.record_id for r in df.collect())


def lit(t):
    return F.lit(t).cast("timestamp")


def test_revision_is_visible_only_after_its_own_availability(frame):
    df = frame([rec("gdp1", "2024-02-01 12:00:00"), rec("gdp2", "2024-03-28 12:00:00", sup="gdp1")], EV)
    assert ids(P.as_of(df, lit("2024-03-10 00:00:00"))) == ["gdp1"]
    assert ids(P.as_of(df, lit("2024-03-28 12:00:00"))) == ["gdp2"]
    assert ids(P.as_of(df, lit("2024-04-01 00:00:00"), latest_vintage_only=False)) == ["gdp1", "gdp2"]


def test_quarantined_superseder_still_hides_its_target(frame):
    df = frame([rec("a", "2024-01-01 00:00:00"), rec("b", "2024-01-02 00:00:00", sup="a", status="QUARANTINED", ticker="B")], EV)
    assert ids(P.as_of(df, lit("2024-01-03 00:00:00"))) == []


def test_syndicated_copies_are_one_event_and_unknown_never_confirms(frame):
    rows = [rec(f"r{i}", "2024-01-01 00:00:00", "wire") for i in range(9)] + [rec("x", "2024-01-01 00:00:00", "own"), rec("u", "2024-01-01 00:00:00", "UNKNOWN-1"), rec("n", "2024-01-01 00:00:00", None)]
    df = frame(rows, EV)
    assert P.independent_events(df, ["ticker_at_time"]).first().independent_events == 4
    c = P.independent_events_conservative(df, ["ticker_at_time"]).first()
    assert (c.confirmed_independent_events, c.unresolved_count, c.optimistic_upper_bound) == (2, 2, 4)
    sizes = {r.record_id: r.cluster_size for r in P.lineage_breakdown(df, ["ticker_at_time"]).collect()}
    assert sizes["r3"] == 9 and sizes["n"] == 1


def test_revision_rules(frame):
    rows = [rec("a", "2024-01-05 00:00:00"), rec("b", "2024-01-04 00:00:00", sup="a"), rec("c", "2024-01-06 00:00:00", sup="a"), rec("d", "2024-01-06 00:00:00", sup="zz"), rec("e", "2024-01-01 00:00:00"), rec("e", "2024-01-01 00:00:00")]
    got = {(r.record_id, r.violation) for r in P.validate_revisions(frame(rows, EV)).collect()}
    assert got == {("b", "REVISION_BEFORE_ORIGINAL"), ("c", "SECOND_REVISION"), ("d", "UNKNOWN_TARGET"), ("e", "DUPLICATE_ID")}


def test_as_of_many_agrees_with_single_reads(frame, spark):
    rng = random.Random(7)
    rows = [rec(f"r{i}", f"2024-01-{rng.randint(1, 28):02d} 00:00:00", f"c{i % 5}", f"r{i - 1}" if i % 3 == 0 and i else None, "VALID" if i % 7 else "QUARANTINED", "AB"[i % 2]) for i in range(60)]
    df = frame(rows, EV)
    d = frame([(t, w) for t in "AB" for w in ("2024-01-10 00:00:00", "2024-01-20 00:00:00")], "ticker_at_time string, decision_time timestamp")
    got = P.as_of_many(df, d, salts=3)
    for t in "AB":
        for w in ("2024-01-10 00:00:00", "2024-01-20 00:00:00"):
            assert ids(got.filter((F.col("ticker_at_time") == t) & (F.col("decision_time") == lit(w)))) == ids(P.as_of(df, lit(w), ticker=t))


@pytest.mark.parametrize("strict", [False, True])
def test_backward_asof_equals_brute_force(spark, strict):
    rng = random.Random(11)
    right = [("k", rng.randint(0, 500), i) for i in range(60)]
    left = [("k", rng.randint(0, 500), i) for i in range(60)]
    mk = lambda rows, n: spark.createDataFrame(rows, f"key string, s int, {n} int").withColumn("t", F.timestamp_seconds("s"))
    out = A.asof_backward(mk(left, "l"), mk(right, "r").withColumnRenamed("t", "rt").select("key", "rt", "r"), "key", "t", "rt", ["r"], ["r"], strict, 50)
    got = {x.l: x.r for x in out.collect()}
    for _, s, l in left:
        ok = [(rs, r) for _, rs, r in right if (rs < s if strict else rs <= s)]
        assert got[l] == (max(ok)[1] if ok else None)


Q_DDL = "quote_no int, contract_id string, source string, feed_type string, delayed boolean, bid double, ask double, bid_size long, ask_size long, size_units string, observed_utc timestamp, available_utc timestamp, bid_utc timestamp, ask_utc timestamp"
GOOD = dict(quote_no=1, contract_id="C", source="s", feed_type="OPRA", delayed=False, bid=1.0, ask=1.1, bid_size=5, ask_size=5, size_units="CONTRACTS", observed_utc="2024-01-02 15:00:05", available_utc="2024-01-02 15:00:06", bid_utc=None, ask_utc=None)


@pytest.mark.parametrize(
    "change,reason",
    [
        ({}, None), ({"bid": float("nan")}, "malformed_quote"), ({"ask": float("inf")}, "malformed_quote"), ({"source": None}, "missing_contract_or_source"),
        ({"available_utc": "2024-01-02 15:00:04"}, "impossible_availability"), ({"available_utc": "2024-01-02 15:02:00"}, "lookahead_quote"), ({"observed_utc": "2024-01-02 14:58:00", "available_utc": "2024-01-02 14:58:01"}, "stale_quote"),
        ({"bid": 2.0}, "crossed_or_invalid_market"), ({"feed_type": "INDICATIVE"}, "non_executable_feed_type"), ({"delayed": None}, "non_executable_feed_type"), ({"size_units": "SHARES"}, "unverified_size_units"), ({"ask_size": None}, "malformed_quote"),
    ],
)
def test_quote_reasons(frame, change, reason):
    row = {**GOOD, **change}
    assert frame([tuple(row.values())], Q_DDL).select(Q.quote_reject_reason(lit("2024-01-02 15:00:30")).alias("r")).first().r == reason


def test_receipt_time_does_not_change_identity(frame):
    rows = [tuple(GOOD.values()), tuple({**GOOD, "available_utc": "2024-01-02 16:00:00"}.values()), tuple({**GOOD, "bid": 0.9}.values())]
    assert Q.distinct_books(frame(rows, Q_DDL)).count() == 2


def test_fill_never_beats_touch_or_size(frame):
    rng = random.Random(5)
    o_ddl = "order_id int, contract_id string, side string, quantity long, limit_price double, submitted_utc timestamp, session_close timestamp"
    orders = [(i, "C", rng.choice(["BUY", "SELL"]), rng.randint(1, 8), round(rng.uniform(0.8, 1.3), 2), "2024-01-02 15:00:00", "2024-01-02 21:00:00") for i in range(50)]
    quotes = [tuple({**GOOD, "quote_no": n, "bid": round(rng.uniform(0.9, 1.0), 2), "ask": round(rng.uniform(1.0, 1.2), 2), "observed_utc": f"2024-01-02 15:00:{10 + n:02d}", "available_utc": f"2024-01-02 15:00:{11 + n:02d}"}.values()) for n in range(10)]
    out = Q.first_fills(frame(orders, o_ddl), frame(quotes, Q_DDL)).collect()
    by = {q[0]: q for q in quotes}
    assert any(r.fill_status == "FILLED" for r in out)
    for r in out:
        if r.fill_status == "FILLED":
            q = by[r.fill_quote]
            assert r.quantity <= 5 and (r.fill_price == q[6] <= r.limit_price if r.side == "BUY" else r.fill_price == q[5] >= r.limit_price)


def test_account_numbers(frame):
    ddl = "account long, contract string, fill_no long, at_utc timestamp, side string, quantity long, price double"
    f = frame([(1, "C", 1, "2024-01-02 15:00:00", "BUY", 1, 1.10), (1, "C", 2, "2024-01-02 15:01:00", "BUY", 1, 1.10), (1, "C", 3, "2024-01-03 15:00:00", "SELL", 2, 1.00)], ddl)
    cash = {r.fill_no: (r.cash_cents, r.position) for r in LG.cash_and_quantity(f, 2_000_000).collect()}
    assert cash[1] == (1_988_920, 1) and cash[3] == (1_997_680, 0)
    pnl = LG.realized_pnl(LG.round_trips(LG.cash_and_quantity(f))).filter("fill_no = 3").first()
    assert (pnl.realized_cents, pnl.cost_cents) == (-2320, 0)


def test_hash_chain_audit_finds_a_change(spark):
    ev = spark.createDataFrame([(c, s, f"r{s}") for c in (1, 2) for s in range(1, 5)], "chain long, seq long, request string")
    good = LG.build_chain(ev)
    bad = good.withColumn("request", F.when((F.col("chain") == 2) & (F.col("seq") == 3), "forged").otherwise(F.col("request")))
    assert LG.audit_hash_chain(good).filter("NOT (link_ok AND digest_ok)").count() == 0
    assert [(r.chain, r.seq) for r in LG.audit_hash_chain(bad).filter("NOT digest_ok").collect()] == [(2, 3)]
    cut = LG.audit_hash_chain(good.filter("NOT (chain = 1 AND seq = 2)")).filter("sequence_gap").collect()
    assert [(r.chain, r.seq) for r in cut] == [(1, 3)]


def test_first_fills_equal_brute_force(spark):
    """Dense quotes over several cells of time, late receipts, quotes from before the submission."""
    rng = random.Random(8)
    base = 1_704_207_600
    at = lambda c: F.timestamp_seconds(c)
    orders = [(i, rng.choice("CD"), rng.choice(["BUY", "SELL"]), rng.randint(1, 9), round(rng.uniform(0.7, 1.4), 2), base + rng.randint(0, 6000), base + rng.choice([3000, 7000])) for i in range(150)]
    quotes = []
    for n in range(1500):
        s, lag = base + rng.randint(0, 6000), rng.randint(0, 4)
        quotes.append((n, rng.choice("CD"), round(rng.uniform(0.7, 1.0), 2), round(rng.uniform(1.0, 1.4), 2), rng.randint(0, 9), rng.randint(0, 9), s, s + lag, s - rng.randint(0, 2)))
    o = spark.createDataFrame(orders, "order_id int, contract_id string, side string, quantity long, limit_price double, s long, e long").withColumns({"submitted_utc": at("s"), "session_close": at("e")}).drop("s", "e")
    q = spark.createDataFrame(quotes, "quote_no int, contract_id string, bid double, ask double, bid_size long, ask_size long, o long, a long, t long").withColumns(
        {"observed_utc": at("o"), "available_utc": at("a"), "bid_utc": at("t"), "ask_utc": at("t"), "source": F.lit("s"), "feed_type": F.lit("OPRA"), "delayed": F.lit(False), "size_units": F.lit("CONTRACTS")}
    ).drop("o", "a", "t")
    got = {r.order_id: (r.fill_quote, r.fill_price) for r in Q.first_fills(o, q, 60).collect()}
    usable = {r.order_id: (r.quote_no, r.fill_price) for r in Q.whole_fills(o, q.filter(Q.quote_reject_reason("available_utc").isNull()), 60).collect()}
    hits = 0
    for i, c, side, n, limit, s, e in orders:
        buy = side == "BUY"
        ok = [(a, ob, no, ask if buy else bid) for no, qc, bid, ask, bs, as_, ob, a, t in quotes if qc == c and s < a < min(s + 60, e) and t >= s + 1 and (ask <= limit and as_ >= n if buy else bid >= limit and bs >= n)]
        want = min(ok)[2:] if ok else (None, None)
        hits += bool(ok)
        assert got[i] == want and usable.get(i, (None, None)) == want
    assert 20 < hits < 150

def test_busy_accounts_are_cut_and_others_not(spark):
    rng = random.Random(4)
    rows = []
    for account, n in ((1, 40), (2, 4), (3, 6)):
        held = {}
        for i in range(n):
            c = rng.choice("XY")
            q = rng.randint(1, 5) if not held.get(c) or rng.random() < 0.4 else -rng.randint(1, held[c])
            held[c] = held.get(c, 0) + q
            rows.append((account, c, i, 1_700_000_000 + i * 500_000, "BUY" if q > 0 else "SELL", abs(q), round(rng.uniform(1, 2), 2)))
    f = spark.createDataFrame(rows, "account long, contract string, fill_no long, s long, side string, quantity long, price double").withColumn("at_utc", F.timestamp_seconds("s")).drop("s")
    sums = lambda n: sorted(tuple(r) for r in LG.cash_and_quantity(f, 5, busy_rows=n).select("account", "fill_no", "cash_cents", "position").collect())
    gains = lambda df: sorted(tuple(r) for r in LG.realized_pnl(df).collect())
    cut, together = LG.with_trips(f, busy_rows=10), LG.with_trips(f)
    assert sums(10) == sums(1000) and gains(cut) == gains(together) == gains(LG.round_trips(LG.cash_and_quantity(f)))
    assert {r.account for r in cut.filter("trip > 0").select("account").distinct().collect()} == {1} and together.filter("trip > 0").isEmpty()


def test_fills_that_share_time_and_number_have_one_order(spark):
    rows = [(1, "C", 7, "BUY", q, p) for q, p in ((16, 1.3), (13, 1.2), (13, 1.1))]
    for order in (rows, rows[::-1]):
        f = spark.createDataFrame(order, "account long, contract string, fill_no long, side string, quantity long, price double").withColumn("at_utc", F.timestamp_seconds(F.lit(0)))
        got = {(r.quantity, r.price): r.position for r in LG.cash_and_quantity(f).collect()}
        assert got == {(13, 1.1): 13, (13, 1.2): 26, (16, 1.3): 42}
