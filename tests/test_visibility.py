"""Counts by sweep against counted pairs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import pit as P
from tests.test_pit_quotes import EV, rec


def evidence(frame, n=300, seed=9):
    rng = random.Random(seed)
    when = lambda: f"2024-01-{rng.randint(1, 28):02d} {rng.randint(0, 2):02d}:00:00"
    clusters = [None, None, "UNKNOWN-1", "unknown-x", "wire", "own", "a", "b"]
    rows = [rec(f"r{i}", when(), rng.choice(clusters), f"r{rng.randrange(n)}" if rng.random() < 0.4 else None, rng.choice(["VALID", "VALID", "VALID", "QUARANTINED"]), rng.choice("AAAB")) for i in range(n)]
    return frame(rows + [rec("late", None, "wire"), rec("hot", "2024-01-02 00:00:00", None)], EV)


def decisions(frame):
    rng = random.Random(3)
    times = [f"2024-01-{rng.randint(1, 29):02d} {rng.randint(0, 3):02d}:00:00" for _ in range(25)] + ["2023-12-31 00:00:00", "2024-02-20 00:00:00"]
    return frame([(t, w) for t in "ABC" for w in times] + [("A", times[0])], "ticker_at_time string, decision_time timestamp")


def test_sweep_equals_counted_pairs(frame):
    df, asked = evidence(frame), decisions(frame).distinct()
    keys = ["ticker_at_time", "decision_time"]
    for quarantined in (False, True):
        pairs = P.as_of_many(df, asked, include_quarantined=quarantined)
        both = P.independent_events(pairs, keys).join(P.independent_events_conservative(pairs, keys), keys)
        want = {(r.ticker_at_time, r.decision_time): (r.records, r.independent_events, r.confirmed_independent_events, r.unresolved_count, r.optimistic_upper_bound) for r in both.collect()}
        for seconds in (3600, 86400 * 400):
            rows = P.visibility_counts(df, decisions(frame), quarantined, seconds).collect()
            got = {(r.ticker_at_time, r.decision_time): (r.records, r.independent_events, r.confirmed_independent_events, r.unresolved_count, r.optimistic_upper_bound) for r in rows}
            assert got == want and len(rows) == len(want) > 30


def test_sweep_makes_no_pairs(frame):
    plan = P.visibility_counts(evidence(frame), decisions(frame))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("_bucket" in line for line in joins)


def test_nothing_to_see(frame):
    df = evidence(frame)
    assert P.visibility_counts(df.limit(0), decisions(frame)).count() == 0
    assert P.visibility_counts(df, decisions(frame).limit(0)).count() == 0


def test_contract_counts_equal_counted_pairs(frame):
    rng = random.Random(1)
    day = lambda: str(dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(90)))
    rows = [(f"k{i}", rng.choice("XY"), rng.random() < 0.8, 100, 100, "feed" if i % 9 else None, day(), day() if i % 11 else None) for i in range(120)]
    specs = frame(rows, "contract_id string, underlying string, standard_contract boolean, premium_multiplier int, deliverable_shares int, spec_source string, known_utc timestamp, listed_utc timestamp")
    asked = frame([(u, f"2024-0{m}-15 00:00:00") for u in "XYZ" for m in (1, 2, 3, 4)] + [("X", "2023-01-01 00:00:00")], "underlying string, decision_utc timestamp")
    want = {(r.underlying, r.decision_utc): (r.n, r.f) for r in P.known_contracts(specs, asked).groupBy("underlying", "decision_utc").agg(F.count("*").alias("n"), F.min("usable_from").alias("f")).collect()}
    for seconds in (86400, 86400 * 30):
        assert {(r.underlying, r.decision_utc): (r.contracts, r.first_usable) for r in P.known_contract_counts(specs, asked, seconds).collect()} == want
