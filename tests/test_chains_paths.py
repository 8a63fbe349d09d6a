"""Hash chains are dealt once; a path meets only the quotes of its own contracts."""

import pytest

from tidemark.operators import ledger as LG
from tidemark.operators import picks as PK
from tidemark.sources import views as V
from tests.test_options_picks import CH, pick

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_chains_are_dealt_once_from_lines_to_audit(spark):
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        _, plan = plan_of(LG.audit_hash_chain(V.chained_events(spark, SF)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("stretch", [1, 4, 10_000])
def test_audit_across_stretches(frame, stretch):
    rows = [(1, i, "r", f"h{i - 1}" if i > 1 else "", f"h{i}") for i in range(1, 14) if i != 9] + [(1, 5, "fork", "h4", "other"), (1, None, "n", "x", "y"), (None, 1, "a", "", "b"), (None, 2, "a", "b", "c")]
    got = LG.audit_hash_chain(frame(rows, "chain long, seq long, request string, previous_hash string, event_hash string"), stretch=stretch).collect()
    own = [(r.seq, r.link_ok, r.sequence_gap) for r in got if r.chain == 1 and r.seq is not None]
    # Number 5 exists twice, so number 6 is held against both.
    assert sorted(own) == sorted([(i, True, False) for i in (1, 2, 3, 4, 5, 5, 6, 7, 8, 11, 12, 13)] + [(6, False, False), (10, False, True)])
    assert all(not r.link_ok or r.seq == 1 for r in got if r.chain is None) and len(got) == 17


def test_only_quotes_of_the_path_are_ordered(frame):
    bars = frame([("A", f"2024-01-{d:02d}", 100.0) for d in (2, 3, 4, 5, 8, 9)], "ticker string, date date, close double")
    held = [("A", "2024-01-03", 2, "CALL", "2024-02-16", 100.0, 9.5, 9.6, "OK"), ("A", "2024-01-03", 1, "CALL", "2024-02-16", 100.0, 9.0, 9.1, "OK")]
    others = [("A", "2024-01-03", 0, "PUT", "2024-02-16", 100.0, 1.0, 1.1, "OK"), ("B", "2024-01-03", 0, "CALL", "2024-02-16", 100.0, 1.0, 1.1, "OK")]
    path = PK.mark_path(pick(frame), bars, frame(held + others, CH))
    assert "LeftSemi" in plan_of(path)[0]
    assert [(r.day_no, r.method, r.mark) for r in path.orderBy("day_no").limit(1).collect()] == [(1, "MARKET", 9.0)]
