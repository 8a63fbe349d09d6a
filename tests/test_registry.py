"""Every registered query has a callable; every twin names a query."""

import __spark_entry__ as entry
from tidemark.plans import all_queries


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 90 and set(o) <= set(q)
    assert all(callable(f) for f in q.values())
    assert all(n.startswith(("op", "pipeline")) for n in set(q) - set(all_queries()))


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and "base_rate_y1" in rows[0].asDict()


def test_bench_runs_the_whole_study(spark, monkeypatch):
    import bench
    from tidemark.operators import evaluate

    asked = []
    monkeypatch.setattr(evaluate, "fold_results", lambda *a, **k: asked.append((a, k)) or "folds")
    monkeypatch.setattr(evaluate, "evaluation_report", lambda folds: folds)
    monkeypatch.setattr(bench.study.V, "study_inputs", lambda spark, sf: (None, None, None))
    assert bench.walk_forward_200(spark, "") == "folds" and asked[0][0][-1] == 200 and len(asked[0][0][3]) == 5
