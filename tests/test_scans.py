"""Exponential means and growing percentiles without row loops."""

import bisect
import random

import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import features as FE
from tidemark.operators import technical as TE


def test_exponential_mean_equals_recursion(spark):
    rng = random.Random(8)
    rows = [(t, i + 1, rng.choice([1, -1]) * rng.uniform(1, 200)) for t, n in (("a", 2500), ("b", 1), ("c", 1024), ("d", 1025)) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, bar_no long, x double")
    for span in (9, 26):
        got = {(r.ticker, r.bar_no): r.m for r in TE.exponential_mean(df, "x", span, "m").collect()}
        mean, alpha = None, 2 / (span + 1)
        for t, i, x in rows:
            mean = x if i == 1 else (1 - alpha) * mean + alpha * x
            assert got[t, i] == pytest.approx(mean, rel=1e-11, abs=1e-11)
    with pytest.raises(ValueError):
        TE.exponential_mean(df, "x", 200, "m")


def test_counts_of_earlier_values_equal_sorted_inserts(spark):
    rng = random.Random(4)
    rows = [(k, i + 1, rng.randrange(n // 3 + 1)) for k, n in (("a", 300), ("b", 1), ("c", 2), ("d", 64), ("e", 65)) for i in range(n)]
    got = {(r.k, r.p): r.c for r in FE.counted_before(spark.createDataFrame(rows, "k string, p long, v long"), "k", "p", "v", "c").collect()}
    seen = {}
    for k, p, v in rows:
        own = seen.setdefault(k, [])
        bisect.insort(own, v)
        assert got[k, p] == bisect.bisect_right(own, v)
    assert len(got) == len(rows)


def test_percentile_with_gaps(spark):
    """Sessions without a close are skipped; sessions without a volatility keep the last standing."""
    rng = random.Random(6)
    rows = [(t, i, None if rng.random() < 0.1 else 1.0, None if rng.random() < 0.2 else float(rng.randrange(12)) if rng.random() < 0.95 else float("nan")) for t in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "ticker string, date int, close double, vol_20d double")
    got = {(r.ticker, r.date): r.vol_percentile for r in FE.with_volatility_percentile(df, min_rows=30, min_vols=5).collect()}
    want = {}
    for t in "ab":
        seen, current, known = [], None, 0
        for _, i, close, vol in (r for r in rows if r[0] == t):
            if close is not None:
                known += 1
                if vol is not None and vol == vol:
                    bisect.insort(seen, vol)
                    current = vol
            ok = close is not None and known >= 30 and len(seen) >= 5
            want[t, i] = bisect.bisect_right(seen, current) / len(seen) if ok else None
    assert got == want
