"""The packed study against one row per permutation; session counts of odd intervals."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import calendar as C
from tidemark.operators import evaluate as E

VARIANTS = {"one": {"a": 1.0}, "two": {"a": 0.5, "b": 0.5}}


def observations(spark, n_dates=60, names=4, ties=1):
    rng = random.Random(5)
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), f"T{k}", rng.randint(0, 1), round(rng.uniform(-1, 1), ties), round(rng.uniform(-1, 1), ties), rng.gauss(0, 1)) for i in range(n_dates) for k in range(rng.randint(1, names))]
    return spark.createDataFrame(rows, "decision_date date, ticker string, y int, a double, b double, excess_log_return double")


def folded(spark, monkeypatch):
    """Two overlapping folds; the components of the variants are the columns a and b."""
    obs = observations(spark)
    cal = C.trading_calendar(obs.select(F.col("decision_date").alias("date")))
    splits = C.make_splits(cal, train=25, test=12, horizon=2, embargo=3)
    cells = lambda variants, digits=9: F.array(*[sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in own.items()), F.lit(0.0)) for own in variants.values()])
    monkeypatch.setattr(E, "variant_cells", cells)
    return obs, cal, splits, cells


def test_packed_study_equals_one_row_per_permutation(spark, monkeypatch):
    obs, cal, splits, cells = folded(spark, monkeypatch)
    for permutations in (0, 7, 8, 20):
        got = {(r.variant, r.perm, r.fold): (r.n, r.correct, r.ones) for r in E.fold_results(obs, cal, splits, VARIANTS, permutations, block=4).collect()}
        tagged = C.assign_folds(obs, cal, splits).select("fold", "role", "decision_date", "ticker", "y", cells(VARIANTS).alias("scores"))
        scored = E.spread_variants(E.permute_labels(tagged, permutations, block=4), VARIANTS, ["perm", "fold", "role", "y_perm"])
        keys = ["variant", "perm", "fold"]
        judged = E.predict(scored.where("role = 'test'"), E.best_thresholds(scored.where("role = 'train'"), keys), keys)
        want = judged.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("y_perm")).alias("correct"), F.sum("y_perm").alias("ones")).collect()
        assert got == {(r.variant, r.perm, r.fold): (r.n, r.correct, r.ones) for r in want}
        assert len(got) == 2 * 2 * (permutations + 1)


def test_matrix_is_the_same_in_small_chunks(spark, monkeypatch):
    obs, cal, splits, _ = folded(spark, monkeypatch)
    rows = C.assign_folds(obs, cal, splits).select("fold", "role", "decision_date", "ticker", "y")
    whole, parts = ({(r.fold, r.role, r.decision_date): bytes(r.bits) for r in E.label_matrix(rows, 11, block=4, chunk=chunk).collect()} for chunk in (10**6, 5))
    assert whole == parts
    real = {(r.fold, r.role, r.decision_date, r.ticker): r.y for r in rows.collect()}
    for key, bits in whole.items():
        first = np.frombuffer(bits, np.uint8).reshape(-1, 2)[:, 0] & 1
        assert first.tolist() == [y for k, y in sorted(real.items()) if k[:3] == key]


def test_study_result_says_when_rows_are_too_few(spark):
    obs = observations(spark, 30, 1)
    cal = C.trading_calendar(obs.select(F.col("decision_date").alias("date")))
    splits = C.make_splits(cal, train=15, test=5, horizon=2, embargo=3)
    report = spark.createDataFrame([("one", 5, 0.9, "SIGNAL_CANDIDATE")], "variant string, observations int, accuracy double, verdict string")
    ic = spark.createDataFrame([("a", 3, 0.1, 2.0, True)], "component string, folds int, mean_ic double, t_stat double, thin_universe boolean")
    rows = {(r.variant, r.component): r for r in E.study_result(obs, splits, cal, report, ic, VARIANTS).collect()}
    assert set(rows) == {("one", "a"), ("two", "a"), ("two", "b")}
    one = rows["one", "a"]
    assert one.status == "INSUFFICIENT_ELIGIBLE_DATA" and one.verdict is None and one.n_test < 20 <= one.study_rows
    assert rows["two", "b"].mean_ic is None and one.mean_ic == 0.1


def test_inverted_and_equal_intervals_count_no_sessions(spark):
    """Monday the 8th to Friday the 19th of January 2024, the 15th closed."""
    days = [dt.date(2024, 1, d) for d in (8, 9, 10, 11, 12, 16, 17, 18, 19)]
    cal = C.trading_calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    at = lambda d: dt.date(2024, 1, d)
    pairs = [(at(9), at(12)), (at(12), at(16)), (at(10), at(10)), (at(13), at(13)), (at(16), at(10)), (at(19), at(8)), (at(1), at(30)), (at(30), at(1))]
    got = {(r.a, r.b): r.gap_sessions for r in C.sessions_between(spark.createDataFrame(pairs, "a date, b date"), cal, "a", "b").collect()}
    want = {(a, b): sum(d < b for d in days) - sum(d <= a for d in days) for a, b in pairs}
    assert got == want
    assert [got[p] for p in pairs] == [2, 0, -1, 0, -4, -9, 9, -9]
