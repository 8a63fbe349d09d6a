import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_bars_labels import days
from tidemark.functions.clock import bar_available_time
from tidemark.operators import calendar as C
from tidemark.operators import evaluate as E
from tidemark.operators import features as FE
from tidemark.operators import rank_ic as IC
from tidemark.operators.running import average_ranks, running_sums

BARS = "ticker string, date date, close double, daily_total_return double, available_time timestamp"


def walk(frame, n=140, gaps=()):
    rng = random.Random(3)
    rows, close = [], 100.0
    for i, d in enumerate(days(n)):
        r = rng.uniform(-0.03, 0.03)
        close *= 1 + r
        known = i not in gaps
        rows.append(("A", d, close if known else None, r if i and known and (i - 1) not in gaps else None, None))
    return frame(rows, BARS), rows


def test_features_match_a_plain_computation(frame):
    df, rows = walk(frame)
    got = {str(r.date): r for r in FE.raw_features(df).collect()}
    r = np.array([x[3] if x[3] is not None else np.nan for x in rows])
    c = np.array([x[2] for x in rows])
    i = 120
    f = got[rows[i][1]]
    assert f.return_20d == pytest.approx(np.prod(1 + r[i - 19 : i + 1]) - 1)
    assert f.distance_from_sma50 == pytest.approx(c[i] / c[i - 49 : i + 1].mean() - 1)
    assert f.vol_20d == pytest.approx(r[i - 19 : i + 1].std(ddof=1) * np.sqrt(252))
    assert f.drawdown_252d == pytest.approx(c[i] / c[: i + 1].max() - 1)
    vols = [r[k - 19 : k + 1].std(ddof=1) for k in range(20, i + 1)]
    assert f.vol_percentile == pytest.approx(sum(v <= vols[-1] for v in vols) / len(vols))
    assert got[rows[59][1]].return_60d is None and got[rows[60][1]].return_60d is not None


def test_decision_sees_only_earlier_bars_and_skips_unknown_ones(frame):
    df, rows = walk(frame, 100, gaps=(90,))
    got = {str(r.decision_date): r for r in FE.decision_features(df).collect()}
    assert str(got[rows[90][1]].as_of_date) == rows[89][1]
    assert str(got[rows[91][1]].as_of_date) == rows[89][1]
    changed = df.withColumn("close", F.when(F.col("date") >= rows[80][1], 1.0).otherwise(F.col("close")))
    again = {str(r.decision_date): r for r in FE.decision_features(changed).collect()}
    assert again[rows[80][1]] == got[rows[80][1]]


def test_a_late_bar_is_invisible_until_it_arrives(frame, spark):
    df, rows = walk(frame, 120)
    day = [r[1] for r in rows]
    stamped = df.withColumn("available_time", F.when(F.col("date") == day[100], F.lit(f"{day[103]} 23:00:00").cast("timestamp")).otherwise(bar_available_time("date")))
    plain = {str(r.decision_date): r for r in FE.decision_features(df).collect()}
    got = {str(r.decision_date): r for r in FE.decision_features(stamped).collect()}
    assert len(got) == len(plain) == 120
    for i in range(120):
        if i not in (101, 102, 103):
            assert got[day[i]] == plain[day[i]]
    without = {str(r.decision_date): r for r in FE.decision_features(df.filter(F.col("date") != day[100])).collect()}
    assert str(got[day[101]].as_of_date) == day[99] and got[day[101]] == without[day[101]]
    assert got[day[103]] == without[day[103]] and str(got[day[104]].as_of_date) == day[103]
    future = stamped.withColumn("close", F.when(F.col("date") == day[100], 1.0).otherwise(F.col("close")))
    again = {str(r.decision_date): r for r in FE.decision_features(future).collect()}
    assert again[day[102]] == got[day[102]]


def test_total_loss_inside_a_window(frame):
    rows = [("A", d, 10.0, x, None) for d, x in zip(days(20), [0.01] * 10 + [-1.0] + [0.01] * 9)]
    out = FE.raw_features(frame(rows, BARS)).filter(F.col("date") == rows[-1][1]).first()
    assert out.return_20d == -1.0


def test_variant_score_fails_closed_and_weights_add_to_one(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, None, 0.1)], "momentum_20d double, momentum_60d double, trend_50d double, low_volatility double, reversion double")
    got = {r.variant: r for r in FE.variant_scores(df, keys=()).collect()}
    assert got["momentum"].score == pytest.approx(0.5) and got["balanced"].score is None
    assert got["trend_quality"].missing == "low_volatility"
    assert all(abs(sum(abs(w) for w in v.values()) - 1) < 1e-12 for v in FE.VARIANT_WEIGHTS.values())


def test_short_holiday_gap_is_rejected(frame):
    cal = C.trading_calendar(frame([("2024-11-26",), ("2024-11-27",), ("2024-11-29",), ("2024-12-02",), ("2024-12-03",)], "date date"))
    s = frame([(0, "2024-11-26", "2024-11-27", "2024-12-02", "2024-12-03")], "fold int, train_start date, train_end date, test_start date, test_end date")
    row = C.validate_splits(s, cal).first()
    assert (row.gap_sessions, row.verdict) == (1, "PURGE_TOO_SHORT")


def test_splits_purge_and_step(frame):
    cal = C.trading_calendar(frame([(d,) for d in days(300)], "date date"))
    rows = C.make_splits(cal).orderBy("fold").collect()
    d = days(300)
    assert len(rows) == 3 and str(rows[1].train_start) == d[32] and str(rows[0].test_start) == d[185]
    assert {r.verdict for r in C.validate_splits(C.make_splits(cal), cal).collect()} == {"OK"}


def test_threshold_sweep_equals_naive_scan(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(40):
        n = rng.randint(1, 15)
        pts = [(round(rng.uniform(-1, 1), 1), rng.randint(0, 1)) for _ in range(n)]
        rows += [(g, s, y) for s, y in pts]
        cands = [(min(s for s, _ in pts), True)] + [(t, False) for t in sorted({s for s, _ in pts})]
        acc = lambda t, inc: sum((s >= t if inc else s > t) == bool(y) for s, y in pts)
        want[g] = max(cands, key=lambda c: (acc(*c), -c[0], c[1]))
    df = spark.createDataFrame(rows, "g int, score double, y int")
    got = {r.g: (r.threshold, r.inclusive) for r in E.best_thresholds(df, ["g"], label="y").collect()}
    assert got == want


def tagged(spark, n_dates=40, names=5, seed=2, signal=0.0):
    rng = random.Random(seed)
    rows = []
    for i, d in enumerate(days(n_dates)):
        role = "train" if i < n_dates * 3 // 4 else "test"
        for k in range(names):
            y = rng.randint(0, 1)
            rows.append((0, role, d, f"T{k}", y, max(-1.0, min(1.0, rng.gauss(signal if y else -signal, 0.5)))))
    return spark.createDataFrame(rows, "fold int, role string, decision_date string, ticker string, y int, m double").withColumn("decision_date", F.to_date("decision_date"))


def test_permutation_moves_whole_dates_and_keeps_class_balance(spark):
    t = tagged(spark)
    out = E.permute_labels(t.withColumn("y0", F.col("y")), 3, block=4)
    per = out.groupBy("perm", "role").agg(F.sum("y0").alias("a"), F.sum("y_perm").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.a == r.b for r in per) and len(per) == 8
    same = out.filter("perm = 0 AND y0 <> y_perm").count()
    assert same == 0 and out.filter("perm = 1 AND y0 <> y_perm").count() > 0


def study(spark, signal):
    t = tagged(spark, 120, 8, 5, signal)
    rows = E.permute_labels(t, 20, block=10)
    scored = rows.select(F.lit("v").alias("variant"), "perm", "fold", "role", "y_perm", F.col("m").alias("score"))
    keys = ["variant", "perm", "fold"]
    cuts = E.best_thresholds(scored.filter("role = 'train'"), keys)
    test = E.predict(scored.filter("role = 'test'"), cuts, keys)
    res = test.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("y_perm")).alias("correct"), F.sum("y_perm").alias("ones"))
    return E.evaluation_report(res).first()


def test_noise_reads_no_edge_and_a_planted_signal_is_found(spark):
    assert study(spark, 0.0).verdict != "SIGNAL_CANDIDATE"
    found = study(spark, 0.6)
    assert found.verdict == "SIGNAL_CANDIDATE" and found.z_vs_noise > 2


def test_custom_learner_runs_per_group(spark):
    t = tagged(spark, 20, 3).withColumn("y_perm", F.col("y")).withColumn("perm", F.lit(0))
    out = E.fit_predict_groups(t, ["perm", "fold"], ["m"], lambda x, y, tx: (tx["m"] > 0).astype(int))
    assert out.count() == t.filter("role = 'test'").count()


def test_within_date_and_pooled_ic_can_disagree(spark):
    rows = []
    for i, d in enumerate(days(30)):
        for k in range(6):
            rows.append((d, f"T{k}", i / 30 + k * 0.001, i - k * 0.01))
    obs = spark.createDataFrame(rows, "decision_date string, ticker string, c double, excess_log_return double").withColumn("decision_date", F.to_date("decision_date"))
    assert IC.daily_ic(obs, ("c",)).agg(F.avg("ic")).first()[0] < -0.9
    cal = C.trading_calendar(obs.select(F.col("decision_date").alias("date")))
    s = obs.agg(F.min("decision_date").alias("a"), F.max("decision_date").alias("b")).select(F.lit(0).alias("fold"), F.col("a").alias("train_start"), F.col("a").alias("train_end"), F.col("a").alias("test_start"), F.col("b").alias("test_end"))
    assert IC.pooled_ic(obs, cal, s, ("c",)).first().ic > 0.9


def test_constant_side_has_no_ic(spark):
    obs = spark.createDataFrame([("2024-01-02", f"T{k}", 1.0, float(k)) for k in range(4)], "decision_date string, ticker string, c double, excess_log_return double")
    assert IC.daily_ic(obs, ("c",)).first().ic is None


def test_bucketed_running_sums_and_ranks_match_plain_ones(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randint(0, 9), round(rng.uniform(0, 1), 1)) for k in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, v int, x double")
    got = {(r.k, r.i): r.s for r in running_sums(df, ["k"], F.floor(F.col("i") / 7), ["i"], {"s": F.col("v")}).collect()}
    for k in "ab":
        acc = 0
        for _, i, v, _ in [r for r in rows if r[0] == k]:
            acc += v
            assert got[(k, i)] == acc
    ranks = {(r.k, r.i): r.rk for r in average_ranks(df, ["k"], "x", F.floor(F.col("x") * 4), "rk").collect()}
    xs = [r[3] for r in rows if r[0] == "a"]
    for _, i, _, x in rows[:50]:
        assert ranks[("a", i)] == sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2
