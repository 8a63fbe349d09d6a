import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E
from tidemark.operators import evaluate as E
from tidemark.operators import research as RS
from tidemark.operators import technical as TE
from tidemark.sources import vintages as VT
from tidemark.session import shared_dir


def planted(spark, n, seed, flip=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    up = (x[:, 0] - 0.5 * x[:, 1] > 0) ^ (rng.random(n) < flip)
    rows = [(i, float(a), float(b), 0.01 if u else -0.01, 1.0 / n) for i, ((a, b), u) in enumerate(zip(x, up))]
    return spark.createDataFrame(rows, "row_id long, f1 double, f2 double, net_return double, weight double")


def test_challenger_learns_a_planted_rule(spark):
    scored = RS.logistic_challenger(planted(spark, 400, 1), planted(spark, 200, 2), planted(spark, 300, 3), ["f1", "f2"]).collect()
    right = np.mean([(r.probability > 0.5) == (r.net_return > 0) for r in scored])
    assert right > 0.8 and all(0 < r.probability < 1 for r in scored)


def test_calibration_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=300) * 2
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.4 + 0.3 * z)))).astype(float)
    w = np.full(300, 1 / 300)
    a, b = RS.calibration(spark.createDataFrame([(float(p), float(q), float(v)) for p, q, v in zip(z, y, w)], "z double, label double, weight double"))
    p = 1 / (1 + np.exp(-(a + b * z)))
    assert abs((w * (p - y)).sum()) < 1e-8 and abs((w * (p - y) * z).sum() + 0.05 * (b - 1)) < 1e-8
    assert 0.3 < b < 1  # between the free fit and the pull to 1
    few = spark.createDataFrame([(0.0, 1.0, 1.0)], "z double, label double, weight double")
    assert RS.calibration(few)[1] == 1.0


def test_moments_survive_a_large_mean(spark):
    rows = [(1e9 + x, 0.25) for x in (0.0, 1.0, 2.0, 3.0)]
    m = RS.weighted_moments(spark.createDataFrame(rows, "f double, weight double"), ["f"], []).first()
    assert m.mean_f == pytest.approx(1e9 + 1.5) and m.scale_f == pytest.approx(np.sqrt(1.25))
    z = RS.standardize(spark.createDataFrame(rows, "f double, weight double"), spark.createDataFrame([(1e9 + 1.5, 0.05)], "mean_f double, scale_f double"), ["f"])
    assert sorted(round(r.f, 6) for r in z.collect()) == [-10.0, -10.0, 10.0, 10.0]


def test_a_short_segment_gives_no_report(spark):
    rows = [("train",)] * 30 + [("validation",)] * 19 + [("holdout",)] * 25
    row = RS.segment_status(spark.createDataFrame(rows, "role string")).first()
    assert (row.train, row.validation, row.holdout, row.status) == (30, 19, 25, "INSUFFICIENT_ELIGIBLE_DATA")


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        master = "spark://somewhere:7077"

        def get(self, *_):
            return None

        def isDefined(self):
            return False

        def __getattr__(self, _):
            return self

        def __call__(self, *_):
            return self

    with pytest.raises(RuntimeError):
        shared_dir(Nothing())


def test_forest_finds_a_planted_gain(spark):
    rng = np.random.default_rng(5)
    n, names = 160, list(TE.FOREST_FEATURES)
    rows = []
    for t in ("UP", "DOWN"):
        drift = 0.03 if t == "UP" else -0.03
        close = 100 * np.cumprod(1 + drift + rng.normal(size=n) * 0.002)
        for i in range(n):
            rows.append((t, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", float(close[i]), *[float(1 if t == "UP" else -1) + float(rng.normal()) * 0.1 for _ in names]))
    extra = [f for f in names if f != "close"]
    df = spark.createDataFrame([r[:3] + r[3 : 3 + len(extra)] for r in rows], "ticker string, d string, close double, " + ", ".join(f"{f} double" for f in extra)).withColumn("date", F.to_date("d")).drop("d")
    got = {r.ticker: r for r in TE.forest_signals(df, trees=10, depth=4).collect()}
    assert got["UP"].prediction == "BUY" and got["DOWN"].prediction == "HOLD"


def test_forest_of_rows_without_a_gain_holds(spark):
    """Large names move too little to gain 2 % in five bars: all rows are of one class."""
    names = list(TE.FOREST_FEATURES)
    rows = [(f"2024-01-{1 + i:02d}", 100.0, *[float(i + k) for k in range(len(names))]) for i in range(28)]
    df = spark.createDataFrame(rows, "d string, close double, " + ", ".join(f"{f} double" for f in names)).select(F.lit("FLAT").alias("ticker"), F.to_date("d").alias("date"), "close", *names)
    assert tuple(TE.forest_signals(df, trees=3, depth=2).first()) == ("FLAT", "HOLD", 0.0)
    gaps = df.withColumn("rsi", F.lit(None).cast("double"))
    assert tuple(TE.forest_signals(gaps, trees=3, depth=2).first()) == ("FLAT", None, 0.5)


def test_block_permute_moves_whole_blocks(spark):
    df = spark.createDataFrame([("k", i, i) for i in range(10)], "k string, pos long, y long")
    got = [r.y_perm for r in E.block_permute(df, ["k"], "pos", "y", 3).orderBy("pos").collect()]
    assert sorted(got) == list(range(10))
    starts = [i for i in range(10) if i == 0 or got[i] != got[i - 1] + 1]
    assert {got[i] for i in starts} <= {0, 3, 6, 9}


def test_written_vintages_are_read_back(spark, tmp_path):
    bars, chains = tmp_path / "bars", tmp_path / "chains"
    bars.mkdir()
    chains.mkdir()
    day = lambda d, c: {"date": d, "close": c, "status": "OK"}
    write = lambda folder, name, doc: (folder / name).write_text(json.dumps(doc))
    write(bars, "AAA_2024_2025__v1.json", {"ticker": "AAA", "rows": [day("2024-01-02", 1.0)]})
    write(bars, "AAA_2024_2025__v2.json", {"ticker": "AAA", "rows": [day("2024-01-02", 2.0), day("2024-01-03", 3.0)]})
    write(bars, "BBB_2024_2025__v1.json", {"ticker": "BBB", "rows": [day("2024-01-02", 9.0)]})
    write(bars, "notes.json", {"ticker": "CCC", "rows": [day("2024-01-02", 9.0)]})
    docs = VT.read_bar_vintages(spark, str(bars))
    assert {(r.file_ticker, r.files, r.newest_vintage) for r in VT.store_status(docs).collect()} == {("AAA", 2, "2"), ("BBB", 1, "1")}
    rows = VT.explode_rows(VT.latest_vintage(docs)).select("ticker", "vintage", "close").collect()
    assert sorted(map(tuple, rows)) == [("AAA", "2", 2.0), ("AAA", "2", 3.0), ("BBB", "1", 9.0)]
    for stamp, snap, avail in (("1", "2024-03-01T15:00:00+00:00", None), ("2", "2024-03-01T16:00:00+00:00", "2024-03-01T18:00:00+00:00"), ("3", "2024-03-02T15:00:00+00:00", None)):
        write(chains, f"AAA_x__v{stamp}.json", {"underlying": "AAA", "snapshot_time_utc": snap, "available_time": avail, "contracts": []})
    pick = lambda at: [r.vintage for r in VT.read_chains(spark, str(chains), F.lit(at).cast("timestamp")).collect()]
    assert pick("2024-03-01 17:00:00") == ["1"] and pick("2024-03-01 19:00:00") == ["2"] and pick("2024-02-01 00:00:00") == []
    assert sorted((str(r.snapshot_day), r.vintage) for r in VT.chains_by_date(spark, str(chains)).collect()) == [("2024-03-01", "2"), ("2024-03-02", "3")]


def test_upcoming_events(spark):
    rows = [("a", "2024-01-02", "CONFIRMED"), ("b", "2024-01-03", "CANCELLED"), ("c", "2024-02-03", "CONFIRMED"), ("d", "2023-12-31", "CONFIRMED")]
    df = spark.createDataFrame(rows, "id string, t string, status string").withColumn("event_utc", F.col("t").cast("timestamp"))
    assert [r.id for r in VT.upcoming_events(df, F.lit("2024-01-01").cast("timestamp")).collect()] == ["a"]
