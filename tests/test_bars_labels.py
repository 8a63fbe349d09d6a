import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import bars as B
from tidemark.operators import labels as L

RAW = "ticker string, date date, close double, volume long, dividend double, split double"


def days(n, start=dt.date(2024, 1, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(str(d))
        d += dt.timedelta(days=1)
    return out


def test_clocks_follow_the_wall_clock_across_daylight_saving(spark):
    row = spark.sql("SELECT date'2024-03-08' a, date'2024-07-01' b").select(
        clock.bar_event_time("a").alias("e"), clock.bar_available_time("a").alias("v"), clock.decision_time("b").alias("d")
    ).first()
    assert (row.e.hour, row.v.day, row.v.hour) == (21, 9, 14)
    assert (row.d.hour, row.d.minute) == (19, 45)


def test_missing_close_breaks_the_chain(frame):
    d = days(4)
    df = frame([("A", d[0], 10.0, 1, None, None), ("A", d[1], None, 1, None, None), ("A", d[2], 12.0, 1, None, None), ("A", d[3], 12.6, 1, 0.6, None)], RAW)
    got = {str(r.date): (r.status, r.daily_total_return) for r in B.normalize_bars(df).collect()}
    assert [got[x][0] for x in d] == ["NO_PRIOR_CLOSE", "UNKNOWN", "NO_PRIOR_CLOSE", "OK"]
    assert got[d[3]][1] == pytest.approx((12.6 + 0.6) / 12 - 1)


def test_nan_close_is_unknown(frame):
    d = days(2)
    df = frame([("A", d[0], float("nan"), 1, None, None), ("A", d[1], 5.0, 1, None, None)], RAW)
    assert [r.status for r in B.normalize_bars(df).orderBy("date").collect()] == ["UNKNOWN", "NO_PRIOR_CLOSE"]


@pytest.mark.parametrize(
    "prev,close,ratio,verdict,status",
    [
        (120.8887, 121.7907, 10.0, "ADJUSTED", "OK"),
        (1208.887, 121.7907, 10.0, "UNADJUSTED", "SPLIT_UNADJUSTED"),
        (100.0, 60.0, 10.0, "ADJUSTED", "OK"),
        (10.0, 100.0, 0.1, "UNADJUSTED", "SPLIT_UNADJUSTED"),
        (100.0, 80.0, 1.25, "IMMATERIAL", "OK"),
        (None, 80.0, 10.0, "UNCHECKABLE", "NO_PRIOR_CLOSE"),
        (100.0, 80.0, -2.0, "UNCHECKABLE", "OK"),
    ],
)
def test_split_guard(frame, prev, close, ratio, verdict, status):
    d = days(2)
    df = frame([("A", d[0], prev, 1, None, None), ("A", d[1], close, 1, None, ratio)], RAW)
    assert B.split_verdicts(df).first().verdict == verdict
    assert B.normalize_bars(df).filter(F.col("date") == d[1]).first().status == status


def bars_of(frame, spec):
    rows = [(t, d, r) for t, rs in spec.items() for d, r in zip(days(len(rs)), rs)]
    return frame(rows, "ticker string, date date, daily_total_return double")


def test_labels_beat_or_miss_the_benchmark(frame):
    b = bars_of(frame, {"SPY": [0.0] * 7, "UP": [0.01] * 7, "DOWN": [-0.01] * 7})
    got = {r.ticker: r for r in L.build_labels(b).filter(F.col("decision_date") == days(1)[0]).collect()}
    assert got["UP"].y == 1 and got["UP"].excess_log_return == pytest.approx(5 * math.log(1.01))
    assert got["DOWN"].y == 0 and got["SPY"].y == 0
    tail = L.build_labels(b).filter((F.col("ticker") == "UP") & (F.col("status") == "INSUFFICIENT_FORWARD_BARS")).count()
    assert tail == 5


def test_gap_in_either_series_is_unresolved(frame):
    b = bars_of(frame, {"SPY": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None], "A": [0.0, 0.01, None, 0.01, 0.01, 0.01, 0.01], "B": [0.0] * 7})
    got = {(r.ticker, str(r.decision_date)): r.status for r in L.build_labels(b).collect()}
    assert got[("A", days(1)[0])] == "RETURN_GAP_UNRESOLVED"
    assert got[("B", days(1)[0])] == "OK" and got[("B", days(2)[1])] == "RETURN_GAP_UNRESOLVED"


def test_total_loss_before_a_gap_decides(frame):
    b = bars_of(frame, {"SPY": [0.0] * 7, "A": [0.0, -1.0, None, 0.0, 0.0, 0.0, 0.0]})
    r = L.build_labels(b).filter((F.col("ticker") == "A") & (F.col("decision_date") == days(1)[0])).first()
    assert r.status == "OK" and r.y == 0 and r.excess_log_return == float("-inf")


def test_delisting_rules(frame):
    ddl = "ticker string, decision_date date, fwd_returns array<double>, bench_returns array<double>, corporate_action_resolved boolean, delisted boolean, delisting_return double"
    z = [0.0] * 5
    rows = [
        ("M", "2024-01-02", [0.01, 0.01], z, True, True, None),
        ("D", "2024-01-02", [0.01, 0.02], z, True, True, -0.5),
        ("C", "2024-01-02", [0.01] * 5, z, False, False, None),
        ("S", "2024-01-02", [0.01] * 3, z, True, False, None),
        ("T", "2024-01-02", [-1.0] + [0.0] * 4, [-1.0] + [0.0] * 4, True, False, None),
    ]
    got = {r.ticker: r for r in L.labels_from_arrays(frame(rows, ddl)).collect()}
    assert got["M"].delisting_return_imputed and not got["M"].usable and got["M"].y == 0
    assert got["D"].usable and got["D"].excess_log_return == pytest.approx(math.log(1.01) + math.log(1.02 * 0.5))
    assert got["C"].status == "CORPORATE_ACTION_UNRESOLVED" and got["S"].status == "INSUFFICIENT_FORWARD_BARS"
    assert got["T"].y == 0


def test_missing_benchmark_gives_no_labels(frame):
    b = bars_of(frame, {"A": [0.01] * 8})
    assert L.usable_against(b, L.build_labels(b)).count() == 0
