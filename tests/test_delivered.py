"""Documents and bars as providers deliver them."""

import json

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import ingest as I


def filings(n, **more):
    recent = {c: [f"{c}-{i}" for i in range(n)] for c in I.FILINGS}
    recent["acceptanceDateTime"] = [f"2024-03-0{i + 1}T16:31:00.000Z" for i in range(n)]
    return {"filings": {"recent": recent | more}}


def test_filings_are_read_from_their_recent_list(spark):
    docs = {"good": json.dumps(filings(2)), "bare": json.dumps(filings(2)["filings"]["recent"]), "short": json.dumps(filings(2, form=["10-K"])), "none": json.dumps(filings(0)), "text": "not json", "null": None}
    rows = I.normalize_filings(spark.createDataFrame(list(docs.items()), "doc string, payload string")).collect()
    by = {d: [r for r in rows if r.doc == d] for d in docs}
    assert [r.accessionNumber for r in by["good"]] == ["accessionNumber-0", "accessionNumber-1"]
    assert [str(r.accepted_utc) for r in by["good"]] == ["2024-03-01 16:31:00", "2024-03-02 16:31:00"]
    assert {r.coverage for r in by["good"]} == {"RECENT_SUBMISSIONS_ONLY"} and {r.usage for r in by["good"]} == {"CONTEXT_ONLY"}
    assert [(r.reject_reason, r.coverage) for d in ("bare", "text", "null") for r in by[d]] == [("INVALID_RESPONSE", None)] * 3
    assert [r.reject_reason for r in by["short"]] == ["INCONSISTENT_ARRAYS"]
    assert [(r.reject_reason, r.form) for r in by["none"]] == [(None, None)]


def test_macro_observations_repeat_the_vintage_asked_for(spark):
    page = lambda n, count: json.dumps({"count": count, "observations": [{"date": "2024-01-01", "value": str(i), "realtime_start": "a", "realtime_end": "b"} for i in range(n)]})
    df = spark.createDataFrame([("ok", page(2, 2), "2024-05-01"), ("cut", page(2, 3), "2024-05-02")], "doc string, payload string, asked string")
    rows = I.normalize_macro_vintages(df.withColumn("asked", F.to_date("asked")), vintage="asked").collect()
    assert [(r.doc, str(r.requested_vintage), r.reject_reason) for r in rows if r.doc == "ok"] == [("ok", "2024-05-01", None)] * 2
    assert [(r.requested_vintage, r.reject_reason) for r in rows if r.doc == "cut"] == [(None, "INCOMPLETE_RESPONSE")]
    assert "asked" not in rows[0].asDict() and I.normalize_macro_vintages(df.drop("asked")).first().requested_vintage is None


def test_rows_that_name_no_contract_are_counted_apart(spark):
    rows = [("CALL", "2024-02-15", 10.0, "OK"), ("PUT", "2024-09-15", 10.0, "UNKNOWN"), ("X", "2024-02-15", 10.0, "OK"), ("CALL", None, 10.0, "OK"), ("CALL", "2024-02-15", None, "OK"), (None, "2024-02-15", 1.0, "OK")]
    df = spark.createDataFrame(rows, "kind string, expiration string, strike double, status string").selectExpr("'a' AS ticker", "kind", "to_date(expiration) AS expiration", "strike", "status", "DATE '2024-01-10' AS snapshot_date")
    r = I.chain_snapshot_stats(df, ["ticker"]).first()
    assert (r.contract_count, r.usable_quotes, r.contracts_in_entry_band, r.unreadable_rows) == (2, 1, 1, 4)


def test_bars_keep_their_prices_and_the_split_they_contradict(spark):
    rows = [("a", "2024-01-02", 100.0, 1.0), ("a", "2024-01-03", 50.0, 2.0), ("a", "2024-01-04", None, 3.0)]
    df = spark.createDataFrame(rows, "ticker string, date string, close double, open double").selectExpr("ticker", "to_date(date) AS date", "close", "open", "1L AS volume", "0.0D AS dividend", "CASE WHEN date = '2024-01-03' THEN 2.0D END AS split")
    got = B.normalize_bars(df).orderBy("date").collect()
    assert [r.open for r in got] == [1.0, 2.0, None] and [r.high for r in got] == [None] * 3
    assert [(r.status, r.split_ratio) for r in got] == [("NO_PRIOR_CLOSE", None), ("SPLIT_UNADJUSTED", 2.0), ("UNKNOWN", None)]
    assert got[1].reason == "a split of 2.00 was announced and the close moved by a factor of 0.5000"
