"""Streaming jobs and stored vintages over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import picks as PK
from ..session import materialize, run_dir
from ..sources import views as V
from ..sources import vintages as VT
from ..streaming import jobs as J
from .picks import ACTION
from .registry import query
from .trading import TOL, reject_sql


class _Streamed:
    """A session whose tables are read as file streams, for the view builders.

    A table is first written again in slices, the newest first, and streamed a
    slice's worth of files per trigger: rows come late and out of order, in
    several batches, whose number does not grow with the table.
    """

    def __init__(self, spark, slices=4):
        self.spark, self.slices = spark, slices
        self.read = self

    def parquet(self, path):
        rows, folder = self.spark.read.parquet(path), run_dir(self.spark, "arrivals")
        order = F.unix_micros(F.col("ts").cast("timestamp")) if "ts" in rows.columns else F.xxhash64(*rows.columns[:3])
        cuts = rows.agg(F.percentile_approx(order, [k / self.slices for k in range(1, self.slices)])).first()[0] or []
        place = F.lit(0)
        for cut in cuts:
            place = place + (order > cut).cast("int")
        placed = rows.withColumn("_slice", place)
        for k in reversed(range(len(cuts) + 1)):
            placed.filter(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(folder)
        files = len(self.spark.read.schema(rows.schema).parquet(folder).inputFiles())
        return self.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(2, -(-files // self.slices))).parquet(folder)


@query(
    "stream_quote_ingest",
    f"SELECT coalesce(reason, 'eligible') AS reason, count(*) AS quotes FROM (SELECT *, {reject_sql('available_utc')} AS reason FROM quotes) GROUP BY 1",
    "quotes",
)
def stream_quote_ingest(spark, sf):
    eligible, rejected = J.ingest_quotes(V.quotes(_Streamed(spark), sf))
    books = J.distinct_books(eligible.union(rejected))
    return books.groupBy(F.coalesce("reject_reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("quotes"))


@query(
    "stream_latest_marks",
    f"""SELECT contract_id, m[1] AS observed_utc, m[3] AS quote_no, m[4] AS bid, m[5] AS ask FROM (SELECT contract_id, max((observed_utc, available_utc, quote_no, bid, ask)) AS m FROM quotes WHERE ({reject_sql('available_utc')}) IS NULL GROUP BY 1)""",
    "quotes",
)
def stream_latest_marks(spark, sf):
    marks = J.latest_marks(V.quotes(_Streamed(spark), sf))
    return J.run_available(marks, "marks", ["contract_id"]).select("contract_id", "observed_utc", "quote_no", "bid", "ask")


@query(
    "stream_first_fills",
    f"""WITH p AS (SELECT o.order_id, o.side, o.quantity, o.limit_price, o.submitted_utc, q.* FROM sim_orders o JOIN quotes q ON o.contract_id = q.contract_id
      AND q.available_utc > o.submitted_utc AND q.available_utc < least(o.submitted_utc + INTERVAL {TOL} SECOND, o.session_close))
    SELECT order_id, f[1] AS fill_utc, f[3] AS fill_quote, f[4] AS fill_price FROM (SELECT order_id, min((available_utc, observed_utc, quote_no, CASE WHEN side = 'BUY' THEN ask ELSE bid END)) AS f FROM p WHERE limit_price > 0 AND ({reject_sql('available_utc')}) IS NULL
      AND CASE WHEN side = 'BUY' THEN ask_utc ELSE bid_utc END >= submitted_utc + INTERVAL 1 SECOND
      AND CASE WHEN side = 'BUY' THEN ask > 0 AND ask <= limit_price AND ask_size >= quantity ELSE bid > 0 AND bid >= limit_price AND bid_size >= quantity END GROUP BY 1)""",
    "quotes sim_orders",
)
def stream_first_fills(spark, sf):
    s = _Streamed(spark)
    fills = J.first_fills(V.orders_to_fill(s, sf), V.quotes(s, sf), TOL)
    return fills.select("order_id", F.col("available_utc").alias("fill_utc"), F.col("quote_no").alias("fill_quote"), "fill_price")


@query(
    "stream_daily_bars",
    "SELECT event_type AS ticker, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS trades FROM events GROUP BY 1, 2",
)
def stream_daily_bars(spark, sf):
    e = V.table(_Streamed(spark), sf, "events").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return J.bars_of(J.bar_vintages(e)).drop("vintage")


@query(
    "stream_evidence_counts",
    """SELECT ticker_at_time, count(DISTINCT lineage_cluster_id) FILTER (WHERE upper(lineage_cluster_id) NOT LIKE 'UNKNOWN%') AS confirmed_independent_events,
    count(*) FILTER (WHERE lineage_cluster_id IS NULL OR upper(lineage_cluster_id) LIKE 'UNKNOWN%') AS unresolved_count FROM evidence GROUP BY 1""",
    "evidence",
)
def stream_evidence_counts(spark, sf):
    counts = J.evidence_counts(V.evidence(_Streamed(spark), sf))
    return J.confirmed_events(J.run_available(counts, "evidence", ["ticker_at_time", "lineage_cluster_id"]))


# ---- stored vintages ---------------------------------------------------------


@query(
    "bar_vintage_store",
    f"""SELECT ticker, CAST(max(v) AS VARCHAR) AS vintage, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume, min(date) AS first_date, max(date) AS last_date FROM (SELECT *, CASE WHEN date <= DATE '1999-12-31' THEN 1 ELSE 2 END AS v FROM sums) GROUP BY 1""",
    "sums",
)
def bar_vintage_store(spark, sf):
    """Two appended vintages per name; the reader keeps the newest per name."""
    sums = materialize(V.daily_sums(spark, sf).select("ticker", "date", "volume"), "sums")
    path = run_dir(spark, "vintages")
    VT.append_vintage(sums.filter(F.col("date") <= F.lit("1999-12-31").cast("date")), path, "1")
    VT.append_vintage(sums, path, "2")
    docs = VT.read_vintage_table(spark, path, "ticker string, date date, volume long").withColumnRenamed("ticker", "file_ticker")
    return VT.latest_vintage(docs).groupBy(F.col("file_ticker").alias("ticker"), "vintage").agg(
        F.count("*").alias("bars"), F.sum("volume").alias("volume"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "dataset_inventory",
    """SELECT 'ds' || doc_id AS dataset_id, lang AS provider, source AS scope, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 43200) AS available_utc, CASE WHEN doc_id % 14 = 0 OR doc_id % 23 = 0 THEN 'INVALID_ARCHIVE' ELSE 'OK' END AS status FROM documents
    WHERE doc_id % 14 = 0 OR doc_id % 23 = 0 OR TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 43200) <= TIMESTAMP '2024-01-20 20:45:00'""",
)
def dataset_inventory(spark, sf):
    return _inventory(spark, sf).select("dataset_id", "provider", "scope", "available_utc", "status")


def _inventory(spark, sf):
    i = F.col("doc_id")
    d = V.table(spark, sf, "documents")
    did = F.concat(F.lit("ds"), i.cast("string"))
    sha = F.when(i % 14 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256))
    m = d.select(
        did.alias("dataset_id"), F.col("lang").alias("provider"), F.col("source").alias("scope"), F.timestamp_seconds(F.lit(1704067200) + i * 7919 % 43200 * 60).alias("available_utc"),
        (F.col("n_chars") + F.when(i % 23 == 0, 1).otherwise(0)).alias("record_count"), F.create_map(F.lit("raw.bin"), sha).alias("files"),
    )
    f = d.select(did.alias("dataset_id"), F.lit("raw.bin").alias("name"), F.col("text").alias("content"), F.col("n_chars").alias("records"))
    return VT.dataset_inventory(m, f, F.lit("2024-01-20 20:45:00").cast("timestamp"))


@query(
    "context_at",
    """SELECT provider, scope, arg_min(dataset_id, (-epoch_us(available_utc), dataset_id)) AS dataset_id, max(available_utc) AS available_utc FROM (SELECT 'ds' || doc_id AS dataset_id, lang AS provider, source AS scope, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 43200) AS available_utc
    FROM documents WHERE doc_id % 14 <> 0 AND doc_id % 23 <> 0) WHERE available_utc <= TIMESTAMP '2024-01-20 20:45:00' GROUP BY 1, 2""",
)
def context_at(spark, sf):
    return VT.context_at(_inventory(spark, sf)).select("provider", "scope", "dataset_id", "available_utc")


@query(
    "pick_action_counts",
    f"SELECT CASE WHEN {ACTION} IN ('ABSTAIN', 'PAPER_LONG_CALL') THEN {ACTION} ELSE 'other' END AS action, count(*) AS n FROM picks GROUP BY 1",
    "picks",
)
def pick_action_counts(spark, sf):
    picks, _, _ = V.picks_inputs(spark, sf)
    return VT.allow_listed_counts(picks, "action", ("ABSTAIN", "PAPER_LONG_CALL"), "other")


@query(
    "export_research",
    f"""SELECT 'inputs' AS part, provenance, count(*) AS rows FROM (SELECT CASE WHEN o.status IS NULL THEN 'NO_OUTCOME' WHEN o.status = 'RESOLVED' AND len(list_distinct(list_slice(ms, 1, fd))) = 1 AND ms[1] = 'MARKET' THEN 'OBSERVED_QUOTES' ELSE 'MODELLED' END AS provenance
    FROM picks p LEFT JOIN outcomes o ON p.decision_date = o.decision_date AND p.variant = o.variant AND p.ticker = o.ticker) GROUP BY 2""",
    "picks outcomes",
)
def export_research(spark, sf):
    picks, b, c = V.picks_inputs(spark, sf)
    out = PK.with_direction(PK.resolve_picks(PK.mark_path(picks, b, c)), PK.direction_labels(b, V.BENCHMARK))
    path = run_dir(spark, "export")
    manifest = VT.export_research(picks, out, path)
    manifest.write.json(f"{path}/manifest")
    inputs = spark.read.schema("row_id string, action string").json(f"{path}/inputs")
    outs = spark.read.schema("row_id string, status string, exit_path_provenance string, exit_return_on_premium double").json(f"{path}/outcomes")
    rows = VT.load_research_rows(inputs, outs)
    return rows.groupBy("provenance").agg(F.count("*").alias("rows")).select(F.lit("inputs").alias("part"), "provenance", "rows")
