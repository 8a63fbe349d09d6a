"""Quote ingest, latest marks, first fills, bar building and evidence counts.

The result of a job does not depend on how its input was cut into batches, nor
on how late a row came: no watermark drops anything. Jobs that would need
unbounded state keep logs of written batches instead. A batch meets the days it
touches of the earlier log, appends what it found, and a reader folds the
parts; a batch that is tried again replaces its own folder. Jobs whose state is
one row per contract or cluster use a streaming aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.pit import unresolved
from ..operators.quotes import WINDOW_SECONDS, quote_identity, quote_reject_reason, whole_fills
from ..session import run_dir


def run_batches(stream: DataFrame, label: str, step: Callable[[DataFrame, int, str], None]) -> str:
    """Process all available input, each batch by ``step(batch, batch_id, base)``; gives the base folder."""
    base = run_dir(stream.sparkSession, label)
    q = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda batch, n: step(batch, n, base)).start()
    q.awaitTermination()
    return base


def _logged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of a log, with their number; no rows where nothing was written yet."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


# ---- quotes --------------------------------------------------------------------


def judged_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes with their identity and, where they may not be used at receipt, the reason."""
    return quotes.withColumn("reject_reason", quote_reject_reason("available_utc")).withColumn("quote_id", quote_identity())


def ingest_quotes(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every received quote lands in one of two tables, eligible or rejected; both are given, repeats included."""
    judged = judged_quotes(quotes)

    def step(batch: DataFrame, n: int, base: str) -> None:
        batch.persist()
        batch.filter("reject_reason IS NULL").write.mode("overwrite").parquet(f"{base}/eligible/batch={n}")
        batch.filter("reject_reason IS NOT NULL").write.mode("overwrite").parquet(f"{base}/rejected/batch={n}")
        batch.unpersist()

    base = run_batches(judged, "quotes", step)
    spark = quotes.sparkSession
    return tuple(_logged(spark, f"{base}/{part}", judged.schema) for part in ("eligible", "rejected"))


def distinct_books(judged: DataFrame) -> DataFrame:
    """One row per book: the first receipt, whichever batch brought it."""
    rest = [c for c in judged.columns if c not in ("quote_id", "available_utc", "batch")]
    first = judged.groupBy("quote_id").agg(F.min(F.struct("available_utc", *rest)).alias("r"))
    return first.select("quote_id", "r.*")


def latest_marks(quotes: DataFrame) -> DataFrame:
    """Newest eligible quote per contract; state is one row per contract."""
    ok = quotes.filter(quote_reject_reason("available_utc").isNull())
    return ok.groupBy("contract_id").agg(F.max(F.struct("observed_utc", "available_utc", "quote_no", "bid", "ask")).alias("m")).select("contract_id", "m.*")


# ---- fills ---------------------------------------------------------------------


def _fills(orders: DataFrame, quotes: DataFrame, tolerance_seconds: int) -> DataFrame:
    """The first whole fill of each order among these quotes."""
    found = whole_fills(orders, quotes, tolerance_seconds)
    return found.groupBy("order_id").agg(F.min(F.struct("available_utc", "observed_utc", "quote_no", "fill_price")).alias("f")).select("order_id", "f.*")


def first_fills(orders: DataFrame, quotes: DataFrame, tolerance_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(order_id, available_utc, observed_utc, quote_no, fill_price): each order's first whole fill in its window.

    Quotes that may not be used at receipt are dropped before they are kept or
    joined. New orders meet new and logged quotes, logged orders meet new
    quotes, both only on the days around the batch.
    """
    spark = orders.sparkSession
    side = {"o": orders, "q": quotes}
    times = {"o": "submitted_utc", "q": "available_utc"}
    whole = {k: F.struct(*[F.col(c) for c in df.columns]) for k, df in side.items()}
    none = {k: F.lit(None).cast(df.schema) for k, df in side.items()}
    usable = quotes.filter(quote_reject_reason("available_utc").isNull())
    both = orders.select(whole["o"].alias("o"), none["q"].alias("q")).union(usable.select(none["o"].alias("o"), whole["q"].alias("q")))
    schemas = {k: T.StructType([*df.schema.fields, T.StructField("day", T.DateType())]) for k, df in side.items()}

    def step(batch: DataFrame, n: int, base: str) -> None:
        new = {}
        for k in side:
            own = batch.filter(F.col(k).isNotNull()).select(f"{k}.*")
            own.withColumn("day", F.to_date(times[k])).write.mode("overwrite").parquet(f"{base}/{k}/batch={n}")
            new[k] = spark.read.schema(schemas[k]).parquet(f"{base}/{k}/batch={n}")
        days = new["o"].select("day").union(new["q"].select("day")).agg(F.date_sub(F.min("day"), 1).alias("low"), F.date_add(F.max("day"), 1).alias("high")).first()
        old = {k: _logged(spark, f"{base}/{k}", schemas[k]).filter((F.col("batch") < n) & F.col("day").between(F.lit(days.low), F.lit(days.high))).drop("batch") for k in side}
        found = _fills(new["o"].drop("day"), new["q"].union(old["q"]).drop("day"), tolerance_seconds).union(_fills(old["o"].drop("day"), new["q"].drop("day"), tolerance_seconds))
        found.write.mode("overwrite").parquet(f"{base}/fills/batch={n}")

    base = run_batches(both, "fills", step)
    schema = "order_id long, available_utc timestamp, observed_utc timestamp, quote_no long, fill_price double"
    parts = _logged(spark, f"{base}/fills", spark.createDataFrame([], schema).schema)
    return parts.groupBy("order_id").agg(F.min(F.struct("available_utc", "observed_utc", "quote_no", "fill_price")).alias("f")).select("order_id", "f.*")


# ---- bars ----------------------------------------------------------------------


def partial_bars(trades: DataFrame, time: str = "ts", price: str = "value", key: str = "ticker") -> DataFrame:
    """What one batch knows of each (key, day): ends with their times, extremes and count."""
    at = F.struct(F.col(time).alias("at"), F.col(price).alias("price"))
    return trades.groupBy(key, F.to_date(time).alias("date")).agg(F.min(at).alias("first"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(at).alias("last"), F.count("*").alias("trades"))


def bar_vintages(trades: DataFrame, time: str = "ts", price: str = "value", key: str = "ticker") -> DataFrame:
    """Parts of day bars, appended batch by batch; late trades add a vintage and change no earlier one."""

    def step(batch: DataFrame, n: int, base: str) -> None:
        partial_bars(batch, time, price, key).write.mode("overwrite").parquet(f"{base}/bars/batch={n}")

    base = run_batches(trades, "bars", step)
    empty = trades.sparkSession.createDataFrame([], trades.schema)
    return _logged(trades.sparkSession, f"{base}/bars", partial_bars(empty, time, price, key).schema)


def bars_of(vintages: DataFrame, upto: int | None = None, key: str = "ticker") -> DataFrame:
    """Day bars as known after batch ``upto``, by default after the last: open, high, low, close, trades."""
    seen = vintages if upto is None else vintages.filter(F.col("batch") <= upto)
    return seen.groupBy(key, "date").agg(
        F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.sum("trades").alias("trades"), F.max("batch").alias("vintage")
    ).select(key, "date", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "trades", "vintage")


# ---- evidence ------------------------------------------------------------------


def evidence_counts(records: DataFrame) -> DataFrame:
    """Records seen per ticker and lineage cluster; state is one row per cluster."""
    return records.groupBy("ticker_at_time", "lineage_cluster_id").agg(F.count("*").alias("records"))


def confirmed_events(clusters: DataFrame) -> DataFrame:
    """Batch view over the cluster state: confirmed events and unresolved records."""
    return clusters.groupBy("ticker_at_time").agg(
        F.count_if(~unresolved()).alias("confirmed_independent_events"), F.coalesce(F.sum(F.when(unresolved(), F.col("records"))), F.lit(0)).alias("unresolved_count")
    )


def run_available(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an aggregation over all available input; the newest row per key, read back.

    Every batch of changed rows lands in its own folder, so a retried batch replaces itself.
    """
    q_schema = stream.schema
    spark: SparkSession = stream.sparkSession
    base = run_dir(spark, label)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    out = _logged(spark, f"{base}/out", q_schema)
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
