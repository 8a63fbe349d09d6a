"""Immutable vintages: reading, choosing, appending and exporting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.canonical import content_fingerprint
from ..functions.guards import zoned_timestamp
from ..operators.asof import exact_once

BAR_ROWS = "array<struct<date:date,open:double,high:double,low:double,close:double,volume:bigint,dividend:double,split:double,daily_total_return:double,status:string>>"
BAR_DOC = f"ticker string, vintage_id string, ingested_time string, source string, rows {BAR_ROWS}"
CONTRACT = "array<struct<contract_symbol:string,type:string,expiration:date,strike:double,bid:double,ask:double,mid:double,volume:bigint,open_interest:bigint,implied_volatility:double,status:string>>"
CHAIN_DOC = f"underlying string, snapshot_time_utc string, available_time string, vintage_id string, contracts {CONTRACT}"


def _named(docs: DataFrame) -> DataFrame:
    """Ticker and vintage from ``TICKER_...__vSTAMP.json``; other names are ignored."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    head, stamp = F.split_part(stem, F.lit("__v"), F.lit(1)), F.regexp_extract(stem, r"__v(.*)$", 1)
    return docs.select("*", F.upper(F.split_part(head, F.lit("_"), F.lit(1))).alias("file_ticker"), stamp.alias("vintage"), stem.alias("file_stem")).filter(F.col("file_stem").contains("__v"))


def read_bar_vintages(spark: SparkSession, path: str) -> DataFrame:
    """One row per vintage document; rows stay nested until one is chosen."""
    return _named(spark.read.schema(BAR_DOC).option("multiLine", True).json(path))


def latest_vintage(docs: DataFrame, key: str = "file_ticker") -> DataFrame:
    """Newest vintage per key. The winner is found on names, then its document is kept."""
    newest = docs.groupBy(key).agg(F.max("vintage").alias("vintage"))
    return docs.join(newest, [key, "vintage"], "left_semi")


def explode_rows(docs: DataFrame, key: str = "file_ticker") -> DataFrame:
    return docs.select(F.col(key).alias("ticker"), "vintage", F.explode("rows").alias("r")).select("ticker", "vintage", "r.*").filter(F.col("date").isNotNull())


def read_chains(spark: SparkSession, path: str, cutoff: Column | None = None) -> DataFrame:
    """Newest snapshot per underlying whose known times all lie at or before ``cutoff``."""
    docs = _named(spark.read.schema(CHAIN_DOC).option("multiLine", True).json(path))
    docs = docs.withColumn("snapshot_utc", zoned_timestamp("snapshot_time_utc")).withColumn("available_utc", zoned_timestamp("available_time"))
    if cutoff is not None:
        known = F.col("available_time").isNull() | (F.col("available_utc") <= cutoff)
        docs = docs.filter((F.col("snapshot_utc") <= cutoff) & F.coalesce(known, F.lit(False)))
    return latest_vintage(docs)


def chains_by_date(spark: SparkSession, path: str) -> DataFrame:
    """Per underlying and UTC snapshot day, the latest vintage of that day."""
    docs = _named(spark.read.schema(CHAIN_DOC).option("multiLine", True).json(path))
    docs = docs.withColumn("snapshot_day", F.to_date(F.substring("snapshot_time_utc", 1, 10))).filter(F.col("snapshot_day").isNotNull())
    newest = docs.groupBy("file_ticker", "snapshot_day").agg(F.max("vintage").alias("vintage"))
    return docs.join(newest, ["file_ticker", "snapshot_day", "vintage"], "left_semi")


def append_vintage(df: DataFrame, path: str, vintage: str) -> None:
    """Write one vintage once. An existing vintage is an error, never overwritten."""
    df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/vintage={vintage}")


def read_vintage_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All vintages of a table written by ``append_vintage``; the vintage prunes."""
    return spark.read.schema(f"{schema}, vintage string").parquet(path)


def store_status(docs: DataFrame) -> DataFrame:
    return docs.groupBy("file_ticker").agg(F.count("*").alias("files"), F.max("vintage").alias("newest_vintage"))


# Fields of the decision side and of the outcome side of an export.
INPUT_FIELDS = ("decision_date", "variant", "ticker", "action", "direction", "reason", "composite_score", "contract_symbol", "entry_fill", "selection_policy")
OUTCOME_FIELDS = ("status", "exit_trigger", "exit_date", "days_held", "exit_price", "exit_mark_method", "exit_path_provenance", "exit_return_on_premium", "horizon_date", "underlying_move_pct", "direction_correct")


def export_research(picks: DataFrame, outcomes: DataFrame, path: str) -> DataFrame:
    """Write inputs and outcomes apart, keyed by row id; return the manifest.

    Rows are de-duplicated by id before writing; the manifest carries counts and
    an order-independent fingerprint of each side.
    """
    keys = ["decision_date", "variant", "ticker"]
    rid = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    inputs = exact_once(picks.select(rid.alias("row_id"), *INPUT_FIELDS), ["row_id"], [F.col("action")])
    outs = exact_once(outcomes.select(rid.alias("row_id"), *OUTCOME_FIELDS), ["row_id"], [F.col("status")])
    inputs.write.mode("errorifexists").json(f"{path}/inputs")
    outs.write.mode("errorifexists").json(f"{path}/outcomes")
    spark = picks.sparkSession
    parts = []
    for name, d in (("inputs", inputs), ("outcomes", outs)):
        back = spark.read.schema(d.schema).json(f"{path}/{name}")
        parts.append(content_fingerprint(back, d.columns).select(F.lit(name).alias("part"), "rows", "fingerprint"))
    return parts[0].unionByName(parts[1])


def load_research_rows(inputs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Inputs with their outcome; a row id with two outcomes is flagged, not picked."""
    per = outcomes.groupBy("row_id").agg(F.count("*").alias("n_outcomes"), F.min("status").alias("status"), F.min("exit_path_provenance").alias("path"), F.min("exit_return_on_premium").alias("net_return"))
    j = inputs.join(per, "row_id", "left")
    provenance = F.when(F.col("n_outcomes") > 1, "DUPLICATE_OUTCOMES").when(F.col("status").isNull(), "NO_OUTCOME").when(F.col("path") == "OBSERVED_ONLY", "OBSERVED_QUOTES").otherwise("MODELLED")
    return j.select(*inputs.columns, "status", "net_return", provenance.alias("provenance"))


def dataset_inventory(manifests: DataFrame, files: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Archives whose file checksums and record counts match; others are invalid.

    ``manifests``: dataset_id, provider, scope, available_utc, record_count,
    files (map name -> sha256). ``files``: dataset_id, name, content, records.
    """
    want = manifests.select("dataset_id", "provider", "scope", "available_utc", "record_count", F.explode("files").alias("name", "sha"))
    have = files.select("dataset_id", "name", F.sha2(F.col("content").cast("binary"), 256).alias("found"), "records")
    per = want.join(have, ["dataset_id", "name"], "left").groupBy("dataset_id", "provider", "scope", "available_utc", "record_count").agg(
        F.count_if(~F.coalesce(F.col("sha") == F.col("found"), F.lit(False))).alias("bad_files"), F.max("records").alias("records")
    )
    status = F.when((F.col("bad_files") > 0) | ~F.coalesce(F.col("records") == F.col("record_count"), F.lit(False)), "INVALID_ARCHIVE").otherwise("OK")
    out = per.select("dataset_id", "provider", "scope", "available_utc", "record_count", status.alias("status"))
    return out if cutoff is None else out.filter((F.col("status") != "OK") | (F.col("available_utc") <= cutoff))


def context_at(inventory: DataFrame) -> DataFrame:
    """Latest valid dataset per (provider, scope)."""
    ok = inventory.filter(F.col("status") == "OK")
    return exact_once(ok, ["provider", "scope"], [-F.unix_micros("available_utc"), F.col("dataset_id")])


def upcoming_events(events: DataFrame, cutoff: Column, days: int = 10) -> DataFrame:
    """Events inside the next ``days``, cancelled ones left out."""
    return events.filter((F.col("status") != "CANCELLED") & (F.col("event_utc") >= cutoff) & (F.col("event_utc") <= cutoff + F.expr(f"INTERVAL '{days}' DAY")))


def allow_listed_counts(df: DataFrame, column: str, allowed: tuple[str, ...], other: str) -> DataFrame:
    return df.groupBy(F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(other).alias(column)).agg(F.count("*").alias("n"))
