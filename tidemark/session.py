"""Session factory and the shared-folder helpers used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a few dozen bytes each that may be sent to every executor; counted before each use.
BROADCAST_ROWS = 500_000


def get_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC clocks and adaptive execution.

    On a cluster the master, memory and parallelism come from spark-submit; only
    the semantics this library relies on are pinned here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where the session names none, a run on one machine chooses a temporary
    folder and sets it, so later calls agree on it; a cluster gets an error,
    since executors would each write to a disk of their own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if current:
        return current
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, for stream state or written tables."""
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives executor loss, and lets several
    consumers read one result instead of recomputing it.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition by ``keys`` over all shuffle partitions.

    Takes the place of the exchange a window or grouped map would add anyway.
    Adaptive execution merges small partitions by bytes; long trailing windows
    are small in bytes but heavy in CPU, so their partition count is kept.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def looked_up(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as the smaller side of a join by a key that is unique in it.

    Sent whole if it has at most ``rows`` rows; else both sides are dealt by the key
    and this one is hashed, so that the larger one is never sorted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")
