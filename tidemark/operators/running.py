"""Running totals and ranks that stay distributed when one key is hot.

A plain window over a key puts all its rows into one task. Here the key is cut
into ordered buckets: totals run inside each bucket in parallel, and only one
summary row per (key, bucket) is ordered globally to carry the offsets over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sums(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list,
    sums: dict[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums named by ``sums``, per key in ``order``.

    ``bucket`` must be non-decreasing along ``order``. With ``totals`` the
    key-wide sums are added as ``<name>_total``.
    """
    src = df.withColumn("_bucket", bucket)
    for name, expr in sums.items():
        src = src.withColumn(f"_v_{name}", expr)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per_bucket = src.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = per_bucket.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *([F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in sums] if totals else []),
    )
    run = src.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in sums])
    joined = run.join(carry, [*keys, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_c_{n}")).alias(n) for n in sums],
        *([F.col(f"{n}_total") for n in sums] if totals else []),
    )


def running_max(df: DataFrame, keys: list[str], bucket: Column, order: list, value: str, name: str) -> DataFrame:
    """Greatest earlier ``value`` per key (the row itself excluded)."""
    src = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = src.groupBy(*keys, "_bucket").agg(F.max(value).alias("_m")).select(*keys, "_bucket", F.max("_m").over(before).alias("_c"))
    run = src.withColumn("_l", F.max(value).over(local))
    return run.join(carry, [*keys, "_bucket"]).select(*df.columns, F.greatest("_l", "_c").alias(name))


def average_ranks(df: DataFrame, keys: list[str], value: str, bucket: Column, name: str) -> DataFrame:
    """Tie-averaged rank of ``value`` per key, through distinct-value counts.

    Ties are counted first, so the ordered pass sees each value once and a long
    run of equal values cannot crowd one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_sums(counts, keys, bucket, [value], {"_upto": F.col("_n")})
    ranks = ranked.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value])
