"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: white space, or everything in ASCII but letters and digits.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a few dozen bytes each that may be sent to every executor; counted before each use.
BROADCAST_ROWS = 500_000


def words(text: Column, separators: str, fold: bool) -> Column:
    """Words of the whole text in order; null has none. ``fold`` lowers A-Z alone."""
    whole = F.coalesce(text, F.lit(""))
    if fold:
        whole = F.translate(whole, UPPER, LOWER)
    return F.array_remove(F.split(whole, separators), "")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_megabytes(df: DataFrame, column: str) -> float:
    """Size of a text column, for choosing how many groups to deal it into."""
    return (df.agg(F.sum(F.octet_length(column))).first()[0] or 0) / 1e6


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
