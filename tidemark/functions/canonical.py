"""Canonical JSON and content hashes built from columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON object with keys in sorted order; nulls are kept as null."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def digest(**fields: Column) -> Column:
    """sha256 of the canonical JSON of ``fields``."""
    return F.sha2(canonical_json(**fields), 256)


def content_fingerprint(df, columns: list[str]):
    """One row (rows, fingerprint): order independent, so it needs no sort."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in columns])
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("fingerprint"))
