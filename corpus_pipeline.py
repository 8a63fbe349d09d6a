"""The training-data pipeline: from raw documents to packed sequences.

Five stages, each written as Parquet in the shared folder and read again as the
next one's documents. All but the last return the columns of ``documents``.
Rows without doc_id leave at the first stage; rows that share a doc_id go
together, as soon as one of them is rejected or contaminated; an empty table
passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, jaccard, packing, pii, quality
from tidemark.llm.common import read
from tidemark.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """``docs`` whose ids ``verdict`` names."""
    return docs.select(*COLUMNS).join(verdict.select("doc_id").distinct(), "doc_id", "left_semi").select(*COLUMNS)


def _all(verdict: DataFrame, good: str) -> DataFrame:
    """The ids all of whose rows are ``good``."""
    return verdict.groupBy("doc_id").agg(F.bool_and(F.expr(good)).alias("good")).where("good")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, accepts."""
    return _kept(docs, _all(quality.quality_scores(docs, read(spark, sf_dir, "labels")), "predicted = 1"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return _kept(docs, jaccard.jaccard_components(docs).where("doc_id = component_id"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to be contaminated."""
    return _kept(docs, _all(decontaminate.contamination(docs, read(spark, sf_dir, "benchmark")), "not contaminated"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and the new length."""
    hidden = pii.pseudonymised(docs.select(*COLUMNS)).drop("n_entities")
    return hidden.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality", keep_good),
    ("near duplicates", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("personal data", hide_personal_data),
    ("packing", pack),
]

#: Classifier, surrogates and tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
