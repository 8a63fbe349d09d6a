"""The pipeline's stages on a small corpus with planted cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import cases
from tests.llm.conftest import some_text


def _good(rng):
    return " ".join(rng.choice(("the", "of", "river", "mountain", "and", "walked.", "slowly,", "along", "Then", "evening", "to", "house")) + ("" if rng.random() < 0.7 else f" place{rng.randrange(10**6)}") for _ in range(rng.randrange(60, 200)))


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(15)
    good = [_good(rng) for _ in range(80)]
    bad = [" ".join(f"X{rng.randrange(99)}!!" for _ in range(100)) for _ in range(40)]
    leak = some_text(rng, 60, 10**6)
    texts = good + bad + [good[3], good[4] + " more", leak + " and the river.", "Then ask ann.7@mail.example.com of the house. " + _good(rng), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict(enumerate(texts)), leak


def test_each_stage_does_its_part(spark, corpus, tmp_path):
    path, texts, leak = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = {r.doc_id: r.asDict() for r in docs.collect()}
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    quality, near, clean, hidden, packed = seen.values()
    assert not set(range(80, 120)) & set(quality) and len(set(range(80)) - set(quality)) <= 2
    want = cases.near_duplicates([(d, r["text"]) for d, r in quality.items()])
    assert set(near) == {d for d, (_, c) in want.items() if c == d}
    judged = cases.contamination([(d, r["text"]) for d, r in near.items()], [(0, leak)])
    assert set(clean) == {d for d, v in judged.items() if not v[3]} and 122 not in clean
    assert set(hidden) == set(clean)
    assert all(hidden[d]["text"] == texts[d] for d in hidden if d != 123)
    assert "ann.7" not in hidden[123]["text"] and hidden[123]["n_chars"] == len(hidden[123]["text"])
    assert set(packed) == set(hidden)


def test_run_equals_the_stages(spark, corpus):
    path, _, _ = corpus
    got = corpus_pipeline.run(spark, path)
    assert got.select("sequence_id", "offset").distinct().count() == got.count() > 0
    assert got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_rows_of_one_id_go_together(spark, corpus):
    path, texts, leak = corpus
    rows = [(207, texts[0]), (207, leak + " " + texts[1]), (208, texts[2]), (208, texts[2]), (209, texts[100]), (209, texts[5]), (None, texts[6]), (210, texts[7])]
    extra = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    docs = spark.read.parquet(f"{path}/documents.parquet").unionByName(extra).selectExpr("*", "1 AS item_id", "2 AS predicted", "3 AS contaminated", "4 AS good")
    kept = lambda stage: sorted(r.doc_id for r in stage(spark, docs, path).where("doc_id > 200").collect())
    assert kept(corpus_pipeline.keep_uncontaminated) == [208, 208, 209, 209, 210]
    assert kept(corpus_pipeline.keep_good) == [207, 207, 208, 208, 210]
    assert corpus_pipeline.keep_good(spark, docs, path).where("doc_id is null").isEmpty()


def test_empty_table_passes_every_stage(spark, corpus, tmp_path):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/empty{k}")
        docs = spark.read.parquet(f"{tmp_path}/empty{k}")
        assert docs.count() == 0


def test_registered():
    names = {m[1] for n in entry.queries() if (m := re.match(r"op(\d+)_", n))}
    assert names == {str(i) for i in range(1, 14)} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
