"""Decontamination, near duplicates and substring dedup against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from tests.llm import cases
from tests.llm.conftest import some_text
from tidemark.llm import decontaminate, jaccard, substrings
from tidemark.llm.components import components


def test_contamination_equals_brute_force(spark, documents, odd_texts):
    rng = random.Random(2)
    items = [(i, some_text(rng, n)) for i, n in enumerate((40, 13, 14, 5, 1, 0, 300))] + [(7, None), (8, "W1 w2,w3"), (9, "w1-w2 W3"), (None, "w9"), (10, "no such words anywhere in it at all")]
    docs = [(i, t) for i, t in enumerate(odd_texts)]
    docs += [(100 + i, some_text(rng, rng.randrange(80)) + " " + (rng.choice(items[:7])[1] or "") + " " + some_text(rng, rng.randrange(400))) for i in range(60)]
    docs += [docs[-1], (None, items[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3)).withColumn("offset", F.lit(1))
    got = [(r.doc_id, (r.n_words, r.n_hit, r.items_sha256, r.contaminated), r.n_items) for r in decontaminate.contamination(documents(docs), table).collect()]
    want = cases.contamination([d for d in docs if d[0] is not None], items)
    assert len(got) == len(docs) - 1
    assert dict(g[:2] for g in got) == want
    assert all((g[2] == 0) == (g[1][1] == 0) for g in got)


def test_contamination_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents([]), none).count() == 0
    row = decontaminate.contamination(documents([(1, "some words")]), none).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


def test_proximity_ignores_order_and_needs_all_terms(spark, documents):
    docs = documents([(1, "x b y a z c"), (2, "a b q q q q q q c"), (3, "c b a"), (4, "a b")])
    items = spark.createDataFrame([(5, "a b c")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.start) for r in decontaminate.proximity_matches(docs, items, 5).collect()}
    assert found == {(1, 5, 1), (3, 5, 0)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root if find(x) != x or any(find(y) == x and y != x for y in root)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _family(rng, base, n):
    words = base.split(" ")
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randrange(7)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(9)}"
        out.append(" ".join(own[rng.randrange(3) :]))
    return out


def test_near_duplicates_equal_brute_force(documents, odd_texts):
    rng = random.Random(4)
    texts = [t for n in (3, 6, 40, 150) for t in _family(rng, some_text(rng, n, 10**6), 40)] + odd_texts + [some_text(rng, 60) for _ in range(20)] + ["a b", "A\tB", "a b c d e"]
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])]
    want = cases.near_duplicates([d for d in docs if d[0] is not None])
    for unit, megabytes in ((jaccard.UNIT, jaccard.BUCKET_MB), (1500, 0.05)):  # the second splits trees and buckets
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(docs), unit, megabytes).collect()}
        assert got == want


def test_repeated_rows_link_no_more_than_single_ones(documents):
    rng = random.Random(11)
    base, other = some_text(rng, 150, 10**6).split(), some_text(rng, 150, 10**6).split()
    half = " ".join(base[:115] + some_text(rng, 35, 10**6).split())  # Jaccard about 0.6
    docs = [(1, " ".join(base))] * 2 + [(2, half)] + [(3, " ".join(other))] * 2 + [(4, " ".join(other[:60] + some_text(rng, 90, 10**6).split()))] * 3
    docs += [(5, " ".join(base[:147] + ["x", "y", "z"])), (6, "a b c d e"), (6, " ".join(base))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(docs)).collect()}
    chosen = {"a b c d e": 1, " ".join(base): 146}  # of document 6 one text counts, by digest
    six = next(t for t, n in chosen.items() if n == got[6][0])
    assert got == cases.near_duplicates([d for d in docs[:-2]] + [(6, six)])
    assert got[1][1] == got[5][1] == 1 and [got[i][1] for i in (2, 3, 4)] == [2, 3, 4]


def test_near_duplicates_of_an_empty_table(documents):
    assert jaccard.jaccard_components(documents([])).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(documents([(5, None)])).collect()] == [(5, 0, 5)]


def test_substrings_equal_brute_force(documents, odd_texts):
    rng = random.Random(5)
    passages = [some_text(rng, 40, 30) for _ in range(4)]
    texts = [some_text(rng, rng.randrange(9), 10**6) + " " + rng.choice(passages) + " " + some_text(rng, 9, 10**6) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts + odd_texts + texts[:5] + odd_texts)]
    want = cases.deduplicated(docs)
    for settings in ((), (0.05, 20, 1)):  # the second splits hot minimisers
        rows = substrings.substring_digests(documents(docs + [docs[3], (None, texts[0])]), *settings).collect()
        assert len(rows) == len(docs) + 1
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want


def test_substrings_of_an_empty_table(documents):
    assert substrings.substring_digests(documents([])).count() == 0
    row = substrings.substring_digests(documents([(1, None)])).first()
    assert tuple(row) == (1, 0, 0, hashlib.sha256(b"").hexdigest())
