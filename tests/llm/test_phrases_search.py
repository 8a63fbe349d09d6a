"""Collocations and ranked search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ALNUM, FOLD
from tests.llm.conftest import some_text
from tidemark.llm import collocations, search


def brute_collocations(docs, support=30, longest=4, most=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        rows, use = [], Counter()
        long = {p: a for p, a in counts.items() if a >= support and len(p) > 1}
        for p, a in long.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    use[p[i : i + k]] = max(use[p[i : i + k]], a)
        for p, a in long.items():
            if not 100 * use[p] >= 80 * a:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_docs(odd_texts):
    rng = random.Random(21)
    fixed = ["new york city", "the quick fox", "a b a b a b", "ÜBER alles gut", "x y z w v"]
    texts = [" ".join(rng.choice(fixed) + rng.choice([" ", ". ", ",", "\t", "\n"]) + some_text(rng, rng.randrange(5), 40) for _ in range(rng.randrange(12))) for _ in range(220)]
    langs = ["en", "de", None, "und", "rare"]
    rows = [(langs[min(i % 7, 4) if i % 50 else 4], t) for i, t in enumerate(texts + odd_texts * 2)]
    return rows + rows[:30]


@pytest.fixture
def tagged(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "lang string, text string")
        return df.selectExpr("cast(null as long) AS doc_id", "lang", "text", "1 AS n", "2 AS f", "3 AS k", "4 AS h", "5 AS total", "6 AS local")

    return make


@pytest.mark.parametrize("settings", [{}, {"support": 5, "shard_bytes": 400}, {"support": 2, "shard_bytes": 2_000, "most": 7}, {"support": 3, "longest": 2}])
def test_collocations_equal_brute_force(tagged, odd_texts, settings):
    """Small shards lower the local support to one or a few; one shard mines at the full support."""
    rows = phrase_docs(odd_texts)
    got = sorted(tuple(r) for r in collocations.collocations(tagged(rows).repartition(3), **settings).collect())
    own = {k: v for k, v in settings.items() if k != "shard_bytes"}
    assert got == brute_collocations(rows, **own)
    assert len(got) > 5


def test_collocations_of_nothing(tagged):
    assert collocations.collocations(tagged([])).count() == 0
    assert collocations.collocations(tagged([("en", None), ("en", "")])).count() == 0


def test_shards_hold_every_word_once(tagged, odd_texts):
    rows = phrase_docs(odd_texts)
    stored = collocations.shards(tagged(rows), 500)
    got = {r.lang: r.n for r in stored.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    want = Counter()
    for lang, text in rows:
        want[lang or "und"] += len(re.findall("[^ \t.,;:!?\n\x0b\x0c\r]+", text or ""))
    assert got == {k: v for k, v in want.items() if v}
    assert stored.count() > 20


def test_bitmap_flags_what_it_holds(spark):
    rng = random.Random(2)
    values = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    bitmap = collocations.bitmap_of(spark.createDataFrame([(v,) for v in values], "h long"))
    assert collocations.flagged(bitmap, np.array(values, np.int64).view(np.uint64)).all()
    assert np.unpackbits(bitmap).sum() == len({(v % (1 << 64)) >> 38 for v in values})


def brute_search(docs, items, most=10):
    """item -> ranked (doc_id, score)."""
    held = [(d, Counter(ALNUM.findall((t or "").translate(FOLD)))) for d, t in docs if d is not None]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    terms = defaultdict(set)
    for item, text in items:
        if item is not None:
            terms[item] |= set(ALNUM.findall((text or "").translate(FOLD)))
    out = {}
    for item, own in terms.items():
        rows = []
        for d, c, n in held:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score:
                rows.append((-score, d))
        if rows:
            out[item] = [(d, -s) for s, d in sorted(rows)[:most]]
    return out


def test_search_equals_brute_force(spark, documents, odd_texts):
    rng = random.Random(31)
    items = [(i, some_text(rng, n, 60)) for i, n in enumerate((1, 3, 20, 70, 200, 0))] + [(9, None), (10, "no such words"), (0, "w1 W2 w3-w4"), (None, "w5"), (11, "Same same; ünïcode")]
    texts = [some_text(rng, rng.randrange(120), rng.choice((20, 60, 5000))) for _ in range(300)] + odd_texts
    docs = [(i * 5 % 311, t) for i, t in enumerate(texts)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)] + [(None, "w1 w2 w3")]  # ties between copies
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 AS doc_id", "2 AS score", "3 AS terms", "4 AS item")
    want = brute_search(docs, items)
    for settings in ({}, {"most_items": 2, "block_docs": 7}, {"most": 3}):
        got = defaultdict(list)
        for r in sorted(search.ranked(documents(docs).repartition(3), table, **settings).collect(), key=lambda r: (r.item_id, r.rank)):
            got[r.item_id].append((r.doc_id, r.score))
            assert r.rank == len(got[r.item_id])
        assert got == {k: v[: settings.get("most", 10)] for k, v in want.items()}


def test_search_of_nothing(spark, documents):
    table = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.ranked(documents([]), table).count() == 0
    assert search.ranked(documents([(1, None), (2, "!")]), table).count() == 0
    assert search.ranked(documents([(1, "a")]), table.limit(0)).count() == 0


def test_masks_are_finished_early():
    """Documents with all terms come first; masks that cannot reach them are never scored."""
    present = np.zeros((70, 1000), bool)
    present[:, :20] = True
    present[3, 20:] = True
    group, one = search.mask_groups(present)
    assert len(one) == 2 and len({tuple(present[:, i]) for i in one}) == 2
    assert all(len(set(group[part])) == 1 for part in (slice(0, 20), slice(20, None)))
    best = search.Best(10)
    scored = search.rank_block(best, np.arange(1000), present * 500_000, np.ones(70, np.int64))
    assert scored == search.EVALUATED and best.doc.tolist() == list(range(10))
    assert search.rank_block(best, np.arange(1000), present[:, 20:] * 100, np.ones(70, np.int64)) == 0


def test_a_bucket_is_added_up_in_parts(monkeypatch):
    monkeypatch.setattr(collocations, "ADDED_ROWS", 3)
    rng = random.Random(3)
    want, rows = Counter(), []
    for _ in range(9):
        tally = collocations.Tally(0)
        tally.bits = 1
        own = [("de" if rng.random() < 0.5 else "en", f"w{rng.randrange(6)}", rng.randrange(1, 5)) for _ in range(4)]
        for lang, phrase, n in own:
            want[lang, phrase] += n
            list(tally.add(lang, pa.array([phrase]), 1, np.array([n]), np.array([0], np.uint64)))
        rows += [p for b in tally.flush() for p in b.column("packed").to_pylist()]
    got = collocations._added_up(pd.DataFrame({"packed": rows}), 5)
    assert {(r.lang, r.phrase): r.f for r in got.itertuples()} == {k: n for k, n in want.items() if n >= 5}


def test_repeated_shards_send_little_more(tagged, monkeypatch):
    """A task adds up its shards before it names or counts anything: eight times the text in one task is far less than eight times the bytes."""
    sent, spread = [], collocations.spread

    def noted(df, *keys):
        sent[-1] += df.agg(F.sum(F.length("packed"))).first()[0] or 0
        return spread(df, *keys)

    monkeypatch.setattr(collocations, "spread", noted)
    rng = random.Random(8)
    rows = [("en", some_text(rng, 200, 300)) for _ in range(40)]
    for times in (1, 8):
        sent.append(0)
        assert collocations.frequent_phrases(tagged(rows * times).coalesce(1), support=3 * times, shard_bytes=20_000)[0].count() > 20
    assert sent[1] < 2 * sent[0]


@pytest.mark.parametrize("support", [1, 30, 300, 100_000])
def test_names_add_up_to_the_support(support):
    """Tasks that send early and late, counts far beyond a byte, first and last hashes of a bucket."""
    rng = np.random.default_rng(support)
    bits, fine, want, rows = 3, 27, Counter(), defaultdict(list)
    ends = np.array([0, (1 << 64) - 1, 1 << 61, (1 << 61) - 1], np.uint64)
    for _ in range(4):
        names = collocations.Names(bits, fine, support, most=60)
        for _ in range(5):
            hashes = np.unique(np.r_[ends, rng.integers(0, 1 << 64, 5, np.uint64), (rng.integers(0, 40, 30).astype(np.uint64) << np.uint64(58))])
            counts = rng.integers(1, max(2, support // 6), len(hashes))
            for h, n in zip(hashes.tolist(), counts.tolist()):
                want[h >> (64 - fine)] += n
            for batch in [*names.add(hashes, counts), *names.flush()]:
                for r in batch.to_pylist():
                    rows[r["bucket"]].append(r["packed"])
    got = [h for k, packed in rows.items() for h in collocations._reached(pd.DataFrame({"bucket": k, "packed": packed}), bits, fine, support)["h"]]
    assert sorted((h % (1 << 64)) >> (64 - fine) for h in got) == sorted(k for k, n in want.items() if n >= support)


def test_phrases_as_numbers_keep_their_words(monkeypatch):
    """Tasks number their words each for itself and anew; counts, languages and words come back."""
    monkeypatch.setattr(collocations, "NUMBERED", 12)
    monkeypatch.setattr(collocations, "ADDED_ROWS", 20)
    rng, bits = random.Random(5), 2
    want, rows = Counter(), defaultdict(list)
    words = [f"w{i}" for i in range(12)] + ["über", "中", "a\u00a0b", "|", "\x1f"]
    for _ in range(6):
        tally = collocations.Tally(bits, most=15)
        for _ in range(6):
            out = list(tally.restart())
            lang, n, k = rng.choice(["de", "en", "x y"]), rng.randrange(1, 12), rng.randrange(1, 5)
            phrases = [" ".join(rng.choice(words) for _ in range(k)) for _ in range(n)]
            counts = [rng.choice((1, 2, 300, 70_000)) for _ in range(n)]
            hashes = np.array([int.from_bytes((p * 4).encode()[:3], "big") * 0x9E3779B97F4A7C15 % (1 << 64) for p in phrases], np.uint64)
            for p, f in zip(phrases, counts):
                want[lang, p, k] += f
            out += list(tally.add(lang, pa.array(phrases), k, np.array(counts), hashes))
            for batch in [*out, *(tally.flush() if rng.random() < 0.3 else [])]:
                for r in batch.to_pylist():
                    rows[r["bucket"]].append(r["packed"])
        for batch in tally.flush():
            for r in batch.to_pylist():
                rows[r["bucket"]].append(r["packed"])
    found = pd.concat([collocations._added_up(pd.DataFrame({"packed": p}), 4) for p in rows.values()])
    assert {(r.lang, r.phrase, r.k): r.f for r in found.itertuples()} == {k: n for k, n in want.items() if n >= 4}
    assert len(found) == sum(n >= 4 for n in want.values()) and len(rows) > 1
