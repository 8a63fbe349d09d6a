"""Top-k inner products and packing."""

import math
import random
import time
import zlib

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import packing, topk


def _top(rows, k=5, every=50):
    clean = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in {i for i, _ in clean if i % every == 0}:
        own = min(v for i, v in clean if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in clean if i != q and len(v) == len(own))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


def test_top_products_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(20)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(2000, None), (2001, []), (2050, [1.0, None]), (2100, [float("nan")] * 20), (2150, [float("inf")] * 20), (None, rows[0][1])]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3050, [0.0, 0.0]), rows[100], (150, [0.5] * 20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS score", "3 AS dim")
    got = {tuple(r) for r in topk.top_products(table).collect()}
    assert got == _top(rows)
    assert topk.top_products(table.limit(0)).count() == 0


def test_a_block_prunes_without_loss():
    rng = np.random.default_rng(12)
    v = (rng.normal(size=(3000, 24)) * rng.lognormal(size=(3000, 1)) * 256).astype(np.int64)
    ids, own = np.arange(40), np.arange(3000)
    axes = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1]
    got = set(topk.best_of_block(ids, v[:40], np.full(40, -np.inf), own, v, axes, 5))
    want = set()
    for q in range(40):
        scored = sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:5]
        want |= {(q, i, -s) for s, i in scored}
    assert got == want


def test_block_pairs_stay_in_tasks_of_their_own(spark, monkeypatch):
    rng, seen, first = random.Random(15), [], topk._first
    table = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "_first", lambda found, k: (seen.append(found.rdd.getNumPartitions()), first(found, k))[1])
    topk.top_products(table)
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 2


def test_products_past_doubles_keep_their_last_digits(spark):
    rng = random.Random(16)
    rows = [(i, [2.0**22 + rng.randrange(3), rng.randrange(300) / 256]) for i in range(400)]
    got = {tuple(r) for r in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == _top(rows)


def test_a_block_stays_fast_where_nothing_is_pruned():
    rng = np.random.default_rng(17)
    v = rng.normal(size=(20_000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    v[5000:9000] = v[5000]  # copies: ties go to the smaller id
    own, ids = np.arange(20_000), np.arange(0, 20_000, 20)
    start = time.process_time()
    got = set(topk.best_of_block(ids, v[ids], np.full(1000, -np.inf), own, v, None, 5))
    assert time.process_time() - start < 10
    for q in ids[::50].tolist() + [5000, 5020]:
        scored = sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:5]
        assert {r for r in got if r[0] == q} == {(q, i, -s) for s, i in scored}


def _check(docs, frame, capacity=packing.CAPACITY):
    whole = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.packed(frame, capacity=capacity).collect()
    pieces, bins = [], {}
    for doc, text in docs:
        if doc is None:
            continue
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        pieces += [(doc, k, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(pieces)
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(p[3] for p in pieces)


def test_packing_holds_every_token_once(documents, odd_texts):
    rng = random.Random(13)
    odd = ["it's I'LL don't <|endoftext|> x<|y", "é ß İ ﬁ ½ ² 日本 👍 a b\x1cc\x85d ΑΣ Σ. ǅ", "'s't 're a'S \"'s ''s 3.14,2 A1B2", "ªº µ × ÷ ÿŸ"]
    docs = [(i, t) for i, t in enumerate(odd_texts + odd)] + [(100 + i, " ".join(["word"] * rng.choice((5, 700, 900, 1100, 1400, 2047, 5000)))) for i in range(80)]
    docs += [docs[-1], (None, "x")]
    used, tokens = _check(docs, documents(docs))
    assert used <= -(-tokens // packing.CAPACITY) * 1.25
    assert packing.packed(documents([])).count() == 0
    _check(docs[:12], documents(docs[:12]), capacity=7)


def test_plan_matches_large_items_best():
    rng = random.Random(14)
    for _ in range(30):
        counts = {rng.randrange(1, 31): rng.randrange(1, 9) for _ in range(rng.randrange(1, 10))}
        groups = packing.plan(counts, 30)
        held = {}
        for many, own in groups:
            assert sum(n * k for n, k in own) <= 30 and many > 0
            for n, k in own:
                held[n] = held.get(n, 0) + many * k
        assert held == counts
        places = packing.places(groups, stripes=3)
        for n, c in counts.items():
            ranks = sorted(r for p in places if p[0] == n for r in range(p[2], p[3]))
            assert ranks == list(range(c))
    assert sum(g[0] for g in packing.plan({16: 3, 14: 3, 11: 2}, 30)) == 4


def test_worker_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "PIECE_BYTES", 2 * packing.ENTRY)
    monkeypatch.setattr(packing, "WORD_BYTES", packing.ENTRY)
    encoder = packing.Encoder(packing.tokenizer_path())
    texts = ["one two three four, five", "six seven one two", "four five six"]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    for _ in range(2):
        assert encoder.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert 0 < len(encoder.pieces) <= 3 and 0 < len(encoder.words) <= 2
    monkeypatch.setattr(packing, "IDLE_SECONDS", 0.05)
    encoder.begin()
    encoder.forget()
    assert encoder.pieces and encoder.words  # a task is at work
    encoder.end()
    time.sleep(0.5)
    assert not encoder.pieces and not encoder.words
    assert packing.Encoder.of(packing.tokenizer_path()) is packing.Encoder.of(packing.tokenizer_path())


def test_unknown_words_reach_the_tokenizer_together():
    encoder, seen = packing.Encoder(packing.tokenizer_path()), []
    whole, lean = Tokenizer.from_file(packing.tokenizer_path()), encoder.lean

    class Counting:
        def encode_batch_fast(self, texts, **options):
            seen.append(len(texts))
            return lean.encode_batch_fast(texts, **options)

    encoder.lean = Counting()
    texts = ["", " \t\r\n ", "one\ttwo\n\nthree", *[f"Number {i}, it's (w{i:x}) l\u00e9ger" for i in range(300)], "last\x0bline ", ""]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want == encoder.encode(texts) and encoder.encode([""]) == [b""]
    assert sum(seen) == 1
