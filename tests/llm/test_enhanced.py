"""Suffix arrays, maximal repeats and byte dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import some_text
from tidemark.llm import enhanced, repeats


def brute_cut(docs, size=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    rows = sorted((d, (t or "").encode()) for d, t in docs)
    first = {}
    for d, b in rows:
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], d)
    out = {}
    for d, b in rows:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def brute_repeats(texts, least, shortest):
    """Repeated strings that no byte to either side extends with all their occurrences -> places."""
    places = defaultdict(set)
    for t, b in enumerate(texts):
        for i in range(len(b)):
            for j in range(i + shortest, len(b) + 1):
                places[b[i:j]].add((t, i))
    out = {}
    for s, where in places.items():
        after = {texts[t][i + len(s) : i + len(s) + 1] or (t, i) for t, i in where}
        before = {texts[t][i - 1 : i] if i else (t, i) for t, i in where}
        if len(where) > 1 and len(after) > 1 and len(before) > 1:
            out[s] = (where, min(least[t] for t, _ in where))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats_equal_brute_force(seed):
    rng = random.Random(seed)
    common = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 25))) for _ in range(4)]
    texts = list(dict.fromkeys(b"".join([bytes(rng.choice(b"abc") for _ in range(rng.randrange(6))), rng.choice(common), rng.choice(common), bytes(rng.choice(b"ab") for _ in range(rng.randrange(6)))])[:70] for _ in range(25)))
    least = np.array([rng.randrange(100) for _ in texts])
    group, length, text, place, small = enhanced.repeat_groups(texts, least, 6)
    got = defaultdict(set)
    for g, n, t, p, m in zip(*(x.tolist() for x in (group, length, text, place, small))):
        got[g, texts[t][p : p + n], m].add((t, p))
    assert {s: (where, m) for (_, s, m), where in got.items()} == brute_repeats(texts, least.tolist(), 6)
    assert len(got) == len({g for g, _, _ in got})


def test_suffix_array_of_nothing():
    assert all(len(x) == 0 for x in enhanced.repeat_groups([], np.empty(0, np.int64), 6))
    assert all(len(x) == 0 for x in enhanced.repeat_groups([b"short"], np.array([1]), 6))


def test_byte_hashes_tell_runs_apart():
    raw = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    for n in (1, 3, 5, 8, 24):
        h = enhanced.byte_hashes(raw, n)
        assert len(h) == len(raw) - n + 1
        same = {}
        for i, x in enumerate(h.tolist()):
            assert same.setdefault(raw[i : i + n].tobytes(), x) == x
        assert len(set(same.values())) == len(same)
    assert len(enhanced.byte_hashes(raw, 99)) == 0


def some_docs(odd_texts):
    rng = random.Random(13)
    passages = [some_text(rng, 20, 30) for _ in range(4)] + ["—é漢😀" * 9, " " * 300, "ab" * 200, "x" * 49, "y" * 50]
    texts = [some_text(rng, rng.randrange(6), 10**6) + rng.choice(passages)[rng.randrange(9) :] + rng.choice(["", " "]) + some_text(rng, 4, 10**6) for _ in range(150)]
    return [(i * 7 - 100, t) for i, t in enumerate(texts + odd_texts + texts[:5] + odd_texts)]


@pytest.mark.parametrize("settings", [(), (3_000, 0.02, 5, 200), (10**9, 0.01, 1, 1)])
def test_bytes_equal_brute_force(documents, odd_texts, settings):
    """The settings make many slices, buckets, hot anchors and parts."""
    docs = some_docs(odd_texts)
    rows = repeats.repeat_digests(documents(docs + [docs[3], (None, docs[0][1])]).repartition(3), *settings).collect()
    assert len(rows) == len(docs) + 1
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_cut(docs)


def test_kept_bytes_and_empty_tables(documents):
    assert repeats.repeat_digests(documents([])).count() == 0
    row = repeats.deduplicated(documents([(1, None)])).first()
    assert (row.doc_id, row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == (1, 0, 0, 0, b"")
    same = "0123456789" * 5
    kept = {r.doc_id: bytes(r.kept) for r in repeats.deduplicated(documents([(1, same), (2, "a" + same + "b" + same[:49]), (3, same[1:]), (4, same[:49] + "!")])).collect()}
    assert kept == {1: same.encode(), 2: b"ab" + same[:49].encode(), 3: same[1:].encode(), 4: same[:49].encode() + b"!"}


def test_long_text_across_chunks(documents, monkeypatch):
    rng = random.Random(3)
    long = some_text(rng, 3_000, 10**6)
    docs = [(1, long), (2, "x" + long[5_000:15_000] + "y"), (3, long[:60] + long)]
    monkeypatch.setattr(repeats, "CHUNK", 700)
    own = repeats.Anchored(repeats.squeezed(np.array([1]), np.array([len(long)])), repeats.squeezed(long.encode() + b"\xff"))
    assert own.count.sum() == len(long) - 49 and (own.start[1:] > own.start[:-1]).all() and own.count.max() <= repeats.SPAN
    rows = repeats.repeat_digests(documents(docs)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_cut(docs)
