"""Brute-force versions and small tables that the operator tests share."""

import hashlib
import re
from collections import Counter, defaultdict

FOLD = {c: c + 32 for c in range(65, 91)}
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SOLID = re.compile("[^\x20\x09-\x0d]+")


def contamination(docs, items, window=13):
    """doc_id -> (n_words, n_hit, item ids, contaminated)."""
    phrases = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(FOLD))
        for i in range(max(1, len(w) - window + 1)) if w and item is not None else ():
            phrases[tuple(w[i : i + window])].add(str(item))
    lengths = {len(p) for p in phrases}
    out = {}
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[tuple(w[i : i + n])]
        out[doc] = (len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def near_duplicates(docs):
    """doc_id -> (n_shingles, component_id)."""
    sets = {}
    for doc, text in docs:
        w = SOLID.findall((text or "").translate(FOLD))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * both >= 75 * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def deduplicated(docs, window=13):
    """doc_id -> (n_words, n_removed, sha256 of what is kept)."""
    rows = sorted((d, (t or "").encode().split()) for d, t in docs)
    first = {}
    for d, w in rows:
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in rows:
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def base_spans(text):
    """The spans of the fixed patterns, joined."""
    text = text or ""
    assign = re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
