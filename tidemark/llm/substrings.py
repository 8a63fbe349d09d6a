"""Substring dedup by super-k-mers.

A word goes if a window of 13 words that covers it also starts in a document
with a smaller id. Windows are dealt by their minimiser, the least hash among
their word pairs; consecutive windows that share it travel as one
packed string of words, and each bucket sorts its windows and finds the least
document of each. Windows are compared word by word where their hashes agree.

At scale. A slice of a batch settles its own repeats first: only a window's
first document in the slice goes on, so a passage in many documents costs one
window a slice. A minimiser that still gathers many windows (a common pair, the
edges of a common passage) is split by the window's own hash, into as many
buckets as its count asks. These counts come from a first pass over all
documents, name at most ``LIMIT`` minimisers, and come with the ``LIMIT``
commonest words, which packed strings write in two bytes; other words take six,
the 48-bit hash by which words are told apart.

Defined results: rows without doc_id are left out; null, empty and blank texts
have no words; rows that share a doc_id are one document to others and are
cut row by row; repeats inside a document stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import materialize

from .common import BLANKS, text_megabytes, words
from .jaccard import mixed, rolled, sliced

WINDOW, MINIMISER = 13, 2
BUCKET_MB, SLICE = 7, 3_000
HOT_IN_SLICE, HOT_WINDOWS, COMMON_IN_SLICE, LIMIT = 64, 200_000, 6, 65_535
RARE = 65_535
LOW48 = np.uint64((1 << 48) - 1)


def _squeeze(*arrays) -> bytes:
    return pa.compress(raw := pickle.dumps(arrays, protocol=5), codec="zstd", asbytes=True) + len(raw).to_bytes(8, "little")


def _unsqueeze(packed: bytes) -> tuple:
    return pickle.loads(pa.decompress(packed[:-8], decompressed_size=int.from_bytes(packed[-8:], "little"), codec="zstd", asbytes=True))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    if not len(starts):
        return np.empty(0, np.int64)
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())


def least_documents(flat: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``flat`` that starts at ``at`` in document ``doc``: the least document of equal windows."""
    if not len(at):
        return doc
    h = rolled(flat, window)[at]
    order = np.lexsort((doc, h))
    h, first = h[order], np.zeros(len(at), np.int64)
    first[np.flatnonzero(np.r_[True, h[1:] != h[:-1]])] = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    first = np.maximum.accumulate(first)
    pos, lead = at[order], at[order][first]
    alike = np.ones(len(at), bool)
    check = np.flatnonzero(first != np.arange(len(at)))
    for j in range(window):
        alike[check] &= flat[pos[check] + j] == flat[lead[check] + j]
    least = doc[order][first]
    if not alike.all():  # different windows under one hash: group those by their words
        groups: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(h, h[~alike])):
            least[i] = groups.setdefault(flat[pos[i] : pos[i] + window].tobytes(), int(doc[order][i]))
    out = np.empty(len(at), np.int64)
    out[order] = least
    return out


def _spread_runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts within a row: (row, start, count)."""
    if not len(row):
        return row, start, start
    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    return row[cut], start[cut], np.diff(np.r_[cut, len(row)])


class Common:
    """Two-byte codes of the commonest words; every other word has the code RARE."""

    def __init__(self, words: np.ndarray):
        self.words = np.zeros(RARE + 1, np.uint64)
        self.words[: len(words)] = words
        self.order = np.argsort(words).astype(np.uint16)
        self.sorted = words[self.order]

    def codes(self, flat: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(flat), RARE, np.uint16)
        at = np.minimum(np.searchsorted(self.sorted, flat), len(self.sorted) - 1)
        return np.where(self.sorted[at] == flat, self.order[at], np.uint16(RARE))


class Slice:
    """The windows of one slice that have to leave it, and the repeats it can settle."""

    def __init__(self, batch: pa.RecordBatch, window: int, hot: dict[int, int]):
        ids, version = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
        offsets = batch.column("h").offsets.to_numpy().astype(np.int64)
        self.flat = flat = batch.column("h").values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64) & LOW48
        offsets = offsets - offsets[0]
        self.ids, self.version, self.offsets = ids, version, offsets
        count = np.maximum(np.diff(offsets) - window + 1, 0)
        at, row = _ranges(offsets[:-1], count), np.repeat(np.arange(len(ids)), count)
        again = least_documents(flat, at, ids[row], window) != ids[row]
        self.settled = row[again], at[again] - offsets[row[again]]
        self.at, self.row = at, row = at[~again], row[~again]
        if not len(at):
            self.key = self.minimiser = np.empty(0, np.uint64)
            return
        grams = rolled(flat, MINIMISER)
        least, span = grams, window - MINIMISER + 1
        least = np.lib.stride_tricks.sliding_window_view(grams, span).min(axis=1)[at]
        self.minimiser = least
        self.key = least
        if hot:
            names = np.array(sorted(hot), np.uint64)
            place = np.minimum(np.searchsorted(names, least), len(names) - 1)
            found = names[place] == least
            ways = np.array([hot[int(n)] for n in names], np.uint64)[place]
            salt = rolled(flat, window)[at] % np.where(found, ways, np.uint64(1))
            self.key = mixed(least + salt * np.uint64(0x9E3779B97F4A7C15))

    def super_kmers(self, bits: int, common: Common) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed): per bucket the words, rows, starts and window counts of its super-k-mers."""
        window = WINDOW
        at, row, key = self.at, self.row, self.key
        if not len(at):
            return
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
        count = np.diff(np.r_[cut, len(at)])
        code = common.codes(self.flat)
        bucket = (mixed(key[cut]) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        for k in range(1 << bits):
            own = order[edges[k] : edges[k + 1]]
            if not len(own):
                continue
            begin, n = at[cut[own]], count[own]
            text = _ranges(begin, n + window - 1)
            coded, raw = code[text], self.flat[text[code[text] == RARE]]
            planes = [np.ascontiguousarray(coded.view(np.uint8).reshape(-1, 2)[:, j]) for j in range(2)]
            rare = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8)[:, :6])
            rows = row[cut[own]]
            used, nth = np.unique(rows, return_inverse=True)
            yield k, _squeeze(rare, planes, self.ids[used], self.version[used], np.diff(nth, prepend=0).astype(np.int32), (begin - self.offsets[rows]).astype(np.int32), n.astype(np.uint16 if n.max() < 65536 else np.int32))


def _opened(packed: bytes, common: Common) -> tuple:
    rare, planes, ids, version, nth, start, n = _unsqueeze(packed)
    code = np.stack(planes, axis=1).view(np.uint16).ravel()
    wide = np.zeros((len(rare), 8), np.uint8)
    wide[:, :6] = rare
    flat = common.words[code]
    flat[code == RARE] = wide.view(np.uint64).ravel()
    return flat, ids, version, np.cumsum(nth), start.astype(np.int64), n.astype(np.int64)


def _span_parts(ids: np.ndarray, version: np.ndarray, row: np.ndarray, start: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """(part, packed): runs of windows per part of the documents, as rows' ids and versions, and row, start and count of each run."""
    row, start, count = _spread_runs(row, start)
    part = ids[row] % parts
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(order) else np.empty(0, np.int64)
    out = []
    for a, b in zip(edges, np.r_[edges[1:], len(order)]):
        own = order[a:b]
        used, nth = np.unique(row[own], return_inverse=True)
        out.append((int(part[own[0]]), _squeeze(ids[used], version[used], nth.astype(np.int32), start[own].astype(np.int32), count[own].astype(np.int32))))
    return out


def spans_of_part(rows: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, version, spans): packed (start, count) pairs of windows, one row per document row."""
    opened = [_unsqueeze(p) for p in rows["packed"]]
    doc, version = (np.concatenate([o[i][o[2]] for o in opened]) for i in (0, 1))
    start, count = (np.concatenate([o[i] for o in opened]) for i in (3, 4))
    order = np.lexsort((start, version, doc))
    doc, version = doc[order], version[order]
    pair = np.stack([start[order], count[order]], axis=1).astype(np.int32)
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])])
    return pd.DataFrame({"doc_id": doc[cut], "version": version[cut], "spans": [pair[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(doc)])]})


def repeated_windows(rows: pd.DataFrame, common: Common, parts: int) -> pd.DataFrame:
    """One bucket: the windows that start in a smaller document too, with what slices had settled; a row per part of the documents."""
    out, flats, bases, ids, versions, starts = [], [], [], [], [], []
    doc_of, total = [], 0
    for packed, settled in zip(rows["packed"], rows["settled"]):
        if settled is not None:
            own_ids, own_versions, row, start = _unsqueeze(settled)
            out += _span_parts(own_ids, own_versions, row, start, parts)
        if packed is None:
            continue
        flat, own_ids, own_versions, nth, start, n = _opened(packed, common)
        size = n + WINDOW - 1
        bases.append(_ranges(np.r_[0, np.cumsum(size)[:-1]], n) + total)
        starts.append(_ranges(start, n))
        doc_of.append(np.repeat(nth, n) + sum(map(len, ids)))
        ids.append(own_ids)
        versions.append(own_versions)
        flats.append(flat)
        total += len(flat)
    if flats:
        flat, at, row, start, doc, version = (np.concatenate(x) for x in (flats, bases, doc_of, starts, ids, versions))
        del flats, bases
        again = least_documents(flat, at, doc[row], WINDOW) != doc[row]
        row, start = row[again], start[again]
        order = np.lexsort((start, row))
        out += _span_parts(doc, version, row[order], start[order], parts)
    return pd.DataFrame(out, columns=["part", "packed"])


def _hashed(docs: DataFrame) -> DataFrame:
    split = words(F.col("text"), BLANKS, False)
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), F.transform(split, lambda w: F.xxhash64(w)).alias("h"))


def survey(docs: DataFrame, hot_windows: int = HOT_WINDOWS, in_slice: int = HOT_IN_SLICE) -> tuple[dict[int, int], Common]:
    """What a first pass over all documents tells: minimisers to split, and into how many buckets; the commonest words.

    A minimiser is split if at least ``hot_windows`` windows have it after slices
    settled theirs; counts below ``in_slice`` in one slice are not added up, for
    words below ``COMMON_IN_SLICE``. Neither changes what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, SLICE):
            own = Slice(b, WINDOW, {})
            for kind, values, least in ((0, own.minimiser, in_slice), (1, own.flat, COMMON_IN_SLICE)):
                names, counts = np.unique(values, return_counts=True)
                many = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many.sum(), kind, np.int32)), pa.array(names[many].view(np.int64)), pa.array(counts[many])], names=["kind", "name", "n"])

    counted = _hashed(docs).mapInArrow(run, "kind int, name long, n long").groupBy("kind", "name").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where((F.col("kind") == 1) | (F.col("n") >= hot_windows)), "survey")
    top = lambda kind: counted.where(F.col("kind") == kind).orderBy(F.desc("n"), "name").limit(LIMIT).collect()
    return {r["name"] % (1 << 64): -(-int(r["n"]) * 2 // hot_windows) for r in top(0)}, Common(np.array([r["name"] for r in top(1)], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, bucket_mb: float = BUCKET_MB, hot_windows: int = HOT_WINDOWS, in_slice: int = HOT_IN_SLICE) -> DataFrame:
    """(doc_id, version, spans): the windows of each row that a smaller document has too, a row each."""
    bits = max(3, int(np.ceil(np.log2(max(1.0, text_megabytes(docs, "text") / bucket_mb)))))
    hot, common = survey(docs, hot_windows, in_slice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, SLICE):
            own = Slice(b, WINDOW, hot)
            rows = [(k, packed, None) for k, packed in own.super_kmers(bits, common)]
            row, start = own.settled
            if len(row):
                spot = int.from_bytes(hashlib.blake2b(own.ids.tobytes(), digest_size=4).digest()) % (1 << bits)
                rows.append((spot, None, _squeeze(own.ids, own.version, row, start)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "packed", "settled"])

    dealt = _hashed(docs).mapInArrow(run, "bucket int, packed binary, settled binary")
    parts = next(p for p in range(1 << bits, 1 << (bits + 2)) if all(p % q for q in range(2, int(p**0.5) + 1)))
    found = dealt.groupBy("bucket").applyInPandas(lambda rows: repeated_windows(rows, common, parts), "part long, packed binary")
    return found.groupBy("part").applyInPandas(lambda rows: spans_of_part(rows), "doc_id long, version long, spans binary")


def deduplicated(docs: DataFrame, bucket_mb: float = BUCKET_MB, hot_windows: int = HOT_WINDOWS, in_slice: int = HOT_IN_SLICE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document: ``kept`` is what is left, joined by one space."""
    spans = repeated_spans(docs, bucket_mb, hot_windows, in_slice)
    own = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("version")).join(spans, ["doc_id", "version"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, found in zip(b["doc_id"], b["text"], b["spans"]):
                own = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(own)
                if found is not None:
                    pair = np.frombuffer(found, np.int32).reshape(-1, 2)
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, pair[:, 0], 1)
                    np.add.at(change, pair[:, 0] + pair[:, 1] + WINDOW - 1, -1)
                    own = [w for w, covered in zip(own, np.cumsum(change[:-1])) if not covered]
                out.append((doc, n, n - len(own), b" ".join(own).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])

    return own.select("doc_id", "text", "spans").mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string")


def substring_digests(docs: DataFrame, bucket_mb: float = BUCKET_MB, hot_windows: int = HOT_WINDOWS, in_slice: int = HOT_IN_SLICE) -> DataFrame:
    """Contract of op6: (doc_id, n_words, n_removed, kept_sha256)."""
    return deduplicated(docs, bucket_mb, hot_windows, in_slice).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
o AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
f AS (SELECT phrase, min(doc_id) AS first FROM o GROUP BY phrase HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS pos FROM o JOIN f USING (phrase) WHERE first < doc_id),
k AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
t AS (SELECT d.doc_id, w, p, list_contains(coalesce(gone, []), p) AS out FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) d LEFT JOIN k USING (doc_id)),
j AS (SELECT doc_id, count(*) FILTER (out) AS n_removed, string_agg(w[p], ' ' ORDER BY p) FILTER (NOT out) AS kept FROM t GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""
