"""Suffix-array dedup of bytes, by the tree of common-prefix intervals.

A byte goes if a string of 50 bytes that covers it also starts in a document
with a smaller id. Strings that can repeat are brought together, and each bucket
builds an enhanced suffix array over them: suffixes in order, common prefixes of
neighbours, and a stack scan over the intervals of suffixes that share at least
50 bytes. An interval whose suffixes are preceded by different bytes is a maximal
repeat; it is put out with all its occurrences, and those in documents beyond its
smallest one are cut. Every repeated string of 50 bytes lies in a maximal repeat
with the same documents, so nothing is missed.

How strings come together. A window's anchor is the least hash among its runs
of 24 bytes, so equal windows have equal anchors. Consecutive windows with one
anchor are one fragment of at most 76 bytes. A first exchange of anchor hashes
tells each slice of the corpus which of its anchors occur elsewhere too; only
their fragments travel, each distinct one once a slice, with its smallest
document. Occurrences in a slice's larger documents are settled by the slice.

At scale. A slice is about ``SLICE_BYTES`` of text, compressed, and the unit of
every join, so a hot source or a group of copies is spread like other rows. A
bucket receives about ``BUCKET_MB`` of text's share of anchors and fragments and
works its suffix arrays off in parts of ``PART_WINDOWS``. Fragments of an anchor
with more than ``HOT`` occurrences travel window by window, dealt by the window
itself, so that no bucket gathers a common passage's surroundings. Anchors are
told apart by 40 bits and their bucket, which can only send a fragment too many;
strings are compared byte by byte.

Defined results: rows without doc_id are left out; null text is empty; a text
of fewer than 50 bytes is kept; repeats inside a document stay; rows that share a
doc_id are one document to others and are cut row by row; an empty table gives no
rows; a very long text is a slice of its own, its fragments sent in parts; other
columns are ignored. What is kept may split a character: it is bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.session import materialize, spread

from .enhanced import END, byte_hashes, repeat_groups
from .flat import by_bytes, from_planes, low_planes, opened, places, ranges, squeezed
from .jaccard import mixed

SHORTEST, GRAM = 50, 24
SPAN = SHORTEST - GRAM + 1
SLICE_BYTES, BUCKET_MB, CHUNK = 4_000_000, 20, 1_000_000
HOT, FRAGMENTS, PART_WINDOWS = 20_000, 200_000, 300_000
REMIX = np.uint64(0xD6E8FEB86659FD93)


def slices(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(slice, size, ids, text): documents in slices; ``ids`` packs their ids and lengths, ``text`` their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in by_bytes(batches, "text", slice_bytes):
            texts = [t or b"" for t in b.column("text").to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            row = [number, int(lengths.sum()), squeezed(b.column("doc_id").to_numpy(), lengths), squeezed(bytes([END]).join([*texts, b""]))]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["slice", "size", "ids", "text"])
            number += 1

    own = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "slice long, size long, ids binary, text binary")


class Anchored:
    """The fragments of one slice: where they start, how many windows they have, their anchor's hash, their row."""

    def __init__(self, ids: bytes, text: bytes):
        self.docs, self.lengths = opened(ids)
        (self.text,) = opened(text)
        raw = np.frombuffer(self.text, np.uint8)
        self.ends = np.cumsum(self.lengths + 1) - 1
        starts, counts, grams = [], [], []
        for at in range(0, len(raw), CHUNK):
            part = raw[at : at + CHUNK + SHORTEST - 1]
            if len(part) < SHORTEST:
                break
            least = byte_hashes(part, GRAM)
            for width in (1, 2, 4, 8):
                least = np.minimum(least[:-width], least[width:])
            least = np.minimum(least[: len(least) - (SPAN - 16)], least[SPAN - 16 :])  # 24 + 26 = 50 bytes
            place = at + np.arange(len(least))
            row = np.searchsorted(self.ends, place)
            whole = self.ends[np.minimum(row, len(self.ends) - 1)] - place >= SHORTEST
            cut = np.flatnonzero(whole & np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
            stop = np.flatnonzero(whole & np.r_[(least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~whole[1:], True]) + 1
            pieces = -(-(stop - cut) // SPAN)
            own = np.repeat(np.arange(len(cut)), pieces)
            first = cut[own] + SPAN * ranges(np.zeros(len(cut), np.int64), pieces)
            starts.append(at + first)
            counts.append(np.minimum(stop[own] - first, SPAN))
            grams.append(least[first])
        joined = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
        self.start, self.count = joined(starts, np.int64), joined(counts, np.int64)
        self.gram = mixed(joined(grams, np.uint64) ^ REMIX)  # least hashes are small; buckets need even ones
        self.row = np.searchsorted(self.ends, self.start)

    def by_gram(self) -> None:
        """Distinct anchors in order of their hash, with the group of each fragment."""
        order = np.argsort(self.gram, kind="stable")
        ordered = self.gram[order]
        head = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.empty(0, bool)
        first = np.flatnonzero(head)
        self.distinct, self.uses = ordered[first], np.diff(np.r_[first, len(ordered)])
        last = np.r_[first[1:], len(ordered)] - 1
        self.many = self.row[order][first] != self.row[order][last] if len(first) else np.empty(0, bool)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(head) - 1


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def anchor_survey(stored: DataFrame, bits: int) -> DataFrame:
    """(bucket, slice, packed): each slice's distinct anchors, how often it has them, and whether in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, ids, text in zip(*(b.column(c).to_pylist() for c in ("slice", "ids", "text"))):
                own = Anchored(ids, text)
                own.by_gram()
                bucket = (own.distinct >> np.uint64(64 - bits)).astype(np.int64)
                keys = (own.distinct >> np.uint64(24 - bits)) & np.uint64((1 << 40) - 1)
                uses = np.minimum(own.uses, 65_535).astype(np.uint16)
                rows = [(k, number, squeezed(low_planes(keys[i:j]), uses[i:j], np.packbits(own.many[i:j]))) for k, i, j in places(bucket)]
                yield _table(rows, {"bucket": pa.int32(), "slice": pa.int64(), "packed": pa.binary()})

    return stored.select("slice", "ids", "text").mapInArrow(run, "bucket int, slice long, packed binary")


def shared_anchors(rows: pd.DataFrame, hot: int) -> pd.DataFrame:
    """One bucket: to each slice, which of its anchors other rows have too, and which are hot."""
    unpacked = [opened(p) for p in rows["packed"]]
    keys = np.concatenate([from_planes(u[0]) for u in unpacked])
    uses = np.concatenate([u[1] for u in unpacked]).astype(np.int64)
    many = np.concatenate([np.unpackbits(u[2], count=len(u[1])) for u in unpacked])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    size = np.diff(np.r_[first, len(order)])
    shared = (size > 1) | (np.maximum.reduceat(many[order], first) > 0)
    common = shared & (np.add.reduceat(uses[order], first) > hot)
    flags = np.empty((2, len(order)), bool)
    flags[:, order] = np.repeat(np.stack([shared, common]), size, axis=1)
    ends = np.cumsum([len(u[1]) for u in unpacked])
    answers = [squeezed(np.packbits(flags[:, a:b], axis=1), b - a) for a, b in zip(np.r_[0, ends[:-1]], ends)]
    return pd.DataFrame({"slice": rows["slice"], "bucket": rows["bucket"], "packed": answers})


def _sent(own: Anchored, flags: list, bits: int) -> Iterator[tuple[list[tuple[int, bytes]], bytes | None]]:
    """(rows for buckets, settled spans) of a slice, a part of its shared fragments at a time."""
    own.by_gram()
    shared, hot = np.concatenate([np.unpackbits(f, axis=1, count=n).astype(bool) for f, n in (opened(x["packed"]) for x in sorted(flags, key=lambda x: x["bucket"]))], axis=1)
    chosen = np.flatnonzero(shared[own.group])
    split = hot[own.group[chosen]]
    single, n = chosen[split], own.count[chosen[split]]
    start = np.r_[own.start[chosen[~split]], ranges(own.start[single], n)]
    count = np.r_[own.count[chosen[~split]], np.ones(n.sum(), np.int64)]
    key, row = np.r_[own.gram[chosen[~split]], np.zeros(n.sum(), np.uint64)], np.r_[own.row[chosen[~split]], np.repeat(own.row[single], n)]
    alone = len(chosen) - len(single)
    for at in range(0, len(start), FRAGMENTS):
        begin, size, doc = start[at : at + FRAGMENTS], count[at : at + FRAGMENTS] + SHORTEST - 1, own.docs[row[at : at + FRAGMENTS]]
        names: dict[bytes, int] = {}
        text = np.array([names.setdefault(own.text[a : a + n], len(names)) for a, n in zip(begin.tolist(), size.tolist())], np.int64)
        texts = list(names)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, text, doc)
        later = doc > least[text]
        place = np.empty(len(texts), np.uint64)
        place[text] = key[at : at + FRAGMENTS]
        for t in np.unique(text[max(alone - at, 0) :]).tolist():  # windows of hot anchors are dealt by themselves
            place[t] = int.from_bytes(hashlib.blake2b(texts[t], digest_size=8).digest(), "little")
        by_bucket = np.argsort(place, kind="stable")
        rank = np.empty(len(texts), np.int64)
        rank[by_bucket] = np.arange(len(texts))
        kept = np.flatnonzero(~later)
        kept = kept[np.argsort(rank[text[kept]], kind="stable")]
        of_text = rank[text[kept]]
        sizes = np.array([len(t) for t in texts], np.uint8)[by_bucket]
        part = ((place[by_bucket] >> np.uint64(48 - bits)) & np.uint64(0xFFFF)).astype(np.uint16)
        rows = []
        for k, i, j in places((place[by_bucket] >> np.uint64(64 - bits)).astype(np.int64)):
            a, b = np.searchsorted(of_text, [i, j])
            held = kept[a:b]
            packed = squeezed(b"".join(texts[t] for t in by_bucket[i:j].tolist()), sizes[i:j], part[i:j], (of_text[a:b] - i).astype(np.int32), begin[held], doc[held])
            rows.append((k, packed))
        yield rows, squeezed(begin[later], size[later]) if later.any() else None


def sent_fragments(flagged: DataFrame, bits: int) -> DataFrame:
    """(bucket, slice, packed, settled): distinct fragments of shared anchors; spans that the slice could settle."""
    kinds = {"bucket": pa.int32(), "slice": pa.int64(), "packed": pa.binary(), "settled": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, ids, text, flags in zip(*(b.column(c).to_pylist() for c in ("slice", "ids", "text", "flags"))):
                for rows, settled in _sent(Anchored(ids, text), flags, bits) if flags else ():
                    out = [(k, number, packed, None) for k, packed in rows]
                    if settled is not None:
                        out.append((number * 0x9E3779B1 % (1 << bits), number, None, settled))
                    yield _table(out, kinds)

    return flagged.select("slice", "ids", "text", "flags").mapInArrow(run, "bucket int, slice long, packed binary, settled binary")


def _parts(part: np.ndarray, windows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Texts in groups of about ``most`` windows; those of one part stay together."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    total = np.add.reduceat(windows[order], cut) if len(cut) else cut
    begin, held = 0, 0
    for i, n in enumerate(total.tolist()):
        if held and held + n > most:
            yield order[begin : cut[i]]
            begin, held = cut[i], 0
        held += n
    if begin < len(order):
        yield order[begin:]


def _covered(sizes: np.ndarray, text: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, length) of the maximal runs that spans cover."""
    offsets = np.r_[0, np.cumsum(sizes + 1)]
    change = np.zeros(offsets[-1] + 1, np.int32)
    np.add.at(change, offsets[text] + place, 1)
    np.add.at(change, offsets[text] + place + length, -1)
    edge = np.diff(np.r_[0, (np.cumsum(change) > 0).astype(np.int8)])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(offsets, begin, "right") - 1
    return of, begin - offsets[of], end - begin


def repeated_bytes(rows: pd.DataFrame, part_windows: int) -> pd.DataFrame:
    """One bucket: (slice, packed) spans of its fragments that occur in smaller documents, and what slices had settled."""
    out, texts, parts, of_text, begins, docs, origin = [], {}, [], [], [], [], []
    for number, packed, settled in zip(rows["slice"], rows["packed"], rows["settled"]):
        if settled is not None:
            out.append((number, settled))
        if packed is None:
            continue
        raw, sizes, part, nth, begin, doc = opened(packed)
        ends = np.cumsum(sizes, dtype=np.int64)
        own = np.array([texts.setdefault(raw[a:b], len(texts)) for a, b in zip((ends - sizes).tolist(), ends.tolist())], np.int64)
        parts.append((own, part))
        of_text.append(own[nth])
        begins.append(begin)
        docs.append(doc)
        origin.append(np.full(len(begin), number))
    if texts:
        texts = list(texts)
        part = np.empty(len(texts), np.uint16)
        for own, values in parts:
            part[own] = values
        text, begin, doc, slice_of = (np.concatenate(x) for x in (of_text, begins, docs, origin))
        sizes = np.array([len(t) for t in texts], np.int64)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, text, doc)
        spans = [(text[:0], text[:0], text[:0])]
        for own in _parts(part, sizes - SHORTEST + 1, part_windows):
            _, length, which, place, small = repeat_groups([texts[t] for t in own.tolist()], least[own], SHORTEST)
            gone = least[own][which] > small
            found, at, n = _covered(sizes[own], which[gone], place[gone], length[gone])
            spans.append((own[found], at, n))
        found, at, n = (np.concatenate(x) for x in zip(*spans))
        # A fragment in several documents is a repeat as a whole: what lies beyond its smallest one goes.
        later = doc > least[text]
        order = np.argsort(found, kind="stable")
        found, at, n = found[order], at[order], n[order]
        entry = np.flatnonzero(~later)
        low, high = np.searchsorted(found, text[entry]), np.searchsorted(found, text[entry], "right")
        entry, run = np.repeat(entry, high - low), ranges(low, high - low)
        where = np.r_[slice_of[later], slice_of[entry]]
        start, length = np.r_[begin[later], begin[entry] + at[run]], np.r_[sizes[text[later]], n[run]]
        order = np.argsort(where, kind="stable")
        out += [(number, squeezed(start[order[a:b]], length[order[a:b]])) for number, a, b in places(where[order])]
    return pd.DataFrame(out, columns=["slice", "packed"])


def deduplicated(docs: DataFrame, slice_bytes: int = SLICE_BYTES, bucket_mb: float = BUCKET_MB, hot: int = HOT, part_windows: int = PART_WINDOWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document: ``kept`` is what is left, as bytes."""
    stored = materialize(slices(docs, slice_bytes), "repeat-slices")
    megabytes = (stored.agg(F.sum("size")).first()[0] or 0) / 1e6
    bits = min(24, max(3, int(np.ceil(np.log2(max(1.0, megabytes / bucket_mb))))))
    answers = spread(anchor_survey(stored, bits), "bucket").groupBy("bucket").applyInPandas(lambda rows: shared_anchors(rows, hot), "slice long, bucket int, packed binary")
    flags = spread(answers, "slice").groupBy("slice").agg(F.collect_list(F.struct("bucket", "packed")).alias("flags"))
    by_slice = spread(stored.select("slice", "ids", "text"), "slice")  # one exchange for both joins
    flagged = by_slice.join(flags, "slice", "left")
    found = spread(sent_fragments(flagged, bits), "bucket").groupBy("bucket").applyInPandas(lambda rows: repeated_bytes(rows, part_windows), "slice long, packed binary")
    spans = spread(found, "slice").groupBy("slice").agg(F.collect_list("packed").alias("spans"))
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, text, spans in zip(*(b.column(c).to_pylist() for c in ("ids", "text", "spans"))):
                doc_ids, lengths = opened(ids)
                (whole,) = opened(text)
                raw, change = np.frombuffer(whole, np.uint8), np.zeros(len(whole) + 1, np.int32)
                for packed in spans or ():
                    start, length = opened(packed)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                rising = np.cumsum(np.diff(np.r_[0, gone.astype(np.int8)]) == 1)
                lost = np.r_[0, np.cumsum(gone)]
                rows = []
                for doc, n, end in zip(doc_ids.tolist(), lengths.tolist(), np.cumsum(lengths + 1).tolist()):
                    a, z = end - 1 - n, end - 1
                    removed = int(lost[z] - lost[a])
                    if removed:
                        runs = int(rising[z - 1] - (rising[a - 1] if a else 0))
                        rows.append((doc, n, removed, runs, raw[a:z][~gone[a:z]].tobytes()))
                    else:
                        rows.append((doc, n, 0, 0, whole[a:z]))
                yield _table(rows, kinds)

    own = by_slice.join(spans, "slice", "left").select("ids", "text", "spans")
    return own.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_digests(docs: DataFrame, *settings) -> DataFrame:
    """Contract of op13: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return deduplicated(docs, *settings).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT doc_id, n, b, substring(x, 2 * b + 1, 198) AS y FROM (SELECT doc_id, n, x, unnest(range(0, n, 50)) AS b FROM d WHERE n >= 50)),
w AS (SELECT doc_id, b + i AS s, substring(y, 2 * i + 1, 100) AS y FROM (SELECT doc_id, n, b, y, unnest(range(0, 50)) AS i FROM b) WHERE b + i + 50 <= n),
o AS MATERIALIZED (SELECT doc_id, s, hash(y) AS h, hash(y || 'x') AS m FROM w),
f AS (SELECT h, m, min(doc_id) AS first FROM o GROUP BY h, m HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, s FROM o JOIN f USING (h, m) WHERE first < doc_id),
e AS (SELECT doc_id, s, s > lag(s, 1, -100) OVER w + 50 AS opens, s + 50 < lead(s, 1, 9000000000) OVER w AS closes FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
g AS (SELECT doc_id, s AS a, lead(z) OVER (PARTITION BY doc_id ORDER BY s, z NULLS FIRST) AS z, opens FROM (SELECT doc_id, s, opens, NULL AS z FROM e WHERE opens UNION ALL SELECT doc_id, s, false, s + 50 FROM e WHERE closes)),
r AS (SELECT doc_id, a, z FROM g WHERE opens),
k AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS begins, list(z ORDER BY a) AS ends FROM r GROUP BY doc_id),
j AS (SELECT d.doc_id, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN begins IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(begins) + 2), lambda i: x[2 * coalesce(ends[i - 1], 0) + 1 : 2 * coalesce(begins[i], n)]), '') END AS kept FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, n AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM j
"""
