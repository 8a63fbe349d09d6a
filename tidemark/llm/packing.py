"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Tokenising runs in Arrow batches. A text's tokens are those of its pieces
between spaces and line ends, since the tokenizer never joins across white
space; pieces, and the words in them, are remembered by a worker process up to a
fixed number of bytes, and everything unusual goes to the tokenizer whole. Once
a process has no tokenizing task for some seconds, only the tokenizer stays.

The packing is planned on the histogram of lengths, at most ``CAPACITY`` rows,
and applied to all pieces as a join. Documents above a third of the capacity
fit a sequence at most twice: the longest is matched with the longest partner
that fits. Shorter ones, longest first, go to the least gap that holds them.
The plan gives every length runs of places; a piece's rank among those of its
length picks its place. Ranks come from counts per (length, shard), so that a
length that a third of all pieces share is no larger task than others.

Defined results: rows without doc_id are left out; null text is empty and gives
one piece of one token; repeated rows are packed once each; other columns are
ignored.
"""

from __future__ import annotations

import re
import sys
import threading
import types
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import materialize

from .common import broadcast_if_small
from .flat import BLANK, by_bytes, flat_words, ranges

CAPACITY, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Bytes, Python's overhead included, of the pieces of text and of the words that a task remembers.
PIECE_BYTES, WORD_BYTES, ENTRY = 64_000_000, 32_000_000, 200
BATCH_BYTES, WORDS_AT_ONCE = 3_000_000, 4_000
#: How long a worker process without a tokenizing task remembers.
IDLE_SECONDS = 2.0
SHARD_ROWS, STRIPES = 200_000, 64

#: Pieces stand between spaces, tabs and line ends.
BLANKED = bytes(BLANK if c in b"\t\n\r" else c for c in range(256))
#: Pieces made of these alone are cut here as the tokenizer cuts them: ASCII marks and digits, Latin letters.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
UNITS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.lean = Tokenizer(self.whole.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.lock, self.tasks, self.timer = threading.Lock(), 0, None
        self.forget()

    def forget(self) -> None:
        """Drops what was learned from texts, unless a task is at work."""
        with self.lock:
            if not self.tasks:
                self.pieces: dict[bytes, bytes] = {}
                self.words: dict[str, bytes] = {}
                self.room = {"pieces": PIECE_BYTES, "words": WORD_BYTES}

    def begin(self) -> None:
        with self.lock:
            self.tasks += 1
            if self.timer:
                self.timer.cancel()

    def end(self) -> None:
        """The next task of this process may go on with what is known; without one, it is dropped soon."""
        with self.lock:
            self.tasks -= 1
            self.timer = threading.Timer(IDLE_SECONDS, self.forget)
            self.timer.daemon = True
            self.timer.start()

    @staticmethod
    def of(path: str) -> Encoder:
        """This process's encoder."""
        kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
        if path not in kept:
            kept[path] = Encoder(path)
        return kept[path]

    @staticmethod
    def _new(tokenizer, texts: list[str]) -> Iterator[bytes]:
        return (np.asarray(array("I", e.ids), "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _words(self, units: list[str]) -> Iterator[bytes]:
        """Ids of units without white space: many go as the lines of one text, and the id of a line end parts them."""
        for at in range(0, len(units), WORDS_AT_ONCE):
            some = units[at : at + WORDS_AT_ONCE]
            (e,) = self.lean.encode_batch_fast(["\n".join(some) + "\n"], add_special_tokens=False)
            ids = np.asarray(array("I", e.ids), "<u4")
            ends, raw = np.flatnonzero(ids == ids[-1]).tolist(), ids.tobytes()
            yield from (raw[4 * i : 4 * j] for i, j in zip([0, *[j + 1 for j in ends[:-1]]], ends))

    def _learn(self, kind: str, fresh: dict) -> dict:
        """What is known of a kind with what fits of ``fresh``, and a lookup for this call that holds the rest."""
        known = getattr(self, kind)
        for k, v in fresh.items():
            if self.room[kind] <= 0:
                return _Both(known, fresh)
            known[k] = v
            self.room[kind] -= len(k) + len(v) + ENTRY
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        flat, ends = self.tokens(texts)
        raw = memoryview(flat.tobytes())
        return [bytes(raw[4 * i : 4 * j]) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's end. Pieces are told apart by Arrow; each distinct one is looked up once."""
        own = [t.encode() for t in texts]
        raw = b" ".join(own).translate(BLANKED)
        coded = flat_words(raw).dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        plain, odd = {}, []
        for p in distinct:
            if p not in self.pieces:
                text = p.decode()
                if PLAIN(text) and "<|" not in text:
                    plain[p] = UNITS(text.lower())
                else:
                    odd.append(p)
        unknown = list({u for units in plain.values() for u in units if u not in self.words})
        words = self._learn("words", dict(zip(unknown, self._words(unknown))))
        fresh = {p: b"".join([words[u] for u in units]) for p, units in plain.items()}
        fresh.update(zip(odd, self._new(self.whole, [p.decode() for p in odd])))
        pieces = self._learn("pieces", fresh)
        ids = [pieces[p] for p in distinct]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, lengths = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        flat = np.frombuffer(b"".join(ids), "<u4")[ranges(starts, lengths)]
        blank = np.frombuffer(raw, np.uint8) == BLANK
        last = np.cumsum([len(t) + 1 for t in own]) - 1  # the blank after each text
        begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        return flat, np.r_[0, np.cumsum(lengths)][np.searchsorted(begins, last)]


class _Both(dict):
    """Looks in a second dictionary where the first has no entry."""

    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self.first = first

    def __missing__(self, key):
        return self.first[key]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end, cut only where longer than ``capacity``."""
    path = path or tokenizer_path()

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        encoder.begin()
        step, end = 4 * capacity, np.array([END], "<u4").tobytes()
        try:
            for b in by_bytes(batches, "text", BATCH_BYTES):
                rows = []
                for doc, raw in zip(b.column("doc_id").to_pylist(), encoder.encode([t or "" for t in b.column("text").to_pylist()])):
                    raw += end
                    rows += [(doc, k, at // 4, min(step, len(raw) - at) // 4, zlib.crc32(raw[at : at + step])) for k, at in enumerate(range(0, len(raw), step))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))
        finally:
            encoder.end()

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences: (how many, [(length, times), ...]), from how many pieces have each length."""
    left = {n: c for n, c in counts.items() if c}
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        fits = [n for n in large if n + longest <= capacity and (n < longest or left[n] > 1)]
        if not fits:
            groups.append((left.pop(longest), [(longest, 1)]))
            large.pop()
            continue
        mate = fits[-1]
        many = left[longest] // 2 if mate == longest else min(left[longest], left[mate])
        groups.append((many, [(longest, 2)] if mate == longest else [(longest, 1), (mate, 1)]))
        for n in (longest, mate):
            left[n] -= many
        large = [n for n in large if left.get(n)]
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    order: list[int] = []

    def keep(many: int, held: list[tuple[int, int]]) -> None:
        gap = capacity - sum(n * k for n, k in held)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((many, held))

    for many, held in groups:
        keep(many, held)
    for n in sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True):
        rest = left[n]
        while rest:
            at = bisect_left(order, n)
            if at == len(order):
                per = capacity // n
                if rest >= per:
                    keep(rest // per, [(n, per)])
                if rest % per:
                    keep(1, [(n, rest % per)])
                break
            gap = order[at]
            many, held = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            per = min(gap // n, rest)
            used = min(many, rest // per)
            if used < many:
                keep(many - used, held)
            keep(used, held + [(n, per)])
            rest -= used * per
    return [g for own in gaps.values() for g in own]


def places(groups: list[tuple[int, list[tuple[int, int]]]], stripes: int = STRIPES) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, stripe, first rank, rank after the last, sequence of rank ``origin``, offset, origin, times)... as rows of a join.

    Ranks of a length are cut into stripes, so that a piece meets few rows.
    """
    total: dict[int, int] = {}
    for many, held in groups:
        for n, times in held:
            total[n] = total.get(n, 0) + many * times
    width = {n: -(-c // stripes) for n, c in total.items()}
    given: dict[int, int] = {}
    rows, base = [], 0
    for many, held in groups:
        offset = 0
        for n, times in held:
            first = given.get(n, 0)
            after = given[n] = first + many * times
            for stripe in range(first // width[n], (after - 1) // width[n] + 1):
                rows.append((n, stripe, max(first, stripe * width[n]), min(after, (stripe + 1) * width[n]), base, offset, first, times, width[n]))
            offset += n * times
        base += many
    return rows


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with rank: 0, 1, ... among those of one length, without gathering a length."""
    shards = 8 + pieces.count() // SHARD_ROWS
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    sizes = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = sizes.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return dealt.withColumn("inside", inside).join(before, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("inside")).drop("shard", "inside", "before")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Contract of op10: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = materialize(token_pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = places(plan(counts, capacity))
    slots = docs.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["length", "stripe", "low", "high", "base", "at", "origin", "times", "width"]))
    width = {r[0]: r[8] for r in rows}
    widths = docs.sparkSession.createDataFrame(pd.DataFrame(sorted(width.items()), columns=["length", "width"]))
    found = ranked(pieces).join(broadcast_if_small(widths), "length").withColumn("stripe", F.floor(F.col("rank") / F.col("width")))
    met = found.drop("width").join(broadcast_if_small(slots.drop("width")), ["length", "stripe"]).where("rank >= low and rank < high")
    nth = F.col("rank") - F.col("origin")
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(nth / F.col("times"))).alias("sequence_id"), (F.col("at") + (nth % F.col("times")) * F.col("length")).alias("offset"),
    )
