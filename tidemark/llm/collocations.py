"""Phrase collocations by candidates from added-up hashes, then exact counts.

Texts are stored as shards: about a quarter of a million words of one language, coded by
the shard's own vocabulary. Shards name their words, then pairs of frequent words, then
longer phrases whose pairs are candidates: each by some bits of its hash, with its
count. Counts that share these bits are added up; where they reach the support, the
phrases are candidates. So no frequent phrase is missed, whatever shares its bits. A
last pass counts all candidates exactly, word by word, and scores come from these counts.

At scale. Frequent words and candidates come back to the shards as bitmaps of
``BITS`` bits (8 MB) at every size of input; where two hashes share a bit, a
phrase too many is counted, never one too few. A task adds up its shards before it
names anything: a phrase in a third of all texts costs some bytes a task. A hash is
named by so many bits that one or two words of the corpus share a value at a support
of 30, far below it; sorted, as differences, a name takes about two bytes, and one bit
more as the input doubles. The last pass adds up phrases as numbers of words and sends
them with these words. The last ranking takes the first ``most`` per (language, slice)
before it takes those of a language.

Defined results: null text has no words; null lang is ``und``; other columns,
null ids and repeated rows make no difference to counting (every row counts);
an empty table gives no rows; ties rank by the phrase's bytes; a very long text
is cut into shards between pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import materialize, spread

from .common import broadcast_if_small
from .flat import by_bytes, byte_table, flat_words, from_planes, low_planes, opened, places, squeezed
from .jaccard import mixed

SUPPORT, LONGEST, INSIDE_PERCENT, MOST = 30, 4, 80, 2_000
SHARD_BYTES, BUFFER_BYTES, BATCH_BYTES = 1_500_000, 6_000_000, 2_000_000
#: Shards of a file: Spark reads thousands of rows of one at once.
FILE_SHARDS = 32
#: Words of the corpus per bucket of the exchanges of hashes and of the exact counts; phrases that a task adds up before it sends them.
BUCKET_WORDS, EXACT_WORDS, TALLY = 4_000_000, 8_000_000, 600_000
#: Names that a task adds up before it sends them; words that it has numbers for before it starts anew.
NAMED_ROWS, NUMBERED = 1_500_000, 500_000
#: Rows of a bucket that wait before they are added up.
ADDED_ROWS = 200_000
BITS = 26
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
FOLDED = byte_table(b"\t", PIECE_ENDS, b".")
END = b" . "
STEP = np.uint64(0x9E3779B97F4A7C15)
SHARD_ROW = "lang string, n long, vocabulary array<string>, counts array<long>, codes binary"


def _shard_row(lang: str, raw: bytes) -> pa.RecordBatch | None:
    """One shard: its words in order as codes, from 1 by falling frequency, 0 where a piece ends."""
    coded = flat_words(raw).dictionary_encode()
    codes, vocabulary = coded.indices.to_numpy().astype(np.int32), coded.dictionary
    end = pc.index(vocabulary, b".").as_py()
    if end >= 0:
        codes = np.where(codes == end, -1, codes - (codes > end)).astype(np.int32)
        vocabulary = pa.concat_arrays([vocabulary.slice(0, end), vocabulary.slice(end + 1)])
    if not len(vocabulary):
        return None
    counts = np.bincount(codes[codes >= 0], minlength=len(vocabulary))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order) + 1, np.int64)
    place[order], place[-1] = np.arange(1, len(order) + 1), 0
    vocabulary, counts, codes = vocabulary.take(pa.array(order)), counts[order], place[codes]
    spelled = pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), vocabulary.cast(pa.string()))
    row = [pa.array([lang]), pa.array([int(counts.sum())]), spelled, pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([squeezed(_planes(codes))], pa.binary())]
    return pa.RecordBatch.from_arrays(row, names=["lang", "n", "vocabulary", "counts", "codes"])


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of one language's words in order, as codes into the row's own vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            raw = b"".join(waiting.pop(lang))
            size.pop(lang)
            at = 0
            while at < len(raw):
                cut = raw.find(END, at + shard_bytes)
                cut = len(raw) if cut < 0 or len(raw) - cut < shard_bytes // 2 else cut
                row = _shard_row(lang, raw[at:cut])
                if row is not None:
                    yield row
                at = cut

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                folded = (text or b"").translate(FOLDED).replace(b".", END) + END
                waiting.setdefault(lang, []).append(folded)
                size[lang] = size.get(lang, 0) + len(folded)
                if size[lang] >= shard_bytes:
                    yield from flush(lang)
            if sum(size.values()) > BUFFER_BYTES:
                for lang in list(waiting):
                    yield from flush(lang)
        for lang in list(waiting):
            yield from flush(lang)

    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    return own.mapInArrow(run, SHARD_ROW)


def bitmap_of(hashes: DataFrame, column: str = "h") -> np.ndarray:
    """2^BITS flags: which values the highest bits of the hashes take. The driver holds 8 MB at every size."""
    spot = F.shiftrightunsigned(F.col(column), 64 - BITS) + 1
    parts = hashes.select(spot.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for row in parts.collect():
        own = np.frombuffer(bytes(row.bits), np.uint8)
        out[(row.part - 1) * len(own) : row.part * len(own)] = own
    return out


def flagged(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


class Mined:
    """Phrases of one shard, length by length."""

    def __init__(self, codes: np.ndarray, word_hashes: np.ndarray, frequent: np.ndarray):
        self.codes, self.hashes, self.size = codes, word_hashes, len(word_hashes)
        good = np.r_[frequent, False][codes]
        self.length = 1
        self.alive, self.name = good, self.codes

    def lengthen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first places, counts, hashes) of the distinct phrases one word longer whose two parts are alive."""
        at = np.flatnonzero(self.alive[:-1] & self.alive[1:])
        key = self.name[at] * self.size + self.codes[at + self.length]
        _, first, self.which, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        self.at, self.length = at, self.length + 1
        first = at[first]
        h = self.hashes[self.codes[first]]
        for j in range(1, self.length):
            h = mixed(h * STEP + self.hashes[self.codes[first + j]])
        return first, counts, mixed(h + np.uint64(self.length))

    def keep(self, chosen: np.ndarray) -> None:
        """Only the chosen ones of the phrases just found may be parts of longer ones."""
        alive, name = np.zeros(len(self.codes), bool), np.full(len(self.codes), -1, np.int64)
        held = chosen[self.which]
        alive[self.at[held]] = True
        name[self.at[held]] = self.which[held]
        self.alive, self.name = alive, name


NAMED = "bucket int, packed binary"
PACKED = {"bucket": pa.int32(), "packed": pa.binary()}


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(PACKED.values())], names=list(PACKED))


def _planes(values: np.ndarray) -> np.ndarray:
    """As many bytes of each value as the largest one needs, plane by plane."""
    return low_planes(values, max(1, (int(values.max()).bit_length() + 7) // 8))


class Names:
    """The highest ``fine`` bits of hashes with counts up to the support, which share a 64-bit number."""

    def __init__(self, bits: int, fine: int, support: int, most: int = NAMED_ROWS):
        self.bits, self.fine, self.support, self.most = bits, fine, np.uint64(support), most
        self.low = np.uint64(support.bit_length())
        self.held, self.rows = [], 0

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append(keys << self.low | np.minimum(counts.astype(np.uint64), self.support))
        self.rows += len(keys)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.put(hashes >> np.uint64(64 - self.fine), counts)
        if self.rows > 1.5 * self.most:
            self.combine()
            if self.rows > self.most:
                yield from self.flush()

    def combine(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts), sorted; counts stop at the support."""
        both = np.concatenate(self.held) if self.held else np.empty(0, np.uint64)
        both.sort()
        keys = both >> self.low
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        both &= (np.uint64(1) << self.low) - np.uint64(1)
        keys, counts = keys[first], np.minimum(np.add.reduceat(both, first), self.support) if len(first) else both
        self.held, self.rows = [keys << self.low | counts], len(keys)
        return keys, counts

    def flush(self) -> Iterator[pa.RecordBatch]:
        keys, counts = self.combine()
        self.held, self.rows = [], 0
        inside = self.fine - self.bits
        rows = []
        for k, i, j in places((keys >> np.uint64(inside)).astype(np.int64)):
            rows.append((k, squeezed(_planes(np.diff(keys[i:j], prepend=np.uint64(k << inside))), _planes(counts[i:j]))))
        if rows:
            yield _packed_rows(rows)


def _reached(rows: pd.DataFrame, bits: int, fine: int, support: int) -> pd.DataFrame:
    """One bucket: hashes whose counts add up to the support, by their highest bits; two phrases that share them are both kept."""
    whole, base = Names(bits, fine, support), np.uint64(int(rows["bucket"].iloc[0]) << (fine - bits))
    for packed in rows["packed"]:
        steps, counts = opened(packed)
        whole.put(base + np.cumsum(from_planes(steps), dtype=np.uint64), from_planes(counts))
        if whole.rows > 2 * whole.most:
            whole.combine()
            whole.most = max(whole.most, whole.rows)
    keys, counts = whole.combine()
    return pd.DataFrame({"h": (keys[counts >= whole.support] << np.uint64(64 - fine)).view(np.int64)})


class Phrases:
    """Counted phrases as numbers of words, from 1 in the order of their coming; 0 is no word."""

    def __init__(self, longest: int):
        self.words: dict[str, int] = {}
        self.langs: dict[str, int] = {}
        self.places = [f"w{j}" for j in range(longest)]
        self.held: list[pa.Table] = []
        self.rows = 0

    @staticmethod
    def numbers(known: dict[str, int], names: list[str]) -> np.ndarray:
        return np.array([known.setdefault(name, len(known) + 1) for name in names], np.int32)

    def put(self, bucket: np.ndarray, lang: np.ndarray, words: list[np.ndarray], f: np.ndarray) -> None:
        none = np.zeros(len(f), np.int32)
        columns = [bucket.astype(np.int32), lang.astype(np.int32), *words, *[none] * (len(self.places) - len(words)), f.astype(np.int64)]
        self.held.append(pa.table([pa.array(c) for c in columns], names=["bucket", "lang", *self.places, "f"]))
        self.rows += len(f)

    def combine(self) -> pa.Table:
        keys = ["bucket", "lang", *self.places]
        whole = pa.concat_tables(self.held).group_by(keys, use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"}).select([*keys, "f"])
        self.held, self.rows = [whole], whole.num_rows
        return whole


class Tally(Phrases):
    """Exact counts of a task's phrases, added up across its shards and put out packed per bucket."""

    def __init__(self, bits: int, most: int = TALLY, longest: int = LONGEST):
        super().__init__(longest)
        self.bits, self.most = bits, most

    def add(self, lang: str, phrases: pa.Array, length: int, counts: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbers = self.numbers(self.words, [w for p in phrases.to_pylist() for w in p.split(" ")]).reshape(-1, length)
        yield from self.add_numbers(lang, list(numbers.T), counts, hashes)

    def add_numbers(self, lang: str, words: list[np.ndarray], counts: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = np.full(len(counts), self.numbers(self.langs, [lang])[0])
        self.put(hashes >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(counts)), own, words, counts)
        if self.rows > 1.5 * self.most:
            self.combine()
            if self.rows > self.most:
                yield from self.flush()

    def restart(self) -> Iterator[pa.RecordBatch]:
        """Between shards: numbers are given anew once there are many."""
        if len(self.words) > NUMBERED:
            yield from self.flush()
            self.words.clear()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        order = ["bucket", self.places[0], "lang", *self.places[1:]]
        whole = self.combine().sort_by([(c, "ascending") for c in order])
        self.held, self.rows = [], 0
        columns = {c: whole.column(c).to_numpy() for c in whole.column_names}
        spelled, langs = np.array(list(self.words), object), np.array(list(self.langs), object)
        rows = []
        for k, i, j in places(columns["bucket"].astype(np.int64)):
            words, lang = [columns[c][i:j] for c in self.places], columns["lang"][i:j]
            used, called = np.unique(np.concatenate([[0], *words]))[1:], np.unique(lang)
            words = [np.searchsorted(used, w, "right") for w in words]
            words[0] = np.diff(words[0], prepend=0)
            rows.append((k, squeezed(langs[called - 1].tolist(), " ".join(spelled[used - 1]).encode(), _planes(np.searchsorted(called, lang)), [_planes(w) for w in words], _planes(columns["f"][i:j]))))
        yield _packed_rows(rows)
        pa.default_memory_pool().release_unused()


def _added_up(rows: pd.DataFrame, support: int, longest: int = LONGEST) -> pd.DataFrame:
    """One bucket: phrases that reach the support, word by word. What is unpacked is added up before much more is."""
    whole, most = Phrases(longest), ADDED_ROWS
    for packed in rows["packed"]:
        langs, spelled, lang, words, f = opened(packed)
        langs = whole.numbers(whole.langs, langs)
        known = np.r_[0, whole.numbers(whole.words, spelled.decode().split(" "))].astype(np.int32)
        words, lang, f = [from_planes(w).astype(np.int64) for w in words], from_planes(lang).astype(np.int64), from_planes(f)
        words[0] = np.cumsum(words[0])
        whole.put(np.zeros(len(f)), langs[lang], [known[w] for w in words], f)
        if whole.rows > 2 * most:
            most = max(ADDED_ROWS, whole.combine().num_rows)
    found = whole.combine().filter(pc.field("f") >= support)
    words, langs = pa.array(list(whole.words), pa.string()), pa.array(list(whole.langs), pa.string())
    out = []
    for k in range(1, longest + 1):
        own = found.filter((pc.field(whole.places[k - 1]) > 0) & (pc.field(whole.places[k]) == 0 if k < longest else True))
        parts = [words.take(pc.subtract(own.column(c).combine_chunks(), 1)) for c in whole.places[:k]]
        out.append(pd.DataFrame({"lang": langs.take(pc.subtract(own.column("lang").combine_chunks(), 1)).to_pandas(), "phrase": (pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]).to_pandas(), "k": k, "f": own.column("f").to_numpy()}))
    del whole, found
    pa.default_memory_pool().release_unused()
    return pd.concat(out, ignore_index=True)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f): words and phrases of at least ``support``; (lang, n): all words)."""
    stored = materialize(shards(docs, shard_bytes), "collocation-shards", compression="zstd", maxRecordsPerFile=FILE_SHARDS)
    totals = materialize(stored.groupBy("lang").agg(F.sum("n").alias("n")), "collocation-totals")
    stored = stored.withColumn("h", F.transform("vocabulary", lambda w: F.xxhash64("lang", w)))  # cheaper than its storage
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    bits, exact_bits = (min(24, max(3, int(np.ceil(np.log2(max(1.0, all_words / size)))))) for size in (BUCKET_WORDS, EXACT_WORDS))
    fine = min(64 - support.bit_length(), max(BITS, (16 * all_words // max(1, support)).bit_length()))

    def reached(of_shard, *columns: str) -> np.ndarray:
        """Bitmap of what ``of_shard`` names, as (hashes, counts), at least ``support`` times in all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = Names(bits, fine, support)
            for batch in batches:
                for row in zip(*(batch.column(c) for c in columns)):
                    for hashes, counts in of_shard(*row):
                        yield from names.add(hashes, counts)
            yield from names.flush()

        named = spread(stored.select(*columns).mapInArrow(run, NAMED), "bucket")
        return bitmap_of(named.groupBy("bucket").applyInPandas(lambda rows: _reached(rows, bits, fine, support), "h long"))

    def hashes_of(h: pa.ListScalar) -> np.ndarray:
        return h.values.to_numpy(zero_copy_only=False).view(np.uint64)

    def mined(h: pa.ListScalar, codes: pa.BinaryScalar) -> Mined:
        hashes = hashes_of(h)
        (packed,) = opened(codes.as_py())
        return Mined(from_planes(packed).astype(np.int64) - 1, hashes, flagged(words_bitmap, hashes))

    words_bitmap = reached(lambda h, counts: [(hashes_of(h), counts.values.to_numpy(zero_copy_only=False))], "h", "counts")

    def pairs(h: pa.ListScalar, codes: pa.BinaryScalar) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, counts, hashes = mined(h, codes).lengthen()
        yield hashes, counts

    pair_bits = reached(pairs, "h", "codes")

    def longer(h: pa.ListScalar, codes: pa.BinaryScalar) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = mined(h, codes)
        own.keep(flagged(pair_bits, own.lengthen()[2]))
        for _ in range(longest - 2):
            _, counts, hashes = own.lengthen()
            own.keep(np.ones(len(counts), bool))
            yield hashes, counts

    candidates = pair_bits
    if longest > 2:
        candidates = candidates | reached(longer, "h", "codes")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(exact_bits, longest=longest)
        for batch in batches:
            for lang, vocabulary, uses, h, codes in zip(*(batch.column(c) for c in ("lang", "vocabulary", "counts", "h", "codes"))):
                yield from tally.restart()
                lang, vocabulary, hashes, own = lang.as_py(), vocabulary.values, hashes_of(h), mined(h, codes)
                at = np.flatnonzero(flagged(words_bitmap, hashes))
                words = vocabulary.take(pa.array(at))
                yield from tally.add(lang, words, 1, uses.values.to_numpy(zero_copy_only=False)[at], hashes[at])
                numbers = np.zeros(len(hashes), np.int32)
                numbers[at] = tally.numbers(tally.words, words.to_pylist())
                for _ in range(longest - 1):
                    first, counts, names = own.lengthen()
                    chosen = flagged(candidates, names)
                    own.keep(chosen)
                    first = first[chosen]
                    if len(first):
                        yield from tally.add_numbers(lang, [numbers[own.codes[first + j]] for j in range(own.length)], counts[chosen], names[chosen])
        yield from tally.flush()

    found = spread(stored.select("lang", "vocabulary", "counts", "h", "codes").mapInArrow(exact, NAMED), "bucket")
    both = found.groupBy("bucket").applyInPandas(lambda rows: _added_up(rows, support, longest), "lang string, phrase string, k int, f long")
    return materialize(both, "collocation-phrases"), totals


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT, most: int = MOST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases, by how much their parts keep together."""
    frequent, totals = frequent_phrases(docs, support, longest, shard_bytes)
    words = F.split("phrase", " ")
    phrases = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))

    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda first, length: F.array_join(F.slice("w", first, length), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.size("w")).alias("rest"))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = "decimal(20,0)"
    score = F.expr(f"(cast(2000000 as decimal(10,0)) * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide}))")
    lowest = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    lowest = lowest.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"), F.first("a").alias("a"))

    inner = phrases.where("k > 2").select("lang", "a", "k", "w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("length"))
    inner = inner.select("lang", "a", "w", "length", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("length") + 1)).alias("at"))
    longest_use = inner.groupBy("lang", part(F.col("at"), F.col("length")).alias("phrase")).agg(F.max("a").alias("longer"))
    apart = lowest.join(longest_use, ["lang", "phrase"], "left").where(f"longer is null or cast(100 as {wide}) * longer < cast({inside_percent} as {wide}) * a")

    scored = apart.select("lang", "phrase", "a", "least.l", "least.r", "least.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(slices))).orderBy(*order)
    few = scored.withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= most).drop("nth")
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return few.join(broadcast_if_small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS first, array_to_string(w[cut + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
y AS (SELECT x.lang, x.phrase, a, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score, cut FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
m AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[s : s + j - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - j + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS j FROM c WHERE k > 2)) GROUP BY ALL),
k AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, encode(m.phrase)) AS rank FROM m LEFT JOIN i ON i.lang = m.lang AND i.phrase = m.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT k.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""
