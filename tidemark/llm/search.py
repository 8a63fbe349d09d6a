"""Ranked lexical search by presence masks.

Each item ranks all documents. Within a block of documents, an item's terms give
every document a mask of the terms that it holds; documents with one mask form a
group. A mask's highest possible score is the sum, over its terms, of the
weight times the term's largest saturation in the block. Distinct masks are
evaluated by descending highest score, their documents scored exactly, until the
next mask cannot reach the item's tenth best score so far.

At scale. One pass over the texts keeps, per block, the postings of the items'
terms; counts of documents and terms add up from there. A task carries each
item's ten best from block to block, so later blocks meet a high floor, and ends
with at most ten rows an item; the last ranking sees ten rows an item and task.
Items are the stated query set: they meet the documents in groups of at most
``ITEMS`` items or ``TERMS`` terms, which bounds what a task holds of them.
Blocks hold about ``BLOCK_BYTES`` of text or ``BLOCK_DOCS`` documents. Terms are
compared as they are written, not by hashes.

Defined results: rows without doc_id or item_id are left out of everything, the
counts too; documents whose text is null, empty or without terms are not counted
and never ranked; rows that share a doc_id are ranked one by one; rows that share
an item_id are one item with the terms of all; an item without terms, or an
empty table on either side, gives no rows; equal scores rank by doc_id; a very
long text is a block of its own; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import materialize

from .common import NOT_ALNUM, broadcast_if_small, words
from .flat import by_bytes, byte_table, flat_words, opened, squeezed

BEST = 10
ITEMS, TERMS = 2_000, 100_000
BLOCK_BYTES, BLOCK_DOCS = 8_000_000, 4_096
EVALUATED = 256
#: Everything in ASCII but letters and digits parts terms.
FOLDED = byte_table(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
#: Stands between documents; no term can hold it.
BETWEEN = b"\n"


def item_groups(items: DataFrame, most_items: int = ITEMS, most_terms: int = TERMS) -> Iterator[list[tuple]]:
    """Groups of (item_id, distinct terms) that bound what a task must hold."""
    own = items.where("item_id is not null").select("item_id", F.array_distinct(words(F.col("text"), NOT_ALNUM, True)).alias("terms"))
    own = own.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where("size(terms) > 0").orderBy("item_id")
    group, total = [], 0
    for row in own.toLocalIterator():
        if group and (len(group) == most_items or total + len(row.terms) > most_terms):
            yield group
            group, total = [], 0
        group.append((row.item_id, [t.encode() for t in row.terms]))
        total += len(row.terms)
    if group:
        yield group


def block_postings(docs: DataFrame, vocabulary: list[bytes], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A row per block: documents with terms, all their terms, its known terms with their documents, and the packed postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([BETWEEN, *vocabulary], pa.binary())
        for batch in by_bytes(batches, "text", BLOCK_BYTES):
            for at in range(0, batch.num_rows, block_docs):
                own = batch.slice(at, block_docs)
                raw = (b" " + BETWEEN + b" ").join((t or b"").translate(FOLDED) for t in own.column("text").to_pylist())
                spelled = flat_words(raw)
                place = np.asarray(pc.fill_null(pc.index_in(spelled, value_set=known), -1)).astype(np.int64)
                doc = np.cumsum(place == 0)
                n = np.bincount(doc[place != 0], minlength=own.num_rows).astype(np.int64)
                hit = place > 0
                pair, tf = np.unique((place[hit] - 1) * own.num_rows + doc[hit], return_counts=True)
                term, which = np.divmod(pair, own.num_rows)
                terms, df = np.unique(term, return_counts=True)
                packed = squeezed(own.column("doc_id").to_numpy(), n, terms.astype(np.int32), np.cumsum(df), which.astype(np.int32), tf.astype(np.int32))
                row = [int((n > 0).sum()), int(n.sum()), terms.tolist(), df.tolist(), packed]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["docs", "total", "terms", "df", "packed"])

    return docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "docs long, total long, terms array<int>, df array<long>, packed binary")


def mask_groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each document, one document of each group) of a term x document table of flags."""
    packed = np.packbits(present, axis=0, bitorder="little")
    wide = np.zeros((-(-len(packed) // 8) * 8, present.shape[1]), np.uint8)
    wide[: len(packed)] = packed
    bitmaps = np.ascontiguousarray(wide.T).view(np.uint64)
    _, one, group = np.unique(bitmaps[:, 0], return_index=True, return_inverse=True)
    for j in range(1, bitmaps.shape[1]):
        _, nth = np.unique(bitmaps[:, j], return_inverse=True)
        _, one, group = np.unique(group * present.shape[1] + nth, return_index=True, return_inverse=True)
    return group, one


class Best:
    """The best documents of one item so far."""

    def __init__(self, most: int):
        self.most, self.score, self.doc = most, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.most else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        held = score > 0
        score, doc = np.r_[self.score, score[held]], np.r_[self.doc, doc[held]]
        order = np.lexsort((doc, -score))[: self.most]
        self.score, self.doc = score[order], doc[order]


def rank_block(best: Best, doc_ids: np.ndarray, saturation: np.ndarray, weight: np.ndarray) -> int:
    """Evaluate masks by descending highest score until safely finished; returns how many documents were scored."""
    group, one = mask_groups(saturation > 0)
    highest = ((saturation[:, one] > 0) * (weight * saturation.max(axis=1))[:, None]).sum(axis=0)
    order = np.argsort(-highest, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[group]
    by_mask = np.argsort(place, kind="stable")
    bound, done = highest[order][place[by_mask]], 0
    while done < len(by_mask) and bound[done] >= best.floor:
        own = by_mask[done : done + EVALUATED]
        best.add((saturation[:, own] * weight[:, None]).sum(axis=0), doc_ids[own])
        done += EVALUATED
    return min(done, len(by_mask))


def best_in_tasks(blocks: DataFrame, group: list[tuple], vocabulary: list[bytes], weights: np.ndarray, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """(item, doc_id, score): at most ``most`` rows of each item a task."""
    number = {t: i for i, t in enumerate(vocabulary)}
    wanted = [np.array([number[t] for t in terms], np.int64) for _, terms in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(most) for _ in wanted]
        for batch in batches:
            for packed in batch.column("packed"):
                doc_ids, n, terms, ends, which, tf = opened(packed.as_py())
                size = 10 + (90 * n * n_docs) // n_terms
                sat = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * size[which])
                row_of = np.full(len(weights), -1, np.int64)
                row_of[terms] = np.arange(len(terms))
                for own, held in zip(wanted, best):
                    rows = row_of[own]
                    own, rows = own[rows >= 0], rows[rows >= 0]
                    if not len(rows):
                        continue
                    table = np.zeros((len(rows), len(doc_ids)), np.int64)
                    for i, r in enumerate(rows):
                        a, b = ends[r - 1] if r else 0, ends[r]
                        table[i, which[a:b]] = sat[a:b]
                    rank_block(held, doc_ids, table, weights[own])
        found = [(i, d, s) for i, held in enumerate(best) for d, s in zip(held.doc.tolist(), held.score.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return blocks.select("packed").mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, most: int = BEST, most_items: int = ITEMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``most`` best documents, best first."""
    spark = docs.sparkSession
    item_type = items.schema["item_id"].dataType.simpleString()
    result = None
    for group in item_groups(items, most_items):
        vocabulary = sorted({t for _, terms in group for t in terms})
        blocks = materialize(block_postings(docs, vocabulary, block_docs), "search-postings")
        n_docs, n_terms = blocks.agg(F.sum("docs"), F.sum("total")).first()
        if not n_terms:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for row in blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect():  # no more rows than the group has terms
            df[row.terms] = row.df
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        found = best_in_tasks(blocks, group, vocabulary, weights, n_docs, n_terms, most)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(group)], f"item int, item_id {item_type}")
        found = found.join(broadcast_if_small(names), "item").select("item_id", "doc_id", "score")
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
q AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
z AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(q.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM i JOIN p USING (term) JOIN q USING (term), s GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM z WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
