"""N-gram Jaccard join by a forest of signature trees.

Which documents meet in a tree is settled first, without loss. Equal shingle
sets become one node. A shingle that no other node has cannot be in an
intersection, so nodes with too few shared shingles drop out; of the rest, two
that link must share one of their rarest shingles (the prefix rule). The
components of "shares a prefix shingle" are therefore cut apart safely, and
each gets its tree.

A tree's nodes hold the OR of their members' shingle bitmaps, their range of
set sizes and the most shingles that fell on one another's bits. A dual
traversal from the root drops a pair of nodes if its sizes are too far apart or
its greatest possible overlap, common bits plus that slack, is below what 0.75
needs. Pairs that are left are compared exactly, unless they are already
connected: components are the result, so a group of copies costs one link each.

At scale. Shingles travel once, as five bytes in rows packed per (slice of a
batch, bucket), and back packed per (bucket, part of the nodes); those frequent
in a slice go once per slice. Trees of more
than ``UNIT`` shingles or ``MOST`` nodes are split into chunks of neighbouring
sizes: chunks link inside, their representatives link next, and chunk pairs are
then traversed only where their size ranges allow a link and they still hold
different components. Shingles are told apart by 64-bit hashes when
sets are counted, and by 40 bits and their bucket in intersections.

Defined results: rows without doc_id are left out; rows that share a doc_id are
one document, of whose sets the one with the least digest counts; null, empty
or blank texts have an empty set and link with nothing; columns beyond doc_id
and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import materialize

from .common import BLANKS, broadcast_if_small, text_megabytes, words
from .components import components

SHINGLE, PERCENT = 5, 75
CAP = 64
SLICE = 2_000
UNIT, MOST = 2_000_000, 2_000
BUCKET_MB = 10
FANOUT = 8
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def hashed_words(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, h): the 64-bit hash of every word; and the columns ``also``."""
    split = words(F.col("text"), BLANKS, True)
    return docs.where("doc_id is not null").select("doc_id", F.transform(split, lambda w: F.xxhash64(w)).alias("h"), *also)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(45))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words of a flat array."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = out * STEP + h[i : i + n]
    return mixed(out)


def shingle_sets(batch: pa.RecordBatch, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, sorted distinct shingle hashes) of each document."""
    column = batch.column("h")
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
    hashes = rolled(flat, k) if len(flat) >= k else np.empty(0, np.uint64)
    for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets, offsets[1:]):
        if b - a >= k:
            yield doc, np.unique(hashes[a : b - k + 1])
        elif b > a:
            yield doc, rolled(flat[a:b], int(b - a)) * STEP + np.uint64(b - a)
        else:
            yield doc, np.empty(0, np.uint64)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, to bound the arrays made of each."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def set_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n) of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [(d, digest_of(s), len(s)) for d, s in shingle_sets(b)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["doc_id", "digest", "n"])

    return hashed_words(docs).mapInArrow(run, "doc_id long, digest binary, n long")


def representative_words(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, h) of each class's node, once: of a node with several rows, of one whose set is the class's."""
    held = docs.select("doc_id", "text")
    once = classes.where("held = 1").select(F.col("node").alias("doc_id"))
    spelled = hashed_words(held.join(broadcast_if_small(once), "doc_id", "left_semi"))
    repeated = classes.where("held > 1").select(F.col("node").alias("doc_id"), "digest")
    if repeated.isEmpty():
        return spelled

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            same = [digest_of(s) == d for (_, s), d in zip(shingle_sets(b), b.column("digest").to_pylist())]
            yield b.filter(pa.array(same, pa.bool_())).select(["doc_id", "h"])

    rows = hashed_words(held.join(broadcast_if_small(repeated), "doc_id"), "digest").mapInArrow(matching, "doc_id long, h array<long>")
    return spelled.unionByName(rows.groupBy("doc_id").agg(F.first("h").alias("h")))


def _five(x: np.ndarray) -> np.ndarray:
    """The low 40 bits, as bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


PACKED = "bucket int, nodes binary, counts binary, tokens binary, known_nodes binary, known_counts binary, known binary, full binary"


def packed_shingles(node_words: DataFrame, bits: int) -> DataFrame:
    """Rows per (batch, bucket): each node's shingles, and those that at least CAP nodes of the batch hold.

    ``known`` lists the latter per node, for passing through; ``full`` names each once, for the other batches.
    """
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            docs, sets = [], []
            for d, s in shingle_sets(b):
                docs.append(d)
                sets.append(s)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            if not len(flat):
                continue
            node = np.repeat(np.array(docs, np.int64), [len(s) for s in sets])
            values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
            full = counts[inverse] >= CAP
            bucket = (flat >> shift).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows = []
            edges = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            for k in range(1 << bits):
                at = order[edges[k] : edges[k + 1]]
                if not len(at):
                    continue
                cut = full[at]
                row = [k]
                for part in (at[~cut], at[cut]):
                    starts, lengths = _runs(node[part])
                    row += [node[part][starts].tobytes(), lengths.astype(np.int32).tobytes(), _five(flat[part]).tobytes()]
                rows.append(row + [_five(np.unique(flat[at[cut]])).tobytes()])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] + [pa.binary()] * 7
        for rows in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows[c].tolist(), t) for c, t in zip(rows.columns, kinds)], names=list(rows.columns))

    return node_words.mapInArrow(arrow, PACKED)


def _unpack(rows: pd.DataFrame, prefix: str, tokens: str) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.frombuffer(b"".join(rows[prefix + "nodes"]), np.int64)
    counts = np.frombuffer(b"".join(rows[prefix + "counts"]), np.int32)
    return np.repeat(nodes, counts), _from_five(b"".join(rows[tokens]))


SHARED = "part long, bucket int, nodes binary, counts binary, tokens binary, held binary"


def shared_shingles(rows: pd.DataFrame, parts: int) -> pd.DataFrame:
    """One bucket: the shingles that several nodes hold and by how many, up to CAP; a row per part of the nodes."""
    node, token = _unpack(rows, "", "tokens")
    values, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
    full = np.unique(_from_five(b"".join(rows["full"])))
    counts = np.where(np.isin(values, full), CAP, np.minimum(counts, CAP)).astype(np.uint16)
    held = counts[inverse] if len(token) else np.empty(0, np.uint16)
    keep = held >= 2
    more_node, more = _unpack(rows, "known_", "known")
    node, token, held = np.r_[node[keep], more_node], np.r_[token[keep], more], np.r_[held[keep], np.full(len(more), CAP, np.uint16)]
    part = node % parts
    order = np.lexsort((node, part))
    node, token, held, part = node[order], token[order], held[order], part[order]
    out = []
    for a, n in zip(*_runs(part)):
        own = slice(a, a + n)
        starts, lengths = _runs(node[own])
        out.append((int(part[a]), int(rows["bucket"].iloc[0]), node[own][starts].tobytes(), lengths.astype(np.int32).tobytes(), _five(token[own]).tobytes(), held[own].tobytes()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SHARED.split(", ")])


def _linkable_part(nodes: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one part whose shared shingles suffice, with their rarest as prefix."""
    size = dict(zip(nodes["node"], nodes["n"]))
    node, token = _unpack(shared, "", "tokens")
    counts = np.frombuffer(b"".join(shared["counts"]), np.int32)
    per_row = [len(c) // 4 for c in shared["counts"]]
    token |= np.repeat(np.repeat(shared["bucket"].to_numpy(np.uint64), per_row), counts) << np.uint64(40)
    held = np.frombuffer(b"".join(shared["held"]), np.uint16)
    order = np.argsort(node, kind="stable")
    node, token, held = node[order], token[order], held[order]
    rows = []
    for a, s in zip(*_runs(node)):
        n = int(size[int(node[a])])
        least = -(-PERCENT * n // 100)
        if s >= least:
            own, how = token[a : a + s], held[a : a + s]
            rows.append((int(node[a]), n, np.sort(own).tobytes(), own[np.lexsort((own, how))[: s - least + 1]].astype(np.int64).tolist()))
    return pd.DataFrame(rows, columns=["node", "n", "tokens", "prefix"])


def linkable(nodes: DataFrame, packed: DataFrame, bits: int) -> DataFrame:
    """(node, n, tokens, prefix) of the nodes whose shared shingles suffice; tokens as packed longs."""
    parts = next(p for p in range(1 << bits, 1 << (bits + 2)) if all(p % q for q in range(2, int(p**0.5) + 1)))
    shared = packed.groupBy("bucket").applyInPandas(lambda rows: shared_shingles(rows, parts), SHARED)
    own = nodes.withColumn("part", F.pmod("node", F.lit(parts)))
    met = own.groupBy("part").cogroup(shared.groupBy("part"))
    return met.applyInPandas(lambda a, b: _linkable_part(a, b), "node long, n long, tokens binary, prefix array<long>")


def forest(nodes: DataFrame) -> DataFrame:
    """(node, cluster): nodes that share a prefix shingle are in one cluster."""
    held = nodes.select("node", F.explode("prefix").alias("token"))
    hubs = held.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    return components(held.join(hubs, "token").select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a != b").distinct()).withColumnRenamed("component", "cluster")


class SignatureTree:
    """Bitmaps and size ranges of sets, level by level; level 0 holds the sets themselves."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray]):
        bits = 1 << int(np.ceil(np.log2(max(64, 4 * max(map(len, sets))))))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(maps, sets):
            place = mixed(s) % np.uint64(bits)
            np.bitwise_or.at(row, (place // np.uint64(64)).astype(np.int64), np.uint64(1) << (place % np.uint64(64)))
        slack = np.array([len(s) for s in sets]) - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, slack)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs of a level may hold a link."""
        maps, low, high, slack = self.levels[level]
        keep = (100 * high[a] >= PERCENT * low[b]) & (100 * high[b] >= PERCENT * low[a])
        most = np.minimum(high[a], high[b])
        step = max(1, (1 << 21) // maps.shape[1])
        for i in range(0, len(a), step):
            p, q = a[i : i + step], b[i : i + step]
            common = np.bitwise_count(maps[p] & maps[q]).sum(axis=1, dtype=np.int64) + np.minimum(slack[p], slack[q])
            most[i : i + step] = np.minimum(most[i : i + step], common)
        return keep & ((100 + PERCENT) * most >= PERCENT * (low[a] + low[b]))

    def pairs(self, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Set pairs i < j that survive the dual traversal; with ``group``, only those of different groups."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                wide = np.arange(FANOUT)
                a, b = (np.repeat(a, FANOUT**2) * FANOUT + np.tile(np.repeat(wide, FANOUT), len(a))), (np.repeat(b, FANOUT**2) * FANOUT + np.tile(wide, len(b) * FANOUT))
                real = (a <= b) & (b < len(self.levels[level][1]))
                a, b = a[real], b[real]
            if level == 0:
                real = a < b if group is None else (a < b) & (group[a] != group[b])
                a, b = a[real], b[real]
            real = self.possible(level, a, b)
            a, b = a[real], b[real]
        return a, b


def links(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the sets' pairwise links connect; pairs already connected (or of one group) are skipped."""
    if len(nodes) < 2:
        return []
    order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], sizes))
    nodes, sizes, sets = nodes[order], sizes[order], [sets[i] for i in order]
    label = np.arange(len(nodes)) if group is None else np.unique(group[order], return_inverse=True)[1]
    a, b = SignatureTree(sizes, sets).pairs(None if group is None else label)
    found = []
    while len(a):
        nearest = np.unique(a, return_index=True)[1] if len(found) or len(a) > len(nodes) else np.arange(len(a))
        for i in nearest:
            x, y = a[i], b[i]
            if label[x] == label[y]:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if (100 + PERCENT) * both >= PERCENT * int(sizes[x] + sizes[y]):
                found.append((int(nodes[x]), int(nodes[y])))
                label[label == label[y]] = label[x]
        rest = np.ones(len(a), bool)
        rest[nearest] = False
        rest &= label[a] != label[b]
        a, b = a[rest], b[rest]
    return found


def _linked(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within each cluster of one unit."""
    out = []
    for _, own in rows.groupby("cluster", sort=False):
        group = own["component"].to_numpy() if "component" in own and own["component"].notna().all() else None
        out += links(own["node"].to_numpy(), own["n"].to_numpy(), [np.frombuffer(t, np.uint64) for t in own["tokens"]], group)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _chunked(placed: DataFrame, unit: int) -> DataFrame:
    """``placed`` with chunks (how many its cluster needs) and chunk: sets of neighbouring sizes, so that chunks far apart need not meet.

    A set weighs its shingles, at least a share that lets ``MOST`` sets fit; a size
    that outweighs a chunk is cut by hash.
    """
    weight = F.greatest(F.col("n"), F.lit(max(1, unit // MOST))).cast("long")
    sizes = placed.groupBy("cluster", "n").agg((F.count("*") * F.first(weight)).alias("w"))
    upto = F.sum("w").over(Window.partitionBy("cluster").orderBy("n"))
    sizes = sizes.select("cluster", "n", F.floor((upto - F.col("w")) / unit).alias("band"), F.ceil(F.col("w") / unit).cast("int").alias("ways"), F.ceil(F.sum("w").over(Window.partitionBy("cluster")) / unit).cast("int").alias("chunks"))
    cut = F.when(F.col("chunks") == 1, F.lit(0).cast("long")).otherwise(F.col("band") * F.lit(1 << 20) + F.pmod(F.xxhash64("node"), F.col("ways")))
    return placed.join(sizes, ["cluster", "n"]).withColumn("chunk", cut).drop("band", "ways")


def forest_links(placed: DataFrame, unit: int = UNIT) -> DataFrame:
    """(a, b): links that connect all nodes connected by 0.75 overlap. ``placed``: node, n, tokens, cluster."""
    dealt = materialize(_chunked(placed, unit), "chunks")
    total = dealt.where("chunks = 1").agg(F.sum("n")).first()[0] or 0
    spread = int(4 * total / unit) + 8
    small = dealt.where("chunks = 1").withColumn("unit", F.pmod(F.xxhash64("cluster"), F.lit(spread)))
    found = small.groupBy("unit").applyInPandas(lambda rows: _linked(rows), "a long, b long")
    large = dealt.where("chunks > 1")
    if large.isEmpty():
        return materialize(found, "found")
    found = materialize(found.union(large.groupBy("cluster", "chunk").applyInPandas(lambda rows: _linked(rows), "a long, b long")), "found")
    now, heads = found, large
    while True:  # representatives of what is connected so far, until they fit one unit or stop merging
        known = components(now)
        heads = heads.join(known.where("node != component"), "node", "left_anti")
        again = materialize(_chunked(heads.drop("chunks", "chunk", "component"), unit), "heads")
        more = materialize(again.groupBy("cluster", "chunk").applyInPandas(lambda rows: _linked(rows), "a long, b long"), "found")
        now = now.union(more)
        if more.isEmpty() or again.where("chunks > 1").isEmpty():
            break
    known = components(now).withColumnRenamed("component", "known")
    parts = large.drop("component").join(known, "node", "left").withColumn("component", F.coalesce("known", "node")).drop("known")
    parts = materialize(parts, "parts")
    chunks = parts.groupBy("cluster", "chunk").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    near = (100 * F.col("l.most") >= PERCENT * F.col("r.least")) & (100 * F.col("r.most") >= PERCENT * F.col("l.least"))
    left, right = chunks.alias("l"), chunks.alias("r")
    mixed_pairs = left.join(right, (F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.chunk") < F.col("r.chunk")) & near).where("not (l.low = l.high and r.low = r.high and l.low = r.low)")
    pairs = mixed_pairs.select("l.cluster", F.struct("l.chunk", F.col("r.chunk").alias("other")).alias("pair"), F.explode(F.array("l.chunk", "r.chunk")).alias("chunk"))
    crossed = parts.join(pairs, ["cluster", "chunk"]).groupBy("cluster", "pair").applyInPandas(lambda rows: _linked(rows), "a long, b long")
    return now.union(materialize(crossed, "found"))


def jaccard_components(docs: DataFrame, unit: int = UNIT, bucket_mb: float = BUCKET_MB) -> DataFrame:
    """Contract of op2: (doc_id, n_shingles, component_id) of every document."""
    sets = set_digests(docs).groupBy("doc_id").agg(F.min(F.struct("digest", "n")).alias("s"), F.count("*").alias("held")).select("doc_id", "s.digest", "s.n", "held")
    sets = materialize(sets, "sets")
    classes = materialize(sets.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "held")).alias("first"), F.min("n").alias("n")).select("digest", "first.doc_id", "first.held", "n").withColumnRenamed("doc_id", "node"), "classes")
    bits = max(3, int(np.ceil(np.log2(max(1.0, text_megabytes(docs, "text") / bucket_mb)))))
    packed = packed_shingles(representative_words(docs, classes), bits)
    nodes = materialize(linkable(classes.select("node", "n"), packed, bits), "linkable")
    placed = nodes.select("node", "n", "tokens").dropDuplicates(["node"]).join(forest(nodes), "node")
    known = components(forest_links(placed, unit))
    members = sets.join(classes.select("digest", "node"), "digest", "left")
    return members.join(known, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n n1 ON x = n1.doc_id JOIN n n2 ON y = n2.doc_id WHERE 100 * c >= 75 * (n1.n + n2.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""
