"""Exact top-k inner products, norm-sorted, with rotated partial sums.

Vectors become integers. A rotation to the axes of the second-moment matrix
(its singular vectors), summed over all vectors, moves most of a product into
the first coordinates. Queries first meet the longest of the vectors, one in
``BANDS``, which gives each a score and a vec_id that its k-th best cannot fall
behind. Candidates are dealt into blocks by bands of norm, queries by the norm
that a candidate needs to reach their bound, and a pair of blocks is made only
if its longest candidate can. Such a pair is one task: candidates go by
descending norm; a chunk whose longest vector cannot reach the bound by
Cauchy-Schwarz ends the block, and a candidate whose partial sum plus the
product of the residual norms stays below it is dropped. The rest get exact
integer scores.

Pairs of queries and candidates are quadratic by nature. Blocks hold at most
``VALUES`` components, so a query travels once for every such block of
candidates and a candidate once for every such block of queries; a task holds
two blocks, and scores of ``QUERIES`` by ``CHUNK`` at a time. Equal norms are
spread over the bands and equal labels over the blocks by hash; per-block
winners are limited again before they are gathered per query. Where norms
hardly differ and the spectrum is flat, the bounds drop little.

The bounds use floating point and are widened by ``SLACK``; they only choose
what is scored exactly. Scores are summed in the narrowest type that holds all
of a block's sums without rounding.

Defined results: vectors without vec_id, null or empty, or with a null or
non-finite component take no part; vectors meet those of their own length;
equal rows count once; rows that share a vec_id are all candidates, and the
least of them queries; no vector is a candidate for its own vec_id; other
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import materialize, spread

K, EVERY, SCALE = 5, 50, 256
BANDS, TASKS, LEAST, VALUES = 32, 64, 4096, 1 << 22
QUERIES, CHUNK, FIRST = 512, 2048, 64
PARTIAL, SLACK = 16, 1e-5
ROTATIONS = 8
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
VECTOR = "vec_id long, dim int, width int, v binary, length double, ordered binary"


def _encoded(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """The vectors that take part as little-endian integers of the least width; queries also in a form that sorts like the array."""
    names = [field.split()[0] for field in VECTOR.split(", ")]
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        dims = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(dims):
            continue
        ids, starts = batch.column(0).to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
        usable = np.logical_and.reduceat(np.isfinite(flat), starts)
        for dim in np.unique(dims[usable]):
            at = np.flatnonzero(usable & (dims == dim))
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * flat[starts[at][:, None] + np.arange(dim)])
                length = np.linalg.norm(x, axis=1)
            with np.errstate(invalid="ignore"):
                v = np.where(x >= 2.0**63, HIGHEST, np.where(x < -(2.0**63), LOWEST, x.astype(np.int64)))
            low, high = v.min(axis=1), v.max(axis=1)
            width = sum(((low < -(1 << b)) | (high >= 1 << b)).astype(int) for b in (7, 15, 31))
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                raw, size = v[own].astype(f"<i{1 << w}").tobytes(), int(dim) << w
                query = ids[at[own]] % every == 0
                ordered = [(v[i].view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes() if q else None for i, q in zip(own, query)]
                many = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at[own]], pa.int64()), pa.array(np.full(many, dim), pa.int32()), pa.array(np.full(many, w), pa.int32()),
                        pa.array([raw[i : i + size] for i in range(0, many * size, size)], pa.binary()), pa.array(length[own], pa.float64()), pa.array(ordered, pa.binary()),
                    ],
                    names=names,
                )


def _stacked(dim: int, width: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Encoded vectors of one length as a matrix of their widest type."""
    out = np.empty((len(v), dim), f"<i{1 << int(width.max(initial=0))}")
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(v[at]), f"<i{1 << w}").reshape(len(at), dim)
    return out


def integer_vectors(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """The rows that take part, once each: vec_id, dim, encoded vector, norm; stored."""
    kept = vectors.where("vec_id is not null and embedding is not null").where(F.size("embedding") > 0)
    plain = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return materialize(plain.mapInArrow(lambda batches: _encoded(batches, every), VECTOR).distinct(), "vectors")


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For the commonest vector lengths, the axes of the second moments, largest first; others stay unrotated."""
    common = [r["dim"] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(ROTATIONS).collect()]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for rows in batches:
            for dim, own in rows.groupby("dim"):
                x = _stacked(dim, own["width"].to_numpy(), own["v"].to_numpy()).astype(float)
                held[dim] = held.get(dim, 0) + x.T @ x
        yield pd.DataFrame({"dim": list(held), "moments": [m.tobytes() for m in held.values()]})

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "moments": [sum(np.frombuffer(m) for m in rows["moments"]).tobytes()]})

    found: dict[int, np.ndarray] = {}
    summed = vectors.where(F.col("dim").isin(common)).select("dim", "width", "v").mapInPandas(sums, "dim int, moments binary")
    for row in summed.groupBy("dim").applyInPandas(together, "dim int, moments binary").collect():
        moments = np.frombuffer(row["moments"]).reshape(row["dim"], row["dim"])
        found[row["dim"]] = np.linalg.eigh(moments)[1][:, ::-1]
    return found


def _scores(q: np.ndarray, v: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact products of the pairs at (row of q, row of v)."""
    out = np.empty(len(at[0]), np.int64)
    for i in range(0, len(out), CHUNK):
        r, c = (x[i : i + CHUNK] for x in at)
        out[i : i + CHUNK] = (q[r] * v[c]).sum(axis=1).astype(np.int64)
    return out


def best_of_block(ids: np.ndarray, q: np.ndarray, floor: np.ndarray, own: np.ndarray, v: np.ndarray, axes: np.ndarray | None, k: int, last: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best in one block, those of at least its floor and there of no larger vec_id than ``last``."""
    qf, vf = q.astype(float), v.astype(float)
    norm, qn = np.linalg.norm(vf, axis=1), np.linalg.norm(qf, axis=1)
    order = np.argsort(-norm, kind="stable")
    own, v, vf, norm = own[order], v[order], vf[order], norm[order]
    first = slice(None, PARTIAL) if axes is None else axes[:, :PARTIAL]
    partial = lambda x: x[:, first] if axes is None else x @ first
    # The product of the residual norms is one more coordinate.
    whole = lambda x, n, p: np.column_stack([p, np.sqrt(np.maximum(n * n - (p * p).sum(axis=1), 0))])
    qr, vr = whole(qf, qn, partial(qf)), whole(vf, norm, partial(vf))
    most = float(qn.max(initial=0)) * float(norm.max(initial=0))
    wide = not most < 2.0**52
    if most < 2.0**24:
        qf, vf, qr, vr = (x.astype(np.float32) for x in (qf, vf, qr, vr))
    elif wide:
        qf, vf = q.astype(object), v.astype(object)
    floor = np.where(np.isneginf(floor), LOWEST, floor).astype(np.int64) if floor.dtype.kind == "f" else floor.copy()
    last = np.full(len(ids), HIGHEST) if last is None else last.copy()
    scores, found = np.full((len(ids), k), LOWEST), np.full((len(ids), k), HIGHEST)
    for start in range(0, len(ids), QUERIES):
        some = np.arange(start, min(start + QUERIES, len(ids)))
        i, step = 0, CHUNK if floor[some].min() > LOWEST else FIRST
        while i < len(own):
            part, slack = slice(i, i + step), SLACK * (1 + qn[some] * norm[i])
            live = some[~(qn[some] * norm[i] + slack < floor[some])]
            if not len(live):
                break
            under = (floor[live] - SLACK * (1 + qn[live] * norm[i])).astype(qr.dtype)
            keep = ~(qr[live] @ vr[part].T < under[:, None])
            if wide or keep.mean() < 0.1:
                r, c = np.nonzero(keep)
                s = _scores(qf[live], vf[part], (r, c))
                good = s >= floor[live[r]]
                r, c, s = r[good], c[good], s[good]
            else:
                exact = qf[live] @ vf[part].T
                r, c = np.nonzero(exact >= floor[live].astype(exact.dtype)[:, None])
                s = exact[r, c].astype(np.int64)
            r, o = live[r], own[part][c]
            good = (o != ids[r]) & ((s > floor[r]) | (o <= last[r]))
            r, o, s = r[good], o[good], s[good]
            if len(r):
                u = np.unique(r)
                r, o, s = np.concatenate([r, np.repeat(u, k)]), np.concatenate([o, found[u].ravel()]), np.concatenate([s, scores[u].ravel()])
                at = np.lexsort((o, ~s, r))
                r, o, s = r[at], o[at], s[at]
                top = np.arange(len(r)) - np.searchsorted(r, r) < k
                scores[u], found[u] = s[top].reshape(-1, k), o[top].reshape(-1, k)
                full = u[scores[u, -1] > LOWEST]
                score, o = scores[full, -1], found[full, -1]
                last[full] = np.where(score > floor[full], o, np.where(score == floor[full], np.minimum(o, last[full]), last[full]))
                floor[full] = np.maximum(floor[full], score)
            i, step = i + step, min(2 * step, CHUNK)
    r, c = np.nonzero(scores > LOWEST)
    return list(zip(ids[r].tolist(), found[r, c].tolist(), scores[r, c].tolist()))


def _banded(rows: DataFrame, measure: Column) -> DataFrame:
    """Add ``n``, the rows of the same length of vector, and ``band``, from 0 to BANDS - 1 by ascending measure."""
    cuts = F.percentile_approx("measure", [i / BANDS for i in range(1, BANDS)]).alias("cuts")
    known = rows.withColumn("measure", measure)
    counts = known.groupBy("dim").agg(cuts, F.count("*").alias("n"))
    return known.join(F.broadcast(counts), "dim").withColumn("band", F.size(F.filter("cuts", lambda c: c <= F.col("measure")))).drop("cuts", "measure")


def _by_norm(vectors: DataFrame) -> DataFrame:
    """Bands of norm; equal norms are told apart by hash, so that they fill several."""
    spot = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) / float(1 << 20) * 1e-9
    return _banded(vectors, F.col("length") * (1 + spot) + spot)


def _blocks(banded: DataFrame, ids: str, tasks: int) -> DataFrame:
    """(dim, block, reach, packed): rows dealt by band, then by hash, into blocks of bounded size.

    ``reach`` is the largest norm of a block of candidates; for queries, the least
    norm by which a candidate reaches the floor of one of them.
    """
    size = F.least(F.greatest(F.lit(VALUES) / F.col("dim"), F.lit(1.0)), F.greatest(F.col("n") / F.lit(tasks), F.lit(float(LEAST))))
    bands = F.least(F.lit(BANDS), F.ceil(F.col("n") / size)).cast("long")
    parts = F.ceil(F.col("n") / bands / size).cast("long")
    block = F.floor(F.col("band") * bands / F.lit(BANDS)) * parts + F.pmod(F.xxhash64(ids, "v"), parts)
    floors = ids == "query_id"
    dealt = banded.select("dim", block.cast("long").alias("block"), F.col(ids).alias("id"), "width", "v", "length", *(["floor", "last"] if floors else []))

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        dim, norm = int(own["dim"].iloc[0]), own["length"].to_numpy()
        held = [own["id"].to_numpy(), _stacked(dim, own["width"].to_numpy(), own["v"].to_numpy())]
        reach = norm.max()
        if floors:
            held += [own["floor"].to_numpy(), own["last"].to_numpy()]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = (held[2] - SLACK) / (norm * (1 + SLACK))
            reach = np.where((held[2] > LOWEST) & (norm > 0), need, -np.inf).min()
        return pd.DataFrame({"dim": [dim], "block": [own["block"].iloc[0]], "reach": [float(reach)], "packed": [pickle.dumps(held, protocol=5)]})

    return dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block long, reach double, packed binary")


def _meet(queries: DataFrame, candidates: DataFrame, axes: dict[int, np.ndarray], k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each candidate block that can hold one."""
    need = F.when((F.col("length") > 0) & (F.col("floor") > LOWEST), F.col("floor") / F.col("length")).otherwise(float("-inf"))
    q, c = materialize(_blocks(_banded(queries, need), "query_id", 1), "query-blocks"), materialize(_blocks(candidates, "vec_id", TASKS), "blocks")
    left, right = (x.select("dim", F.col("block").alias(b), F.col("reach").alias(r)) for x, b, r in ((q, "qb", "need"), (c, "cb", "reach")))
    pairs = left.join(right, "dim").where("not reach < need").select("dim", "qb", "cb")
    sent = lambda x, b, side: x.withColumnRenamed("block", b).join(F.broadcast(pairs), ["dim", b]).select("dim", "qb", "cb", F.lit(side).alias("side"), "packed")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(rows["side"], rows["packed"]))
        ids, vectors, floor, last = pickle.loads(held[0])
        own, v = pickle.loads(held[1])
        return pd.DataFrame(best_of_block(ids, vectors, floor, own, v, axes.get(int(rows["dim"].iloc[0])), k, last), columns=["query_id", "vec_id", "score"], dtype="int64")

    # Few bytes, but many products: adaptive execution would merge the pairs into one task.
    met = spread(sent(q, "qb", 0).union(sent(c, "cb", 1)), "dim", "qb", "cb")
    return met.groupBy("dim", "qb", "cb").applyInPandas(run, "query_id long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """Contract of op8: (query_id, rank, vec_id, score) for the vectors whose id is divisible by ``every``."""
    own = integer_vectors(vectors, every)
    axes = rotations(own)
    least = F.min_by(F.struct("dim", "width", "v", "length"), "ordered").alias("least")
    queries = own.where("ordered is not null").groupBy(F.col("vec_id").alias("query_id")).agg(least).select("query_id", "least.*")
    banded = _by_norm(own)
    unknown = {"floor": F.lit(LOWEST), "last": F.lit(HIGHEST)}
    seeds = _by_norm(banded.where(F.col("band") == BANDS - 1).drop("band", "n"))
    known = _first(_meet(queries.withColumns(unknown), seeds, axes, k), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"), F.col("vec_id").alias("last"))
    floored = queries.join(known, "query_id", "left").withColumns({c: F.coalesce(c, x) for c, x in unknown.items()})
    return _first(_meet(floored, banded, axes, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM c q JOIN c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
