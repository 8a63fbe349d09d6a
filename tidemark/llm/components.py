"""Connected components of an edge list.

Each partition first contracts its own edges to a forest, so that what is written
is bounded by its nodes. As long as a forest of all edges fits one task
(``EDGES``, counted first) a last task joins the forests; larger ones are
contracted again in fewer parts while that shrinks them, and what remains goes
through alternating large and small stars, whose steps are grouped minima with
map-side combine and joins that adaptive execution may split. Every step is
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import materialize

EDGES = 2_000_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of every node of the edges."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[label]


def _forests(edges: DataFrame, most: int) -> DataFrame:
    """(a, b) per partition: every node but the smallest of its part, with that smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            total += batch.num_rows
            if total > 2 * most:
                held = [contracted(*(np.concatenate(x) for x in zip(*held)))]
                total = min(len(held[0][0]), most)
        if held:
            node, root = contracted(*(np.concatenate(x) for x in zip(*held)))
            own = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], names=["a", "b"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null").mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.where("b < a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def _starred(now: DataFrame) -> DataFrame:
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now
        before = state
        now = materialize(_star(_star(now, True), False), "links")


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(a, b) links -> (node, component), the smallest node reachable; only nodes with a link appear."""
    now = materialize(_forests(edges, most), "links")
    count = now.count()
    while count > most:
        fewer = materialize(_forests(now.repartition(-(-count // most), "b"), most), "links")
        left = fewer.count()
        now, shrunk, count = fewer, left < count * 0.8, left
        if not shrunk:
            break
    now = _starred(now) if count > most else materialize(_forests(now.coalesce(1), most), "links")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
