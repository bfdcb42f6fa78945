"""Connected components of an edge table.

Each partition first contracts its own edges to stars (vectorised minimum labels with pointer jumping), which
leaves at most one edge a node and partition.  What is left is contracted in one task if it is at most
`SMALL_EDGES` edges, a checked bound of that task's memory.  Beyond it, large-star and small-star steps alternate on the
table: a minimum per node (pre-aggregated before its shuffle) and a join back, so no node's edges are gathered in
one place; each step is written to the shared folder, which cuts the lineage, and the old one is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

SMALL_EDGES = 4_000_000


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the edges' nodes."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _contract(with_roots: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            total += batch.num_rows
            if total > 2 * SMALL_EDGES:  # contract what is held and go on
                node, root = local_roots(*(np.concatenate(x) for x in zip(*held)))
                held, total = [(node[node != root], root[node != root])], 0
        if held:
            node, root = local_roots(*(np.concatenate(x) for x in zip(*held)))
            keep = slice(None) if with_roots else node != root
            node, root = node[keep], root[keep]
            for lo in range(0, len(node), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + 100_000]), pa.array(root[lo : lo + 100_000])], names=["node", "root"])

    return run


def _with_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, a: str, b: str, small: int = SMALL_EDGES) -> DataFrame:
    """(node, root): every node with an edge to another, and the smallest node it reaches (itself for roots)."""
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = blocks.materialize(own.mapInArrow(_contract(False), "node bigint, root bigint").select(F.col("node").alias("u"), F.col("root").alias("v")), "edges")
    if e.count() <= small:
        return blocks.materialize(e.coalesce(1).mapInArrow(_contract(True), "node bigint, root bigint"), "components")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        near = _with_least(large)
        less = near.select("u", F.col("m").alias("v")).unionByName(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = blocks.materialize(less, "edges")
        now = tuple(new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        blocks.drop_table(e)
        e = new
        if now == mark:
            break
        mark = now
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
