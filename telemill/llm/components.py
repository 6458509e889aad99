"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from telemill.llm.common import saved

_EDGE = "u long, v long"
#: Links one task contracts at a time.
_BLOCK = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of a block of edges that are not their own root."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        # The old root follows too, so that long chains halve in every turn.
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0

    def done():
        u, v = forest(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        count += batch.num_rows
        if count >= _BLOCK:
            yield done()
            held, count = [], 0
    if count:
        yield done()


def _marked(links: DataFrame) -> Row:
    """What tells whether links have changed."""
    return links.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of the links ``u, v`` with the smallest node it can reach.

    Each turn first contracts the links inside a task (at most one link per node leaves it), then gives
    every node the smallest of its neighbours (large star, small star). A node's neighbours are never
    gathered: the smallest is an aggregate with partial results, joined back to the links. Turns end when
    the links no longer change, after a logarithmic number. Links are kept in the shared folder between
    turns. Once so few links are left that a task takes them at a time, it contracts them all. Nodes without a link do
    not appear; null links are left out.
    """
    # Smaller node in v throughout.
    found = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    # Links may be dear to find, so they are found once.
    found = saved(found.mapInArrow(_contract, _EDGE).distinct())
    # Links that are stars already need one turn.
    mark = _marked(found)
    while mark.n > _BLOCK:
        # A task gets up to a block, as many tasks with few links each would contract little.
        links = found.coalesce(1 + mark.n // _BLOCK).mapInArrow(_contract, _EDGE).distinct()
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: larger neighbours point to the smallest one.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: smaller neighbours and the node itself point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = saved(
            small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        now = _marked(found)
        if now == mark:
            break
        mark = now
    if mark.n <= _BLOCK:
        found = saved(found.coalesce(1).mapInArrow(_contract, _EDGE))
    flat = found.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return flat.unionByName(flat.select(F.col("root").alias("node"), "root").distinct())
