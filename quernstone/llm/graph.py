"""Connected components by alternating large-star and small-star steps, all in joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

#: Edges that a task joins into trees at once.
EDGES = 1 << 20
#: Up to so many edges in all, a node may have all of them in one task (2 MB); beyond, edges of heavy nodes stay dealt out.
PLAIN = 1 << 17


def spanning(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is connected to) for all but these smallest nodes."""
    a, b = np.concatenate(left), np.concatenate(right)
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        m = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], m)
        np.minimum.at(root, root[b], m)
        np.minimum.at(root, a, m)
        np.minimum.at(root, b, m)
        root = root[root]
        if (root == before).all():
            break
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _shortened(batches):
    """The edges that a task has, as stars: no more of them than before, and no path is longer."""
    left, right, held = [], [], 0
    for b in batches:
        left.append(b.column(0).to_numpy())
        right.append(b.column(1).to_numpy())
        held += b.num_rows
        if held > EDGES:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(left, right)], names=["a", "b"])
            left, right, held = [], [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(left, right)], names=["a", "b"])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it can reach) for every node that differs from its label.

    edges: a, b (bigint; loops, repeats and either order allowed). Each step only moves every edge to the
    smallest neighbour of one of its ends, so the number of edges never grows; the steps are logarithmic in
    the number of nodes. No edge list or label ever reaches the driver, only counts do. Beyond ``PLAIN`` edges, those of a node that
    has a great part of them stay dealt out and meet a broadcast (spread_join).
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges.mapInArrow(_shortened, "a bigint, b bigint"))
    before = None
    while (now := _mark(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        joined = spread_join(both, cut(least), "a") if now[0] > PLAIN else both.join(least, "a")
        large = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large) if now[0] > PLAIN else large
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = (spread_join(large, cut(small), "a") if now[0] > PLAIN else large.join(small, "a")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct().mapInArrow(_shortened, "a bigint, b bigint"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
