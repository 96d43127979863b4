"""Inverted-file search: vectors in the cells of their nearest centroids, queries probe the nearest cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.filters import compile_filter
from . import kmeans, knn

#: Cells are a parameter of the index and never grow with the data, so the centroid side of a join is bounded.
MAX_CELLS = 65_536


def train(vectors: DataFrame, nlist: int = 16, metric: str = "cosine", steps: int = 25, seed: int = 42) -> DataFrame:
    """cluster, centroid. Seeding is always by squared distance, assignment by the metric."""
    if not 1 <= nlist <= MAX_CELLS:
        raise ValueError(f"nlist must be between 1 and {MAX_CELLS}")
    c = kmeans.train(vectors, nlist, 1, metric, steps, seed)[0]
    return vectors.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(c) if len(x)], "cluster int, centroid array<double>")


def assign(vectors: DataFrame, centroids: DataFrame, metric: str = "cosine") -> DataFrame:
    """vectors with the number of their nearest centroid (the smallest of equally near ones) in ``cluster``."""
    cells = F.broadcast(centroids.agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("_cells")))
    near = F.transform(F.col("_cells"), lambda c: F.struct(F.round(V.distance(F.col("embedding"), c["centroid"], metric), 12).alias("d"), c["cluster"].alias("cluster")))
    return vectors.crossJoin(cells).withColumn("cluster", F.array_min(near)["cluster"]).drop("_cells")


def lloyd_step(assigned: DataFrame) -> DataFrame:
    """cluster, j, mean: the next centroids, one row a coordinate."""
    each = assigned.select("cluster", F.posexplode(V.as_double(F.col("embedding"))).alias("j", "x"))
    return each.groupBy("cluster", "j").agg(F.avg("x").alias("mean"))


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int = 4, metric: str = "cosine") -> DataFrame:
    """qid, q, cluster: the nprobe nearest cells of each query (at least one, at most all)."""
    d = V.distance(F.col("q"), F.col("centroid"), metric)
    near = queries.select("qid", F.col("embedding").alias("q")).crossJoin(F.broadcast(centroids)).withColumn("d", d)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("d", 12), "cluster"))
    return near.withColumn("r", rank).filter(F.col("r") <= max(1, nprobe)).select("qid", "q", "cluster")


def search(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, nprobe: int = 4, metric: str = "cosine", query_filter: dict | None = None) -> DataFrame:
    """qid, id, rank, distance, score, cluster. Queries go to the scan in passes, as in exact search; of a slice of rows, those of a cell
    meet the queries that probe it, as two matrices. Of rows stored in folders by cluster only those of probed cells are read.

    The filter works inside the probed cells, so fewer than k rows may come back though more match elsewhere.
    """
    c = compile_filter(query_filter, assigned.schema)
    rows = (assigned if c is None else assigned.filter(c)).select("id", "embedding", "cluster")
    cells = centroids.orderBy("cluster").collect()  # at most MAX_CELLS, a parameter of the index
    numbers, places = np.array([r.cluster for r in cells], np.int64), np.array([r.centroid for r in cells], np.float64)
    few, probed = min(max(1, nprobe), len(cells)), set()

    def groups():
        for qids, q in knn.passes(queries):
            asks: dict[int, list[int]] = {}
            for a in range(0, len(qids), knn.QUERY_BLOCK):
                near = np.argsort(np.round(knn.distances(q[a : a + knn.QUERY_BLOCK], places, metric), 12), axis=1, kind="stable")[:, :few]
                for i, own in enumerate(numbers[near].tolist(), a):
                    for cell in own:
                        asks.setdefault(cell, []).append(i)
            probed.update(asks)
            yield qids, (q, {cell: np.array(x) for cell, x in asks.items()})

    def parts(batch, asked):
        q, asks = asked
        x, cluster = knn.matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(cluster, kind="stable")
        found, first = np.unique(cluster[order], return_index=True)
        for cell, own in zip(found.tolist(), np.split(order, first[1:]), strict=True):
            for a in range(0, len(asks.get(cell, ())), knn.QUERY_BLOCK):
                some = asks[cell][a : a + knn.QUERY_BLOCK]
                yield own, some, knn.distances(x[own], q[some], metric), np.full(len(own), cell)

    asked = list(groups())
    best = knn.nearest(rows.filter(F.col("cluster").isin(sorted(probed))), asked, parts, k, queries.schema["qid"])
    return best.select("qid", "id", "rank", "distance", V.score(F.col("distance"), metric).alias("score"), F.col("tag").cast(assigned.schema["cluster"].dataType).alias("cluster"))


def cell_stats(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row: n_cells, n_vectors and the mean, largest and smallest number of vectors in a cell; empty cells count."""
    sizes = centroids.select("cluster").join(assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_vectors"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"))
