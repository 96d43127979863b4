"""Lloyd's algorithm with one pass over the vectors per step.

Each partition assigns its vectors and adds them up; only its sums, clusters x dimensions, leave it. Seeds are chosen by k-means++ on a
bounded sample. Several sub-spaces are clustered in the same passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import distances, matrix

SAMPLE = 10_000


def seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ by squared distance; once all points are seeds, seeds repeat at random."""
    out = [x[rng.integers(len(x))]]
    near = ((x - out[0]) ** 2).sum(1)
    while len(out) < k:
        mass = near.sum()
        i = rng.choice(len(x), p=near / mass) if mass > 0 else rng.integers(len(x))
        out.append(x[i])
        near = np.minimum(near, ((x - out[-1]) ** 2).sum(1))
    return np.array(out)


def train(vectors: DataFrame, k: int, parts: int = 1, metric: str = "l2", steps: int = 25, seed: int = 42, sample: int = SAMPLE) -> np.ndarray:
    """Centroids, parts x k x (dim / parts). vectors: id, embedding.

    An empty cluster keeps its centroid. It ends when no coordinate moves by more than 1e-4 and then returns the centroids it had.
    """
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
    if not some:
        return np.zeros((parts, k, 0))
    x = np.array([r[0] for r in some], np.float64)
    rng = np.random.default_rng(seed)
    now = np.stack([seeds(s, k, rng) for s in np.split(x, parts, axis=1)])
    rows = vectors.select("embedding")
    for _ in range(steps):

        def add(batches, now=now):
            total, count = np.zeros(now.shape), np.zeros(now.shape[:2])
            for b in batches:
                for m, s in enumerate(np.split(matrix(b.column(0)), parts, axis=1) if b.num_rows else ()):
                    label = distances(s, now[m], metric).argmin(1)
                    np.add.at(total[m], label, s)
                    count[m] += np.bincount(label, minlength=k)
            for m in range(parts):
                for j in np.flatnonzero(count[m]).tolist():
                    yield pa.RecordBatch.from_pydict({"m": [m], "j": [j], "n": [count[m, j]], "total": [total[m, j].tolist()]})

        sums = rows.mapInArrow(add, "m bigint, j bigint, n double, total array<double>")
        dims = [F.sum(F.element_at("total", i + 1)).alias(f"s{i}") for i in range(now.shape[2])]
        new = now.copy()
        for r in sums.groupBy("m", "j").agg(F.sum("n").alias("n"), *dims).collect():  # parts * k rows
            new[r.m, r.j] = np.array(r[3:]) / r.n
        if np.allclose(now, new, atol=1e-4):
            break
        now = new
    return now
