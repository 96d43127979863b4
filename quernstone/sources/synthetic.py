"""Vectors made up with a seed, for measurements without a download."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def clustered(spark: SparkSession, n: int, dim: int, noise: float = 0.15, seed: int = 42, first: int = 0) -> DataFrame:
    """id, embedding of n normal vectors around max(10, n // 100) centres. A row depends on the seed and its id only, so any part of the
    table can be made anywhere and again; ``first`` moves the ids, for queries around the same centres."""
    centres = np.random.default_rng(seed).standard_normal((max(10, n // 100), dim))

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            rows = np.empty((len(ids), dim), np.float32)
            for i, x in enumerate(ids.tolist()):
                r = np.random.default_rng((seed, x))
                rows[i] = centres[r.integers(len(centres))] + noise * r.standard_normal(dim)
            offsets = pa.array(np.arange(len(ids) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=["id", "embedding"])

    return spark.range(first, first + n).mapInArrow(run, "id bigint, embedding array<float>")
