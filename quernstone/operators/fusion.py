"""Rank fusion of a dense and a lexical result list: a full outer join on (query, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, ALPHA = 60, 0.65


def pool_size(k: int, multiplier: int = 2) -> int:
    """How many candidates each side contributes."""
    return max(k * multiplier, 15)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 10, method: str = "rrf", alpha: float = ALPHA, rrf_k: int = RRF_K) -> DataFrame:
    """qid, id, rank, score, dense_rank, sparse_rank, dense_score, sparse_score; ties by id.

    dense, sparse: qid, id, rank, score. ``rrf``: alpha / (rrf_k + dense rank) + (1 - alpha) / (rrf_k + sparse rank), a missing side
    adds nothing. Any other method: alpha * dense score + (1 - alpha) * sparse score, a missing score being 0.
    """
    d = dense.select("qid", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("qid", "id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    both = d.join(s, ["qid", "id"], "full_outer")
    zero = F.lit(0.0)
    if method == "rrf":
        part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), zero)
        score = alpha * part("dense_rank") + (1.0 - alpha) * part("sparse_rank")
    else:
        score = alpha * F.coalesce("dense_score", zero) + (1.0 - alpha) * F.coalesce("sparse_score", zero)
    scored = both.withColumn("dense_score", F.coalesce("dense_score", zero)).withColumn("sparse_score", F.coalesce("sparse_score", zero)).withColumn("score", score)
    order = Window.partitionBy("qid").orderBy(F.floor(F.col("score") * 1e12 + 0.5).desc(), "id")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
    return ranked.select("qid", "id", "rank", "score", "dense_rank", "sparse_rank", "dense_score", "sparse_score")
