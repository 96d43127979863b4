"""Retrieval metrics over result and ground-truth DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import rounded

CUTS = (1, 3, 5, 10)


def judged(results: DataFrame, truth: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """qid, hits (array of the ranks that are right, ascending), n_truth.

    results: qid, rank, id; of an id that a query has twice the first place counts and the others close up. truth: qid, id (distinct).
    queries: qid of all queries that count; those of results and truth if not given.
    """
    first = results.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    order = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    truth = truth.select("qid", "id").distinct()
    hits = order.join(truth, ["qid", "id"], "left_semi").groupBy("qid").agg(F.sort_array(F.collect_list("rank")).alias("hits"))
    n = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("n_truth"))
    queries = (queries or results.select("qid").unionByName(truth.select("qid"))).select("qid").distinct()
    return queries.join(hits, "qid", "left").join(n, "qid", "left").select("qid", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("n_truth", F.lit(0)).alias("n_truth"))


def _upto(k: int):
    return F.filter(F.col("hits"), lambda r: r <= k)


def _none(value: float):
    """Of a query without any right answer."""
    return F.when(F.col("n_truth") == 0, F.lit(value))


def recall(k: int):
    return _none(1.0).otherwise(F.size(_upto(k)) / F.col("n_truth"))


def precision(k: int):
    """Over k, not over how many results there are."""
    return F.size(_upto(k)) / F.lit(float(k)) if k > 0 else F.lit(0.0)


def reciprocal_rank():
    return F.when(F.size("hits") > 0, 1.0 / F.element_at("hits", 1)).otherwise(F.lit(0.0))


def average_precision(k: int = 10):
    parts = F.transform(_upto(k), lambda r, i: (i + 1) / r)
    return _none(1.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.least(F.col("n_truth"), F.lit(k)))


def ndcg(k: int):
    if k <= 0:
        return F.lit(1.0)
    gain = lambda a: F.aggregate(F.transform(a, lambda r: 1.0 / F.log2(r + 1.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = gain(F.sequence(F.lit(1), F.least(F.col("n_truth"), F.lit(k)).cast("int")))
    return _none(1.0).otherwise(gain(_upto(k)) / ideal)


def per_query(rows: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    out = [f(k).alias(f"{name}_{k}") for k in cuts for name, f in (("recall", recall), ("precision", precision), ("ndcg", ndcg))]
    return rows.select("qid", *out, reciprocal_rank().alias("rr"), average_precision(10).alias("ap"))


def summary(rows: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row: the means of all metrics and n_queries; no row if there is no query."""
    each = per_query(rows, cuts)
    names = [c for c in each.columns if c not in ("qid", "rr", "ap")]
    return each.agg(*[rounded(F.avg(c)).alias(c) for c in names], rounded(F.avg("rr")).alias("mrr"), rounded(F.avg("ap")).alias("map_10"), F.count(F.lit(1)).alias("n_queries")).filter("n_queries > 0")
