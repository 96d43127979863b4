"""Second-stage ranking: lexical density by default, or any model given as a function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sigmoid


def density(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that stand in the text as substrings, plus a half if the whole query does."""
    q, t = F.lower(query), F.lower(F.coalesce(text, F.lit("")))
    words = F.array_distinct(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    found = F.size(F.filter(words, lambda w: F.contains(t, w)))
    return found / F.greatest(F.size(words), F.lit(1)) + F.when(F.contains(t, q), 0.5).otherwise(0.0)


def rerank(candidates: DataFrame, top_k: int = 5, min_score: float | None = None, model: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """candidates (qid, query, id, rank, text, ...) with original_rank, rerank_score and the new rank, the top_k of each query.

    model: a function of (query, text) columns, a pandas UDF for example, whose logits go through a sigmoid; a row for which it yields null
    or no finite number makes the whole query fall back to lexical density. min_score cuts what is below it or below 15 % of the query's
    best. Ties keep their original order.
    """
    by = Window.partitionBy("qid")
    lexical = sigmoid(2.0 * density(F.col("query"), F.col("text")) - 1.0)
    scored = candidates.withColumnRenamed("rank", "original_rank")
    if model:
        scored = scored.withColumn("_raw", model(F.col("query"), F.col("text")).cast("double"))
        bad = F.col("_raw").isNull() | F.isnan("_raw") | (F.abs("_raw") == float("inf"))
        scored = scored.withColumn("_bad", F.max(bad).over(by))
        scored = scored.withColumn("rerank_score", F.when(F.col("_bad"), lexical).otherwise(sigmoid(F.col("_raw")))).drop("_raw", "_bad")
    else:
        scored = scored.withColumn("rerank_score", lexical)
    ranked = scored.withColumn("rank", F.row_number().over(by.orderBy(F.floor(F.col("rerank_score") * 1e12 + 0.5).desc(), "original_rank")).cast("bigint"))
    if min_score is not None:
        ranked = ranked.withColumn("_best", F.max("rerank_score").over(by)).filter(F.col("rerank_score") >= F.greatest(F.lit(float(min_score)), F.col("_best") * 0.15)).drop("_best")
    return ranked.filter(F.col("rank") <= top_k)
