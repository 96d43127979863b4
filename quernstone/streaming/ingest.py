"""Continuous ingestion: a stream of documents is cleaned, cut, embedded and upserted, one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import chunk, embed
from ..sources.store import Store


STRATEGIES = ("semantic", "sentence", "fixed")


def source(columns: list[str]) -> Column:
    """What a document is called: the first of doc_id, source and title that is there and not empty, or doc."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "title") if c in columns], F.lit("doc"))


def chunk_rows(docs: DataFrame, model: Callable[[list[str]], np.ndarray] | None = None, strategy: str = "semantic", size: int = 600, overlap: int = 1, cache: embed.Cache | None = None) -> DataFrame:
    """Documents (doc_id, text, and what else there is) as rows of a store: id from the content, embedding, text, source, and the other
    columns. What is said twice is one row."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    more = [c for c in docs.columns if c not in ("doc_id", "text", "source", "id", "embedding")]
    named = docs.select(source(docs.columns).alias("doc_id"), X.clean(F.col("text")).alias("text"), *more)
    cut = {
        "fixed": lambda d: chunk.fixed(d, size, overlap, more), "sentence": lambda d: chunk.by_sentence(d, size, overlap, more),
        "semantic": lambda d: chunk.semantic(d, model or embed.stand_in, most=size, keep=more),
    }[strategy](named)
    rows = cut.select(X.content_id(F.col("doc_id"), strategy, size, overlap, F.col("text")).alias("id"), "text", F.col("doc_id").alias("source"), *more)
    return embed.embed(rows, model=model, cache=cache, same="id").select("id", "embedding", "text", "source", *more)


def start(stream: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None, **how) -> StreamingQuery:
    """A micro-batch is committed with its number, under the name of the checkpoint, so one that runs twice adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = chunk_rows(batch, **how)
        if not rows.isEmpty():
            store.upsert(rows, (checkpoint, epoch))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
