"""Cutting documents into chunks: fixed windows, packed sentences, or where the meaning shifts.

Where the next chunk starts depends on where the last one ended, so the cutting runs in an Arrow kernel over each partition; sentences
themselves are found by Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Documents that are Python objects at once; a batch of Arrow may be ten thousand.
SLICE = 64
FIELDS = "chunk_index int, chunk_id string, strategy string, text string, char_start int, char_end int, sentence_count int, shift_score double"


def fixed_windows(text: str, size: int = 500, overlap: int = 100) -> Iterator[tuple[int, int]]:
    """(start, end) of windows of ``size`` characters. A window that would split a word ends at its last space, if that lies beyond half of it."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            space = text.rfind(" ", start, end)
            if space > start + size // 2:
                end = space
        yield start, end
        if end == len(text):
            return
        start += max(end - start - overlap, 1)


def packed(lengths: list[int], most: int = 600, overlap: int = 1) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of sentences that fit into ``most`` characters, each with a space behind it; a longer sentence stands alone."""
    i = 0
    while i < len(lengths):
        j, total = i, 0
        while j < len(lengths) and (j == i or total + lengths[j] + 1 <= most):
            total += lengths[j] + 1
            j += 1
        yield i, j
        if j == len(lengths):
            return
        i = max(j - overlap, i + 1)


def shifts(lengths: list[int], gaps: np.ndarray, percentile: float = 80.0, most: int = 800, least: int = 100) -> Iterator[tuple[int, int, float | None]]:
    """(first, end, distance at the cut) of runs of sentences, cut where the distance to the next one is above the percentile and the run
    is long enough, or where the next sentence would make it too long. The last run has no distance."""
    limit = float(np.percentile(gaps, percentile)) if len(gaps) else 0.5
    first, total = 0, lengths[0]
    for i, d in enumerate(gaps.tolist(), 1):
        if (d > limit and total >= least) or total + lengths[i] > most:
            yield first, i, d
            first, total = i, lengths[i]
        else:
            total += lengths[i] + 1
    yield first, len(lengths), None


def _chunks(docs: DataFrame, cut: Callable, strategy: str, short: str, with_sentences: bool, keep: list[str] | None = None) -> DataFrame:
    extra = [X.sentences(F.col("text")).alias("sentences")] if with_sentences else []
    keep = keep or []
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"), *extra, *keep)
    kinds = dict(docs.dtypes)
    end = 3 + len(extra)

    def run(batches):
        for b in (x.slice(at, SLICE) for x in batches for at in range(0, x.num_rows, SLICE)):
            out: list[dict] = []
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns, strict=True):
                own = dict(zip(keep, row[end:], strict=True))
                for n, piece in enumerate(p for p in cut(*row[2:end]) if p["text"]):
                    out.append(own | {"doc_id": row[0], "chunk_index": n, "chunk_id": f"{row[1]}_{short}_{n}", "strategy": strategy, "char_start": None, "char_end": None, "sentence_count": None, "shift_score": None} | piece)
                if len(out) > 1_000:
                    yield _batch(out, b.schema, keep)
                    out = []
            if out:
                yield _batch(out, b.schema, keep)

    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, {FIELDS}" + "".join(f", `{c}` {kinds[c]}" for c in keep))


def _batch(rows: list[dict], given: pa.Schema, keep: list[str]) -> pa.RecordBatch:
    schema = pa.schema([("doc_id", given.field(0).type), ("chunk_index", pa.int32()), ("chunk_id", pa.string()), ("strategy", pa.string()), ("text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("sentence_count", pa.int32()), ("shift_score", pa.float64()), *[(c, given.field(c).type) for c in keep]])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def fixed(docs: DataFrame, size: int = 500, overlap: int = 100, keep: list[str] | None = None) -> DataFrame:
    """Chunks of docs (doc_id, text), with the columns to keep. char_start and char_end are those before the text is trimmed."""

    def cut(text):
        if text.strip():
            for a, b in fixed_windows(text, size, overlap):
                yield {"text": text[a:b].strip(), "char_start": a, "char_end": b}

    return _chunks(docs, cut, "fixed", "fixed", False, keep)


def by_sentence(docs: DataFrame, most: int = 600, overlap: int = 1, keep: list[str] | None = None) -> DataFrame:
    def cut(text, sentences):
        for a, b in packed([len(s) for s in sentences], most, overlap):
            yield {"text": " ".join(sentences[a:b]).strip(), "sentence_count": b - a}

    return _chunks(docs, cut, "sentence", "sent", True, keep)


def semantic(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] | None = None, percentile: float = 80.0, most: int = 800, least: int = 100, keep: list[str] | None = None) -> DataFrame:
    """embed: sentences to a matrix; without it sentences are packed. A text of at most one sentence is one chunk."""

    def cut(text, sentences):
        if len(sentences) <= 1:
            yield {"text": text.strip()}
            return
        if embed is None:
            for a, b in packed([len(s) for s in sentences], most, 1):
                yield {"text": " ".join(sentences[a:b]).strip(), "sentence_count": b - a}
            return
        e = np.asarray(embed(sentences), np.float64)
        n = np.linalg.norm(e, axis=1, keepdims=True)
        e = e / np.where(n == 0, 1e-10, n)
        for a, b, d in shifts([len(s) for s in sentences], 1.0 - (e[:-1] * e[1:]).sum(1), percentile, most, least):
            yield {"text": " ".join(sentences[a:b]).strip(), "shift_score": d}

    return _chunks(docs, cut, "semantic", "sem" if embed else "sent", True, keep)


def length_stats(chunks: DataFrame) -> DataFrame:
    """strategy, count and the mean, smallest, largest and (population) standard deviation of chunk lengths."""
    n = F.length("text")
    return chunks.groupBy("strategy").agg(F.count(F.lit(1)).alias("count"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.stddev_pop(n).alias("std_length"))


def compare(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """length_stats of the three strategies at 400/80, 450/1 and 500."""
    parts = fixed(docs, 400, 80), by_sentence(docs, 450, 1), semantic(docs, embed, most=500).withColumn("strategy", F.lit("semantic"))
    return length_stats(parts[0].unionByName(parts[1]).unionByName(parts[2]))
