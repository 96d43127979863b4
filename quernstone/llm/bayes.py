"""Near duplicates by MinHash bands with sequential Bayesian verification.

A text is the set of its word shingles. Its signature has 128 minima, of which a byte each is kept; pairs that share the four whole
minima of one of 32 bands are candidates (a pair of similarity s is none with probability (1 - s^4)^32: 5e-8 at 0.8). Signatures of candidates
are compared in batches of ``BATCH`` bytes. With a flat prior of the similarity s, bytes agree with probability
s + (1 - s) / 256, and after m of n the posterior probability that s reaches the threshold is a ratio of two binomial sums
(``posterior``). A pair goes as soon as that is below ``MISS``; most dissimilar ones after the first batch. Survivors are verified
on their whole sets. ``miss`` gives the exact probability that a pair of a given similarity is dropped on the way.

Equal sets are one from the start, and lists of candidates are held against one of their members each (minhash.links), so groups of
thousands of copies are joined without their pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, docs_of, pieces, raw, spread_join
from .graph import components
from .minhash import SIMILAR, links, set_id, sets_by, shingles
from .simhash import SEED

BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
#: Bytes of signatures that are compared before it is decided again.
BATCH = 16
#: The least posterior probability, of a similarity that reaches the threshold, with which a pair stays.
MISS = 1e-6
_RNG = np.random.default_rng(SEED + 13)
_FACTOR, _SHIFT = _RNG.integers(0, 1 << 63, (2, SIZE, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _at_most(m: int, n: int, p: float) -> float:
    """Of n trials with probability p at most m succeed."""
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(m + 1))


def _agree(s: float) -> float:
    return s + (1 - s) / 256


def posterior(m: int, n: int, threshold: float) -> float:
    """Probability that the similarity is the threshold or more, if m of n bytes agree and all similarities were equally likely."""
    return _at_most(m, n + 1, _agree(threshold)) / _at_most(m, n + 1, _agree(0.0))


def bounds(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch, the fewest bytes that must have agreed."""
    return [next(m for m in range(n + 1) if posterior(m, n, threshold) >= miss) for n in range(BATCH, SIZE + 1, BATCH)]


def miss(s: float, fewest: list[int]) -> float:
    """Probability that a pair of similarity s is dropped by any batch."""
    p = _agree(s)
    step = [comb(BATCH, i) * p**i * (1 - p) ** (BATCH - i) for i in range(BATCH + 1)]
    alive = np.ones(1)
    for least in fewest:
        alive = np.convolve(alive, step)
        alive[:least] = 0
    return float(1 - alive.sum())


def signature(shingled: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A byte of each minimum, and the keys of the bands; nothing for an empty set."""
    if not len(shingled):
        return b"", np.zeros(0, np.int64)
    least = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingled), 1024):
        np.minimum(least, (shingled[a : a + 1024] * _FACTOR + _SHIFT).min(1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _FOLD
        keys ^= keys >> np.uint64(29)
    return (least >> np.uint64(32)).astype(np.uint8).tobytes(), keys.view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, set_id, size (of the set), sketch, keys of every row."""

    def run(batches):
        for b in pieces(batches):
            sets = [shingles(x, words) for x in raw(b.column(1))]
            both = [signature(s) for s in sets]
            ends = np.cumsum([0, *(len(k) for _, k in both)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([k for _, k in both])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in both], pa.binary()), listed], names=["doc_id", "set_id", "size", "sketch", "keys"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, set_id bigint, size bigint, sketch binary, keys array<bigint>")


def sieve(fewest: list[int]):
    """Whether pairs of signatures pass all batches."""

    def keep(x: pa.Array, y: pa.Array) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(z.to_pylist()), np.uint8).reshape(-1, SIZE) for z in (x, y))
        alive, agree = np.arange(len(x)), np.zeros(len(x), np.int64)
        for at, least in zip(range(0, SIZE, BATCH), fewest, strict=True):
            agree[alive] += (x[alive, at : at + BATCH] == y[alive, at : at + BATCH]).sum(1)
            alive = alive[agree[alive] >= least]
        out = np.zeros(len(x), bool)
        out[alive] = True
        return out

    return keep


def near_duplicates(docs: DataFrame, words: int = 4, chance: float = MISS) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable, itself included), kept (whether it is the smallest).

    Links join sets with a Jaccard similarity of 0.8 or more. Words are lower-cased (A-Z); a text of fewer than ``words`` words is one
    shingle. Texts without words, null ones among them, are linked with nothing, not even with each other. Rows that repeat a doc_id each
    get a result. A row without a doc_id names no component: it has that of its set, or null and is kept. An empty table gives an
    empty one. Texts of any length are taken whole. Other columns are ignored whatever their names.
    """
    up, down = SIMILAR
    docs = docs_of(docs)
    prints = cut(signatures(docs, words))
    groups = cut(prints.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")))
    named = groups.filter("rep is not null and size > 0")
    labels = components(links(named, sets_by(docs, named, words), sieve(bounds(up / down, chance))))
    parts = named.join(labels, named.set_id == labels.node, "left").select("set_id", "rep", F.coalesce("label", "set_id").alias("part"))
    least = parts.groupBy("part").agg(F.min("rep").alias("component_id"))
    ids = parts.join(least, "part").select("set_id", "component_id")
    found = spread_join(prints.select("doc_id", "set_id", "size"), cut(groups.select("set_id", "n").join(ids, "set_id", "left")), "set_id")
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
