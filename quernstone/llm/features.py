"""Hashed features of words: the whole word and its character n-grams, for many words at once."""

from __future__ import annotations

import zlib

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def subwords(words: list[bytes], buckets: int, sizes: tuple[int, ...] = (3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, number of features of each word).

    The features of a word: the word itself, then the n-grams of its characters with < before and > behind.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), size)
    ids = [np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))]
    owner = [np.arange(len(words))]
    for n in sizes:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h ^ codes[j : j + m]) * _STEP
        inside = of[:m] == of[n - 1 :]
        h = ((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(20))[inside]
        ids.append((h % np.uint64(buckets)).astype(np.int64))
        owner.append(of[:m][inside])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=len(words))


def total(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of n rows each."""
    c = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    ends = np.cumsum(n)
    return c[ends] - c[ends - n]
