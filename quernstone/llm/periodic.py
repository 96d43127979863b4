"""Periodic runs of words: stretches that repeat themselves, by matching of aligned blocks.

A run is a maximal stretch of words with smallest period q and length max(12, 2 q) or more. The words that equal the one q places on
then make a stretch of max(q, 12 - q) at least, and a stretch of 2 B - 1 words holds a whole block of B words that begins at a
multiple of B. So for each power of two B the blocks that begin at its multiples are the keys (integer sequences) of an automaton, which is led over the
document once; an occurrence of a block at one of the distances for which B is the scale (``scales``) is a seed. A seed is
extended exactly in both directions with the names of all stretches of 1, 2, 4, ... words, in as many steps as there are such sizes,
however long the run is. Seeds of multiples of the period give the same stretch, of which the smallest period is kept.

Only words that stand in a six-word sequence that occurs twice can lie in such a stretch, so blocks with other words are no keys, and
documents without such a sequence are through after one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_of, pieces, raw
from .words import Split, WordTable

LEAST = 12
#: Words of a sequence that must occur twice: any period leaves as many words that equal those a period on.
SEQUENCE = LEAST // 2
#: Words that a worker remembers, words of a window over which an automaton is led, and seeds that are extended at once.
MEMO_WORDS, WINDOW, SEEDS = 200_000, 1 << 15, 1 << 18
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def scales(n: int) -> Iterator[tuple[int, int, int]]:
    """(B, least distance, greatest distance) for each size of blocks; together all distances from 1 to n / 2."""
    widest = lambda b: 2 * b - 1
    stretch = lambda q: max(q, LEAST - q)
    at = 1
    while 2 * at <= n:
        b = 1
        while widest(2 * b) <= stretch(at):
            b *= 2
        to = at
        while 2 * (to + 1) <= n and widest(b) <= stretch(to + 1) < widest(2 * b):
            to += 1
        yield b, at, to
        at = to + 1


class Names:
    """Names of all stretches of 1, 2, 4, ... words of a document; equal stretches have equal names."""

    def __init__(self, words: np.ndarray):
        self.n, self.of = len(words), [np.unique(words, return_inverse=True)[1].astype(np.int32)]
        size = 1
        while 2 * size <= self.n:
            x = self.of[-1].astype(np.int64)
            self.of.append(np.unique(x[:-size] << 32 | x[size:], return_inverse=True)[1].astype(np.int32))
            size *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j > i on are equal."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.of) - 1, -1, -1):
            some = np.flatnonzero(j + (1 << level) <= self.n)
            some = some[self.of[level][i[some]] == self.of[level][j[some]]]
            for x in (i, j, out):
                x[some] += 1 << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j > i are equal."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.of) - 1, -1, -1):
            size = 1 << level
            some = np.flatnonzero(i >= size)
            some = some[self.of[level][i[some] - size] == self.of[level][j[some] - size]]
            out[some] += size
            for x in (i, j):
                x[some] -= size
        return out


def seeds(words: np.ndarray, alive: np.ndarray, block: int, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, distance) of aligned blocks that occur again at a distance from least to most. alive: words that may be in blocks."""
    import ahocorasick

    n = len(words)
    dead = np.concatenate(([0], np.cumsum(~alive)))
    starts = np.arange(0, n - block - least + 1, block)
    starts = starts[dead[starts + block] == dead[starts]]
    step = max(WINDOW, 16 * block)
    for at in range(0, n, step):
        own = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + step)]
        if not len(own):
            continue
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        names: dict[tuple, int] = {}
        name = np.empty(len(own), np.int64)
        for i, s in enumerate(own.tolist()):
            key = tuple(words[s : s + block].tolist())
            if key not in names:
                names[key] = len(names)
                automaton.add_word(key, names[key])
            name[i] = names[key]
        automaton.make_automaton()
        begin, end = int(own[0]), min(n, int(own[-1]) + block + most)
        met = np.array([x for hit in automaton.iter(tuple(words[begin:end].tolist())) for x in hit], np.int64).reshape(-1, 2)
        place, which = met[:, 0] + begin - block + 1, met[:, 1]
        # Sorted by block and place, the occurrences of a block within the distances are neighbours.
        wide = np.int64(end + 2 * most + 2)
        line = np.sort(which * wide + place)
        low = np.searchsorted(line, name * wide + own + least)
        many = np.searchsorted(line, name * wide + own + most, "right") - low
        cut = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(many) // SEEDS)) + 1, [len(own)]))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            m = many[i:j]
            found = np.arange(m.sum()) + np.repeat(low[i:j] - (np.cumsum(m) - m), m)
            p = np.repeat(own[i:j], m)
            if len(p):
                yield p, line[found] - np.repeat(name[i:j], m) * wide - p


def runs(words: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
    """Rows of (start, length, period) of all runs, in the order of start and then period. words: a number for each word."""
    alive = np.ones(len(words), bool) if alive is None else alive
    names, found, longest = None, [np.zeros((0, 3), np.int64)], (0, 0, 1)
    for block, least, most in scales(len(words)):
        for p, d in seeds(words, alive, block, least, most):
            # Inside the longest run so far, multiples of its period only lead to it again.
            s, z, q = longest
            new = (d % q != 0) | (p < s) | (p + d + block > s + z)
            p, d = p[new], d[new]
            names = names or Names(words)
            start = p - names.backward(p, p + d)
            length = p + names.forward(p, p + d) + d - start
            fine = length >= np.maximum(LEAST, 2 * d)
            if fine.any():
                found.append(np.unique(np.stack((start, length, d), 1)[fine], axis=0))
                # The first period that a stretch is found with is its smallest.
                longest = max((longest, *found[-1].tolist()), key=lambda r: (r[1], -r[2]))
    every = np.unique(np.concatenate(found), axis=0)
    # Of equal stretches the first has the smallest period.
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[new]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def repeated(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words of many documents stand in a sequence of ``SEQUENCE`` words that their document has twice."""
    n = len(words) - SEQUENCE + 1
    out = np.zeros(len(words), bool)
    if n <= 0:
        return out
    h = doc[:n].astype(np.uint64)
    for j in range(SEQUENCE):
        h = (h ^ words[j : j + n].astype(np.uint64)) * _STEP
        h ^= h >> np.uint64(29)
    h *= _MIX
    inside = doc[:n] == doc[SEQUENCE - 1 :]
    line = np.sort(h[inside])
    twice = np.unique(line[1:][line[1:] == line[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        starts = np.flatnonzero(inside & (twice[at] == h))
        for j in range(SEQUENCE):
            out[starts + j] = True
    return out


def _dropped(found: np.ndarray, n: int) -> np.ndarray:
    """The words that a run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return np.cumsum(step)[:n] > 0


_OUT = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string"


def _described(found: np.ndarray) -> tuple:
    text = "".join(f"{s},{z},{q}\n" for s, z, q in found.tolist())
    best = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *longest, hashlib.sha256(text.encode()).hexdigest())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period and exponent_milli of the longest run (ties: smallest start, then period; null without
    a run); runs_sha256 (of all runs as ``start,length,period`` and a line feed) and collapsed, the text with each run cut to its first period,
    words joined by one space.

    Words are what white space (\\x20, \\x09-\\x0D) separates, numbered from 0; a null text has none. Rows that repeat a doc_id, or
    have none, each get a result. An empty table gives an empty one. Texts of any length are taken whole. Other columns are
    ignored whatever their names.
    """
    kind = dict(docs.dtypes)["doc_id"]
    none = _described(np.zeros((0, 3), np.int64))

    def run(batches):
        table = WordTable(most=MEMO_WORDS)
        for b in pieces(batches, operator="periodic"):
            table.tidy()
            split = Split(raw(b.column(1)))
            words = table.rows(split)
            alive = repeated(words, split.text())
            may = np.concatenate(([0], np.cumsum(alive)))
            rows, texts = [none] * b.num_rows, []
            for i, (at, n) in enumerate(zip(split.first.tolist(), split.n.tolist(), strict=True)):
                keep = range(at, at + n)
                if may[at + n] > may[at]:
                    found = runs(words[at : at + n], alive[at : at + n])
                    if len(found):
                        rows[i] = _described(found)
                        keep = (at + np.flatnonzero(~_dropped(found, n))).tolist()
                texts.append(b" ".join([split.word(w) for w in keep]).decode("utf-8", "replace"))
            columns = [pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array([r[-1] for r in rows]), pa.array(texts, pa.string())], names=["doc_id", *(x.split()[0] for x in _OUT.split(", ")), "collapsed"])

    return docs_of(docs).mapInArrow(run, f"doc_id {kind}, {_OUT}, collapsed string")
