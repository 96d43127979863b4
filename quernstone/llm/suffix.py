"""Quality rules with suffix-array repetition.

The words of a whole text get a suffix array (prefix doubling that only re-sorts what is still tied)
and the longest common prefixes of neighbours in it. A suffix that shares l words with a neighbour in
the array starts a repeated substring that can't be extended to the right (an LCP interval of value l).
The spans of all such substrings of ``min_repeat`` words or more are united; a text is rejected if they
cover more than ``max_covered`` of its words or if one of them has more than ``max_longest`` words.
Many texts share one array, so numpy's cost per call is spread; suffixes of two texts never compare equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_of, pieces, raw
from .words import Split, WordTable

SYMBOLS = b"#*$%&|<>"
_NOT_FIRST = bytes(range(0x80, 0xC0))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def suffix_array(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of word numbers, and lcp[i] = words shared by suffixes sa[i - 1] and sa[i].

    text: the number of the text that each word stands in (ascending); prefixes end at its end.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.searchsorted(text, text, "right")
    key = text.astype(np.int64) * (int(words.max()) + 1) + words
    sa = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[sa][1:] != key[sa][:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, k = [rank.astype(np.int32)], 1
    tied = ~(new & np.concatenate((new[1:], [True])))
    slots = np.flatnonzero(tied)
    while len(slots):
        at = sa[slots]
        after = at + k
        second = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + second
        order = np.argsort(both, kind="stable")
        at, both = at[order], both[order]
        sa[slots] = at
        new = np.concatenate(([True], both[1:] != both[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank.astype(np.int32))
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        k *= 2
    lcp = np.zeros(n, np.int64)
    i = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, shared = sa[i - 1].copy(), sa[i].copy(), np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r = levels[level]
        inside = (a < end[sa[i - 1]]) & (b < end[sa[i]])
        same = inside & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)]) & (a != b)
        step = np.where(same, 1 << level, 0)
        a, b, shared = a + step, b + step, shared + step
    lcp[i] = shared
    return sa, lcp


def repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeated substring of its text that starts there."""
    sa, lcp = suffix_array(words, text)
    out = np.zeros(len(words), np.int64)
    if len(sa):
        out[sa] = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words lies in one of the spans."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


def quality_rules(docs: DataFrame, min_words: int = 50, min_repeat: int = 10, max_covered: float = 0.3, max_longest: int = 100) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    covered_words, longest_repeat, kept.

    A null or empty text has no words and fails the base rules. One row out for each row in, whatever repeats; a null doc_id stays
    null, an empty table gives an empty one, other columns are ignored whatever their names. A very long text is an array of its own,
    in time n log n, however often its words repeat.
    """

    def run(batches):
        table = WordTable()
        for b in pieces(batches):
            texts = raw(b.column(1))
            table.tidy()
            split = Split(texts)
            n, text = split.n, split.text()
            bounds = np.concatenate(([0], np.cumsum(n)))
            words = table.rows(split)
            length = repeats(words, text)
            total = len(words)

            def per_text(flags, bounds=bounds):
                c = np.concatenate(([0], np.cumsum(flags)))
                return c[bounds[1:]] - c[bounds[:-1]]

            s3 = np.flatnonzero(length >= 3)
            again = per_text(covered(s3, np.full(len(s3), 3), total))
            sm = np.flatnonzero(length >= min_repeat)
            cover = per_text(covered(sm, length[sm], total))
            longest = np.zeros(len(texts), np.int64)
            np.maximum.at(longest, text, length)
            dup = []
            for t in texts:
                lines = [x for x in t.split(b"\n") if x and x.strip(_SPACE)]
                dup.append(len(lines) - len(set(lines)))
            failed = (n < min_words) | (100 * again > 50 * n)
            kept = ~failed & (cover <= max_covered * n) & (longest <= max_longest)
            columns = {
                "doc_id": b.column(0),
                "n_words": n,
                "word_chars": np.array([len(t.translate(None, _NOT_FIRST + _SPACE)) for t in texts], np.int64),
                "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
                "n_dup_lines": np.array(dup, np.int64),
                "n_repeat_words": again.astype(np.int64),
                "base_failed": failed,
                "covered_words": cover.astype(np.int64),
                "longest_repeat": longest,
                "kept": kept,
            }
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))

    docs = docs_of(docs)
    kind = dict(docs.dtypes)["doc_id"]
    longs = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    return docs.mapInArrow(run, f"doc_id {kind}, {longs}, base_failed boolean, covered_words bigint, longest_repeat bigint, kept boolean")
