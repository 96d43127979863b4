"""Words of many texts at once, in numpy: splitting, 128-bit hashes, and a table of known words.

Words are never Python objects here: a slice of texts is one byte array, a word is a start and a length in it, and
is told from others by two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

#: Bytes of white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LONG = 48
#: New words handed to a table's make() at once.
NEW_WORDS = 20_000
_P1, _P2, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x100000001B3, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Split:
    """The words of some texts: data (bytes of all texts), start and size of each word, n (words of each text)."""

    def __init__(self, texts: list[bytes], space: np.ndarray = SPACE):
        self.joined = b" ".join(texts)
        self.data = np.frombuffer(self.joined, np.uint8)
        word = ~space[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0])).astype(np.int8)))
        self.start, self.size = edge[::2], edge[1::2] - edge[::2]
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.cumsum(size) - size
        bound = np.searchsorted(self.start, np.concatenate((self.offset, [len(self.data) + 1])))
        self.n, self.first = np.diff(bound), bound[:-1]

    def text(self) -> np.ndarray:
        """The number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def word(self, i: int) -> bytes:
        return self.joined[self.start[i] : self.start[i] + self.size[i]]


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each stretch of data."""
    order = np.argsort(np.minimum(size, _LONG + 1).astype(np.uint8), kind="stable")[::-1]
    s, z = start[order], size[order]
    long = int(np.searchsorted(-z, -_LONG, "left"))
    a, b = np.full(len(s), 1, np.uint64), np.full(len(s), 0xCBF29CE484222325, np.uint64)
    alive = np.searchsorted(-z, -np.arange(_LONG), "left")
    for k in range(_LONG):
        m = int(alive[k])
        if not m:
            break
        c = data[s[:m] + k].astype(np.uint64)
        a[:m] = a[:m] * _P1 + c
        b[:m] = (b[:m] ^ c) * _P2
    for i in range(long):
        x = xxhash.xxh3_128_intdigest(data[s[i] : s[i] + z[i]].tobytes())
        a[i], b[i] = x >> 64, x & (2**64 - 1)
    a = (a ^ (a >> np.uint64(29))) * _M1
    b = (b ^ (b >> np.uint64(31))) * _M2
    x, y = np.empty_like(a), np.empty_like(b)
    x[order], y[order] = a ^ (a >> np.uint64(32)), b ^ (b >> np.uint64(30))
    return x, y


class WordTable:
    """word -> row number, by hash. make(words) is called with words not met before, in the order of their rows.

    Beyond ``most`` words tidy() forgets all; that bounds memory and changes no result.
    """

    def __init__(self, make: Callable[[list[bytes]], None] | None = None, most: int = 1_000_000):
        self.make, self.most = make, most
        self._clear(1 << 12)

    def _clear(self, slots: int) -> None:
        self.n, self.slots = 0, slots
        self.a, self.b = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.row = np.full(slots, -1, np.int32)

    def tidy(self) -> bool:
        if self.n <= self.most:
            return False
        self._clear(1 << 12)
        return True

    def _slot(self, a: np.ndarray) -> np.ndarray:
        return (a & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row numbers; -1 for unknown words."""
        at = self._slot(a)
        out = self.row[at]
        wrong = np.flatnonzero((out >= 0) & ((self.a[at] != a) | (self.b[at] != b)))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (self.slots - 1)
            t = at[wrong]
            out[wrong] = self.row[t]
            wrong = wrong[(out[wrong] >= 0) & ((self.a[t] != a[wrong]) | (self.b[t] != b[wrong]))]
        return out

    def _put(self, a: np.ndarray, b: np.ndarray, row: np.ndarray) -> None:
        at, left = self._slot(a), np.arange(len(a))
        while len(left):
            t = at[left]
            free = self.row[t] < 0
            _, first = np.unique(t, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            w, t = left[take], t[take]
            self.a[t], self.b[t], self.row[t] = a[w], b[w], row[w]
            left = left[~take]
            at[left] = np.where(self.row[at[left]] >= 0, (at[left] + 1) & (self.slots - 1), at[left])

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows for words that are new and distinct."""
        rows = np.arange(self.n, self.n + len(a), dtype=np.int32)
        if 2 * (self.n + len(a)) > self.slots:
            used = self.row >= 0
            a0, b0, r0 = self.a[used], self.b[used], self.row[used]
            n, slots = self.n, self.slots
            while 2 * (n + len(a)) > slots:
                slots *= 2
            self._clear(slots)
            self._put(a0, b0, r0)
            self.n = n
        self._put(a, b, rows)
        self.n += len(a)
        return rows

    def rows(self, split: Split, lanes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Row number of each word; unknown ones are added."""
        a, b = lanes or hashes(split.data, split.start, split.size)
        out = self.find(a, b)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            order = np.lexsort((miss, b[miss], a[miss]))
            m = miss[order]
            new = np.concatenate(([True], (a[m][1:] != a[m][:-1]) | (b[m][1:] != b[m][:-1])))
            first = m[new]
            rows = self.add(a[first], b[first])
            if self.make:
                for at in range(0, len(first), NEW_WORDS):  # what make() needs for a word may be many times its size
                    self.make([split.word(i) for i in first[at : at + NEW_WORDS].tolist()])
            out[m] = rows[np.cumsum(new) - 1]
        return out


class Rows:
    """Arrays with a row for each word of a table, extended block by block."""

    def __init__(self, dtype, width: int | None = None):
        self.data, self.n = np.zeros((1024, width) if width else 1024, dtype), 0

    def extend(self, block: np.ndarray) -> None:
        n = self.n + len(block)
        if n > len(self.data):
            grown = np.zeros((max(n, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : n] = block
        self.n = n

    def clear(self) -> None:
        self.n = 0


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
