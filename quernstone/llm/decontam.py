"""Benchmark decontamination with a generalised suffix automaton.

All test items, lower-cased and cut into words, go into suffix automata. The words of a document are streamed
through one; at each word the automaton's state and match length tell the longest passage that ends there and
stands in some item. Where that length reaches ``size`` words the words are hit, and the state's ancestor that
holds passages of just ``size`` words knows the items they stand in. Items shorter than ``size`` count when they
occur whole. Items of the same words are one sequence; their ids come in only at the end.

Only stretches of a document whose word triples all occur in items are streamed: a longer match cannot lie
anywhere else. A bitmap of the triples of the whole test set finds them.

The test set is read in parts of at most ``most_bytes`` of text, each of which becomes an automaton in flat arrays
(about 10 bytes for each byte of text). One part stays in memory. Of more, a worker takes up some ``HELD`` bytes of
documents and holds their stretches against one part after the other, so that it never has more than one automaton.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, pieces, raw, small_batches
from .words import Split, WordTable, hashes

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z to a-z; all ASCII but digits and letters to a space.
_TABLE = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Text of the test set in one automaton.
PART = 2 << 20
#: Text of documents that is held against several parts in turn.
HELD = 16 << 20
#: Bits of the bitmap for each triple of the test set, and the most it may have: a fuller one passes more stretches, never fewer.
BITS, MOST_BITS = 16, 1 << 30
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased words: digits, letters and all that is not ASCII."""
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Of several distinct sequences of word numbers, each with a number of its own. Built in lists, kept in flat arrays."""

    def __init__(self, sequences: Iterable[list[int]], size: int):
        self.size = size
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        kept = [list(s) for s in sequences]
        for s in kept:
            last = 0
            for w in s:
                last = self._add(last, w)
        n, length, link = len(self._next), self._length, self._link
        order = sorted(range(1, n), key=length.__getitem__)
        # Of each state, its ancestor (or itself) that holds passages of `size` words.
        at_size = [-1] * n
        for v in order:
            up = link[v]
            at_size[v] = -1 if length[v] < size else v if length[up] < size else at_size[up]
        states, numbers = [], []
        own: dict[int, list[tuple[int, int]]] = {}
        for i, s in enumerate(kept):
            v = 0
            for k, w in enumerate(s, 1):
                v = self._next[v][w]
                if k >= size:
                    states.append(at_size[v])
                    numbers.append(i)
            if 0 < len(s) < size:
                own.setdefault(v, []).append((len(s), i))
        #: Short sequences by the state they end in: (length, number). One text has one state, and a state at most size - 1 of them.
        self.own = own
        # Of each state, the nearest one above it in the link tree where short sequences end; those end wherever the state does.
        above = [0] * n
        for v in order:
            up = link[v]
            above[v] = up if up in own else above[up] if up > 0 else 0
        pairs = np.unique(np.array([states, numbers], np.int64), axis=1) if states else np.zeros((2, 0), np.int64)
        self.held, self.numbers = pairs[0].astype(np.int32), pairs[1].astype(np.int32)
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in self._next]))).astype(np.int32)
        moves = [sorted(x.items()) for x in self._next]
        self.word = np.array([w for x in moves for w, _ in x], np.int32)
        self.target = np.array([t for x in moves for _, t in x], np.int32)
        self.link, self.length, self.at_size, self.above = (np.array(x, np.int32) for x in (link, length, at_size, above))
        del self._next, self._link, self._length

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self._length.append(length)
        self._link.append(link)
        self._next.append(nxt)
        return len(self._next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self._length[p] + 1, self._link[q], dict(self._next[q]))
        self._link[q] = clone
        while p >= 0 and self._next[p].get(w) == q:
            self._next[p][w] = clone
            p = self._link[p]
        return clone

    def _add(self, last: int, w: int) -> int:
        q = self._next[last].get(w)
        if q is not None:
            return q if self._length[q] == self._length[last] + 1 else self._split(last, w, q)
        now = self._state(self._length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self._next[p]:
            self._next[p][w] = now
            p = self._link[p]
        if p >= 0:
            q = self._next[p][w]
            self._link[now] = q if self._length[q] == self._length[p] + 1 else self._split(p, w, q)
        return now

    def of(self, state: int) -> list[int]:
        """Numbers of the sequences that hold the passages of `size` words of a state."""
        a, b = np.searchsorted(self.held, (state, state + 1))
        return self.numbers[a:b].tolist()

    def stream(self, words: list[int], hit: np.ndarray, base: int, states: set[int], short: set[int]) -> None:
        """Marks the hit words among hit[base:]; adds to states those whose passages of `size` words occur, to short the numbers
        of short sequences that do."""
        start, word, target, link, length, at_size, above = map(memoryview, (self.start, self.word, self.target, self.link, self.length, self.at_size, self.above))
        own, size = self.own, self.size
        v = n = 0
        for i, w in enumerate(words):
            while True:
                a, b = start[v], start[v + 1]
                if b - a > 1:
                    a = bisect_left(word, w, a, b)
                if a < b and word[a] == w:
                    v, n = target[a], n + 1
                    break
                if not v:
                    break
                v = link[v]
                n = length[v]
            if n >= size:
                hit[base + i + 1 - size : base + i + 1] = True
                states.add(at_size[v])
            u = v
            while u:
                for m, item in own.get(u, ()):
                    if n >= m:
                        hit[base + i + 1 - m : base + i + 1] = True
                        short.add(item)
                u = above[u]


class Matcher:
    """An automaton of some items and what it takes to skip what cannot match. size: words of a window."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        sequences: dict[tuple[bytes, ...], list[str]] = {}
        for i, text in items:
            sequences.setdefault(tuple(normal_words(text)), []).append(i)
        sequences.pop((), None)
        self.ids = list(sequences.values())
        vocabulary: dict[bytes, int] = {}
        coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in s] for s in sequences]
        known = Split([b" ".join(vocabulary)])
        self.table = WordTable()
        lanes = hashes(known.data, known.start, known.size)
        self.table.add(*lanes)
        self.automaton = SuffixAutomaton(coded, size)
        self.least = min((min(len(s), size) for s in coded), default=0)
        self.order = min(3, self.least)
        grams = [x for s in coded for x in gram_hashes(lanes[0][s], self.order)] if self.order else []
        self.grams = np.unique(np.array(grams, np.uint64))

    def __call__(self, lanes: tuple[np.ndarray, np.ndarray], at: np.ndarray, grams: np.ndarray, text: np.ndarray, hit: np.ndarray, found: list[set[str]]) -> None:
        """Marks the words that are hit and adds the ids of the items found in each text. at: words (ascending) where a gram (with
        the hash in grams) of the test set's order may begin, or of a smaller order if some part's is smaller."""
        if not self.order or not len(at):
            return
        near = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at = at[self.grams[near] == grams]
        if not len(at):
            return
        cuts = np.flatnonzero((at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])) + 1
        first, last = at[np.concatenate(([0], cuts))], at[np.concatenate((cuts - 1, [len(at) - 1]))] + self.order
        long = last - first >= self.least
        states: dict[int, tuple[set[int], set[int]]] = {}
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            mine = states.setdefault(int(text[a]), (set(), set()))
            self.automaton.stream(self.table.find(lanes[0][a:b], lanes[1][a:b]).tolist(), hit, a, *mine)
        for t, (some, short) in states.items():
            for number in {x for s in some for x in self.automaton.of(s)} | short:
                found[t].update(self.ids[number])


def gram_hashes(h: np.ndarray, order: int) -> np.ndarray:
    """Hash of every ``order`` (at most three) consecutive word hashes."""
    m = len(h) - order + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(order):
        out = (out ^ h[j : j + m]) * _MIX[j]
    return out ^ (out >> np.uint64(29))


class TestSet:
    """The matchers of all parts, as broadcasts, and by the order of their grams the bitmaps of all of these."""

    def __init__(self, spark, benchmark: DataFrame, size: int, most_bytes: int):
        rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id is not null")
        self.parts, self.orders, grams = [], [], {}
        for part in _parts(rows, most_bytes):
            m = Matcher(part, size)
            if m.order:
                self.parts.append(spark.sparkContext.broadcast(m))
                self.orders.append(m.order)
                grams.setdefault(m.order, []).append(m.grams)
        self.maps = {}
        for order, found in grams.items():
            log = max(10, min(MOST_BITS, BITS * sum(map(len, found))).bit_length())
            bits = np.zeros(1 << (log - 3), np.uint8)
            for g in found:
                np.bitwise_or.at(bits, (g >> np.uint64(64 - log + 3)).astype(np.int64), (1 << ((g >> np.uint64(64 - log)) & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            self.maps[order] = (log, bits)
        self.maps = spark.sparkContext.broadcast(self.maps)

    def search(self, texts: list[bytes]) -> tuple[Split, np.ndarray, list[set[str]]]:
        """The words of the texts, whether each is hit, and the ids of the items found in each text."""
        split = Split([t.translate(_TABLE) for t in texts])
        total = len(split.start)
        hit, found = np.zeros(total, bool), [set() for _ in texts]
        if not total or not self.parts:
            return split, hit, found
        lanes = hashes(split.data, split.start, split.size)
        text = split.text()
        places = {}
        for order, (log, bits) in self.maps.value.items():
            g = gram_hashes(lanes[0], order)
            if len(g):
                some = (bits[(g >> np.uint64(64 - log + 3)).astype(np.int64)] >> ((g >> np.uint64(64 - log)) & np.uint64(7)).astype(np.uint8)) & 1 > 0
                some &= text[: len(g)] == text[order - 1 :]
                at = np.flatnonzero(some)
                if len(at):
                    places[order] = at, g[at]
        for order, part in zip(self.orders, self.parts, strict=True):
            if order in places:
                part.value(lanes, *places[order], text, hit, found)
                if len(self.parts) > 1:
                    vars(part).pop("_value", None)  # the next one takes its place
        return split, hit, found

    def over(self, batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
        """The batches in slices to search at once: small ones, or large ones if every slice has to go through several parts."""
        if len(self.parts) < 2:
            yield from pieces(batches, column)
            return
        held, size = [], 0
        for b in pieces(batches, column, HELD):
            held.append(b)
            size += b.nbytes
            if size >= HELD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _parts(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, in parts whose texts have at most most_bytes each (or one longer item)."""
    part, held = [], 0
    for item, text in items.orderBy("text", "item_id").toLocalIterator():
        text = text.encode()
        if part and held + len(text) > most_bytes:
            yield part
            part, held = [], 0
        part.append((item, text))
        held += len(text)
    if part:
        yield part


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_hit: float = 0.0, most_bytes: int = PART, clean: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (sorted array of item_ids as strings), contaminated (n_hit > max_hit * n_words),
    and with ``clean`` clean_text: the text without the stretch of each run of hit words; all else stays as it is.

    Null texts have no words; items that are null or without words never occur, nor do items without an id. An empty
    benchmark hits nothing, an empty table gives none. Repeated rows each get their own result, a null doc_id stays null, other
    columns are ignored whatever their names. Very long texts are slices of their own.
    """
    docs = docs_of(docs)
    kind = dict(docs.dtypes)["doc_id"]
    tests = TestSet(docs.sparkSession, benchmark, size, most_bytes)

    def run(batches):
        for b in tests.over(batches, "text"):
            texts = raw(b.column(1))
            split, hit, found = tests.search(texts)
            n = split.n
            c = np.concatenate(([0], np.cumsum(hit)))
            ends = np.cumsum(n)
            n_hit = c[ends] - c[ends - n]
            columns = [b.column(0), pa.array(n), pa.array(n_hit.astype(np.int64)), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(n_hit > max_hit * n)]
            names = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
            if clean:
                left = []
                for t, a, e, k in zip(texts, (ends - n).tolist(), ends.tolist(), n_hit.tolist(), strict=True):
                    left.append(without(t, hit[a:e]) if k else t.decode("utf-8", "replace"))
                columns.append(pa.array(left, pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, contaminated boolean" + ", clean_text string" * clean)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", most_bytes: int = PART) -> DataFrame:
    """docs without the words of benchmark passages; a document whose words are all hit goes. All columns stay, and n_chars,
    if there is one, is the new length. Texts without a hit are not touched, a null one included, nor are nulls in other columns;
    repeated rows each stay. An empty benchmark changes nothing.

    Whole rows pass through, so no join puts texts and results together again.
    """
    small_batches(docs.sparkSession)
    tests = TestSet(docs.sparkSession, benchmark, size, most_bytes)
    at, schema = docs.columns.index(text_col), docs.schema
    counted = docs.columns.index("n_chars") if docs.columns.count("n_chars") == 1 else None
    if docs.columns.count(text_col) != 1:
        raise ValueError(f"two columns are called {text_col}")

    def run(batches):
        for b in tests.over(batches, text_col):
            column = b.column(at)
            texts = raw(column)
            split, hit, _ = tests.search(texts)
            new, good = [], np.ones(len(texts), bool)
            for i, (t, a, n) in enumerate(zip(texts, split.first.tolist(), split.n.tolist(), strict=True)):
                some = hit[a : a + n]
                if some.any():
                    good[i] = not some.all()
                    new.append(without(t, some))
                else:
                    new.append(t.decode("utf-8", "replace") if column[i].is_valid else None)
            columns = list(b.columns)
            columns[at] = pa.array(new, column.type)
            if counted is not None:
                old = columns[counted].to_pylist()
                changed = [n != o for n, o in zip(new, column.to_pylist(), strict=True)]
                columns[counted] = pa.array([len(n) if c else o for n, o, c in zip(new, old, changed, strict=True)], columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(good))

    return docs.mapInArrow(run, schema)


def without(text: bytes, hit: np.ndarray) -> str:
    """The text without the stretch of each run of hit words; what stands between two runs stays as it is."""
    plain = text.translate(_TABLE)
    out, at, i = [], 0, 0
    flags = hit.tolist()
    n = len(flags)
    where = _spans(plain)
    while i < n:
        if not flags[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and flags[j + 1]:
            j += 1
        out.append(text[at : where[i][0]])
        at = where[j][1]
        i = j + 1
    out.append(text[at:])
    return b"".join(out).decode("utf-8", "replace")


def _spans(plain: bytes) -> list[tuple[int, int]]:
    a = np.frombuffer(plain, np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], a, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))

