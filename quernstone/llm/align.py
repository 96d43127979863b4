"""Alignment of two tokenizers over a corpus: which ids of one stand where which ids of the other do.

Both cut the same bytes (a space and the text). Where both have a token's end, a group ends; within a group every id of one is linked
with every id of the other. A pair of ids is one int64, the first id in its upper half. Counts are made in three steps:

1. ``partial_counts``: each task keeps, for the pairs of its documents, the number of documents in sorted arrays (np.unique), so it
   sends a pair once for every ``HELD`` pairs, however frequent the pair is.
2. ``write_shards``: a range-partitioned global sort brings equal pairs side by side; runs are summed and written as sorted shards, Arrow
   files of one batch that are memory-mapped.
3. ``Counts``: a lookup is a binary search in the first keys of the shards and one in the mapped keys of a shard.

Texts are taken apart at single spaces or line feeds between two other characters. Both tokenizers always end a token there, so what
stands between is a unit, whose ids, groups and links are learnt once in a worker; other white space stays inside a unit.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from .common import LEARNT, cut, docs_of, pieces, raw, shared_folder
from .tokens import _ODD_SPACE, _open, tokenizer_path
from .words import Rows, WordTable, gather

#: Units and bytes of what is known of them that a worker remembers; beyond them it forgets all, which changes no result.
MEMO_UNITS, MEMO_BYTES = 600_000, 96 << 20
#: Pairs that a task holds before it sends their counts on, and pairs of a shard.
HELD, SHARD = 1 << 20, 1 << 21
#: Shards that a worker has open.
OPEN = 64
#: Units that are encoded as one text.
TOGETHER = 1000
_LOW = (1 << 32) - 1
#: White space beyond ASCII in UTF-8: by first byte, what follows it.
_WIDE = {0xC2: [(0x85,), (0xA0,)], 0xE1: [(0x9A, 0x80)], 0xE2: [*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F)], 0xE3: [(0x80, 0x80)]}


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies show bytes as: printable ones of Latin-1 as themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Bytes of the tokens of a tokenizer: place and size of each id in one array."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.place = np.cumsum(self.size) - self.size

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.place[ids], self.size[ids])


class ByteLevel:
    """The first tokenizer: byte-level BPE of a tokenizers file. Special tokens inside texts are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        own, table = self.tok.get_vocab(), byte_alphabet()
        tokens = [b""] * self.tok.get_vocab_size()
        for token, i in own.items():
            tokens[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.vocabulary = Vocabulary(tokens)

    def __call__(self, units: list[bytes]) -> list[np.ndarray]:
        found = self.tok.encode_batch_fast([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)
        return [np.array(e.ids, np.int64) for e in found]


class Pieces:
    """The second tokenizer: a sentencepiece model with byte fallback, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in x.lstrip("▁") or " " in x or "\n" in x for x in names):
            raise ValueError("pieces that go on after a space cannot be cut at spaces")
        self.vocabulary = Vocabulary([bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])

    def __call__(self, units: list[bytes]) -> list[np.ndarray]:
        """A unit begins with its space, or with a line feed; before the latter a word of one letter is put and taken off again."""
        bare = [u[1:] if u[:1] == b" " else b"x" + u for u in units]
        found = self.model.encode([u.decode("utf-8", "replace") for u in bare], num_threads=1)
        out = []
        for u, ids in zip(units, found, strict=True):
            ids = np.array(ids, np.int64)
            if u[:1] != b" ":
                ends = np.cumsum(self.vocabulary.size[ids])
                at = int(np.searchsorted(ends, 2))
                ids = ids[at + 1 :] if at < len(ends) and ends[at] == 2 else np.zeros(0, np.int64)
            out.append(ids)
        return out


def white(data: np.ndarray) -> np.ndarray:
    """The bytes of white space, of the kinds beyond ASCII too."""
    space = _ODD_SPACE[data]
    padded = np.concatenate((data, np.zeros(2, np.uint8)))
    for lead, tails in _WIDE.items():
        at = np.flatnonzero(data == lead)
        for tail in tails if len(at) else ():
            hit = at[np.logical_and.reduce([padded[at + 1 + j] == x for j, x in enumerate(tail)])]
            for j in range(len(tail) + 1):
                space[hit + j] = True
    return space


class Units:
    """The units of some texts, each with a space before it: data, start and size of each, n (units of each text)."""

    def __init__(self, texts: list[bytes]):
        led = [b" " + t if t else b"" for t in texts]
        size = np.fromiter(map(len, led), np.int64, len(led))
        offset = np.cumsum(size) - size
        self.joined = b"".join(led)
        self.data = data = np.frombuffer(self.joined, np.uint8)
        space = np.append(white(data), True)
        gap = np.flatnonzero((data == 0x20) | (data == 0x0A))
        gap = gap[gap > 0]
        gap = gap[~space[gap - 1] & ~space[gap + 1]]
        cut = np.zeros(len(data), bool)
        cut[gap] = cut[offset[size > 0]] = True
        self.start = np.flatnonzero(cut)
        self.size = np.diff(np.append(self.start, len(data)))
        self.n = np.diff(np.searchsorted(self.start, np.append(offset, len(data))))

    def word(self, i: int) -> bytes:
        return self.joined[self.start[i] : self.start[i] + self.size[i]]


def distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sums of their weights."""
    if not len(keys):
        return keys, weight
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[start], np.add.reduceat(weight[order], start)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each comes."""
    keys = np.sort(keys)
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.diff(np.append(start, len(keys)))


class Aligner:
    """What a worker knows of units. ``pairs`` keeps the pairs that each links; without it, its figures and the text of its groups."""

    FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def __init__(self, first: str, second: str, score=None):
        """score: from pairs to (how many documents hold each, whether no other pair of its first id is held by more)."""
        self.a, self.b, self.score = ByteLevel(first), Pieces(second), score
        names = [str(i) for t in (self.a, self.b) for i in range(len(t.vocabulary.size))]
        self.decimal = Vocabulary([f"{x},".encode() for x in names])
        self.table = WordTable(self._learn, MEMO_UNITS)
        self._empty()

    def _empty(self) -> None:
        self.bad, self.place, self.size = Rows(np.int8), Rows(np.int64), Rows(np.int32)
        self.figures = {f: Rows(np.int64) for f in self.FIGURES}
        self.pool = Rows(np.uint8 if self.score else np.int64)  # text or pairs: at place, of size

    def tidy(self) -> None:
        if self.table.n > MEMO_UNITS or self.pool.n * self.pool.data.itemsize > MEMO_BYTES:
            self.table._clear(1 << 12)
            self._empty()

    def _together(self, joined: bytes, ends: np.ndarray) -> list | None:
        """(ids, ids of each unit) for both tokenizers, of units that may stand side by side; None if the bytes do not come out."""
        data, out = np.frombuffer(joined, np.uint8), []
        for tokenizer in (self.a, self.b):
            ids, v = tokenizer([joined])[0], tokenizer.vocabulary
            stop = np.cumsum(v.size[ids])
            at = np.searchsorted(stop, ends)
            if not len(stop) or stop[-1] != len(joined) or (stop[at] != ends).any() or (v.bytes(ids) != data).any():
                return None
            out.append((ids[at[0] + 1 :], np.diff(at)))
        return out

    def _encoded(self, units: list[bytes], size: np.ndarray) -> tuple:
        """The order in which units were encoded; (ids, ids of each unit) for both tokenizers, in that order; and which units do not come
        out as their own bytes. These have no ids."""
        joined = b"".join(units)
        end = np.cumsum(size)
        space = white(np.frombuffer(joined, np.uint8))
        plain = np.flatnonzero((size > 1) & ~space[np.minimum(end - size + 1, len(space) - 1)] & ~space[end - 1])
        order, sides, alone = [], ([], []), [np.setdiff1d(np.arange(len(units)), plain)]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            both = self._together(b" x" + b"".join([units[i] for i in some.tolist()]), np.cumsum([2, *size[some].tolist()]))
            if both is None:
                alone.append(some)
                continue
            order.append(some)
            for side, x in zip(sides, both, strict=True):
                side.append(x)
        order.append(np.concatenate(alone))
        own = [units[i] for i in order[-1].tolist()]
        each = [t(own) if own else [] for t in (self.a, self.b)]
        wrong = np.zeros(len(own), np.int8)
        for t, found in zip((self.a, self.b), each, strict=True):
            wrong |= np.fromiter((t.vocabulary.bytes(ids).tobytes() != u for ids, u in zip(found, own, strict=True)), np.int8, len(own))
        none = np.zeros(0, np.int64)
        for side, found in zip(sides, each, strict=True):
            found = [none if w else ids for w, ids in zip(wrong.tolist(), found, strict=True)]
            side.append((np.concatenate([none, *found]), np.fromiter(map(len, found), np.int64, len(found))))
        bad = np.concatenate((np.zeros(len(units) - len(own), np.int8), wrong))
        return np.concatenate(order), [tuple(np.concatenate(x) for x in zip(*side, strict=True)) for side in sides], bad

    def _learn(self, units: list[bytes]) -> None:
        size = np.fromiter(map(len, units), np.int64, len(units))
        order, ((a, n_a), (b, n_b)), bad = self._encoded(units, size)
        unit_end = np.cumsum(np.where(bad, 0, size[order]))
        end_a, end_b = np.cumsum(self.a.vocabulary.size[a]), np.cumsum(self.b.vocabulary.size[b])
        end = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(end, end_a), np.searchsorted(end, end_b)
        unit = np.searchsorted(unit_end, end)
        wide, high = np.bincount(group_a, minlength=len(end)), np.bincount(group_b, minlength=len(end))
        total = lambda of, w=None: np.bincount(of, w, len(units)).astype(np.int64)
        pair, often, of = self._pairs(a, b, group_a, group_b, unit)
        back = np.empty(len(units), np.int64)
        back[order] = np.arange(len(units))

        def pooled(values: np.ndarray, n: np.ndarray) -> None:
            self.place.extend((self.pool.n + np.cumsum(n) - n)[back])
            self.size.extend(n[back])
            self.pool.extend(values)

        if not self.score:
            pooled(pair, total(of))
        else:
            text, n = self._text(a, b, group_a, group_b, wide, high)
            pooled(text, total(unit, n))
            held, best = self.score(pair)
            figures = (n_a, n_b, total(unit), total(unit, wide * high), self._sums(often * best, of, len(units)), self._sums(often * held, of, len(units)))
            for rows, x in zip(self.figures.values(), figures, strict=True):
                rows.extend(x[back])
        self.bad.extend(bad[back])

    @staticmethod
    def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Of consecutive values, in whole numbers."""
        cum = np.concatenate(([0], np.cumsum(values)))
        bound = np.searchsorted(of, np.arange(n + 1))
        return cum[bound[1:]] - cum[bound[:-1]]

    @staticmethod
    def _pairs(a, b, group_a, group_b, unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of each unit, how often each is linked, and the unit. Links of equal ids within a group are made once, so
        no product of repeats is."""
        ka, often_a = distinct(group_a << 32 | a, np.ones(len(a), np.int64))
        kb, often_b = distinct(group_b << 32 | b, np.ones(len(b), np.int64))
        ga, gb = ka >> 32, kb >> 32
        first = np.searchsorted(gb, np.arange(len(unit)))
        many = np.bincount(gb, minlength=len(unit))[ga]
        left = np.repeat(np.arange(len(ka)), many)
        right = np.arange(len(left)) + np.repeat(first[ga] - (np.cumsum(many) - many), many)
        pair, often, of = (ka[left] & _LOW) << 32 | (kb[right] & _LOW), often_a[left] * often_b[right], unit[ga[left]]
        order = np.lexsort((pair, of))
        pair, often, of = pair[order], often[order], of[order]
        if len(pair):
            new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (of[1:] != of[:-1]))))
            pair, often, of = pair[new], np.add.reduceat(often, new), of[new]
        return pair, often, of

    def _text(self, a, b, group_a, group_b, wide, high) -> tuple[np.ndarray, np.ndarray]:
        """The groups as text, and the bytes of each."""
        ids = np.empty(len(a) + len(b), np.int64)
        ids[np.arange(len(a)) + (np.cumsum(high) - high)[group_a]] = a
        ids[np.arange(len(b)) + np.cumsum(wide)[group_b]] = b + len(self.a.vocabulary.size)
        end = np.cumsum(self.decimal.size[ids])
        text = self.decimal.bytes(ids)
        last = np.cumsum(wide + high)
        text[end[last - high - 1] - 1] = ord("|")
        text[end[last - 1] - 1] = ord(";")
        return text, np.diff(end[last - 1], prepend=0)

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each unit, units of each text. A text that does not come out as its own bytes has none, like an empty one."""
        units = Units(texts)
        row = self.table.rows(units)
        bad = self.bad.data[row] > 0
        if not bad.any():
            return row, units.n
        of = np.repeat(np.arange(len(texts)), units.n)
        gone = np.bincount(of, bad, len(texts)) > 0
        return row[~gone[of]], np.where(gone, 0, units.n)


def aligner(name: str, make) -> Aligner:
    """This process's aligner of that name: what one task has learnt serves the next; that of another name goes."""
    known = LEARNT.setdefault("align", {})
    if name not in known:
        known.clear()
        known[name] = make()
    return known[name]


def held_pairs(know: Aligner, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of some documents, and how many of them hold each."""
    used, _ = counted(np.repeat(np.arange(len(n)), n) << 32 | row)
    doc, row = used >> 32, used & _LOW
    size = know.size.data[row]
    pair, doc = gather(know.pool.data, know.place.data[row], size), np.repeat(doc, size)
    low = len(know.b.vocabulary.size).bit_length()
    bits = low + len(know.a.vocabulary.size).bit_length()  # with the document's number in the slice, far below 64
    once, _ = counted(doc << bits | pair >> 32 << low | (pair & _LOW))
    key, count = counted(once & ((1 << bits) - 1))
    return key >> low << 32 | (key & ((1 << low) - 1)), count


def partial_counts(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """key, n: how many documents of a task hold a pair linked. A pair comes once or more from each task."""
    first, second = first or tokenizer_path(), second or tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        know, keys, counts = aligner(f"pairs {first} {second}", lambda: Aligner(first, second)), [], []

        def merged():
            found = distinct(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [found[0]], [found[1]]

        def sent():
            for k, n in zip(keys, counts, strict=True):
                for at in range(0, len(k), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (k, n)], names=["key", "n"])
            keys.clear(), counts.clear()

        for b in pieces(batches, operator="align"):
            know.tidy()
            k, n = held_pairs(know, *know.documents(raw(b.column(1))))
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) > HELD:
                merged()
                if len(keys[0]) > HELD // 2:
                    yield from sent()
        if keys:
            merged()
            yield from sent()

    return docs_of(docs).mapInArrow(run, "key bigint, n bigint")


def write_shards(partial: DataFrame, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Sums and sorts the counts into shards and returns their list: file, first (key), n (pairs), and of each first id in the shard the
    highest count (ids, best). partial: key, n; repeats are summed.

    Tasks write under names of their own and only those of tasks that ended well are listed. folder: any URI that pyarrow.fs and
    all executors can reach; a new one in the shared folder if not given. shards: one for every ``SHARD`` rows if not given, and as
    many as there are cores.
    """
    spark = partial.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/pairs-{uuid.uuid4().hex}"
    partial = cut(partial)
    shards = shards or max(spark.sparkContext.defaultParallelism, partial.count() // SHARD)

    def run(batches):
        keys, counts = [], []
        for b in batches:
            if not b.num_rows:
                continue
            k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            k, n = k[start], np.add.reduceat(n, start)
            if keys and keys[-1][-1] == k[0]:  # a run that goes on
                counts[-1] = counts[-1].copy()
                counts[-1][-1] += n[0]
                k, n = k[1:], n[1:]
            if len(k):
                keys.append(k)
                counts.append(n)
        if not keys:
            return
        k, n = np.concatenate(keys), np.concatenate(counts)
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        batch = pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])
        with fs.open_output_stream(f"{base}/{name}.arrow") as out, pa.ipc.new_file(out, batch.schema) as w:
            w.write_batch(batch)
        ids, start = np.unique(k >> 32, return_index=True)
        best = np.maximum.reduceat(n, start)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(x)) for x in (ids, best)]
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.arrow"]), pa.array([int(k[0])]), pa.array([len(k)]), *lists], names=["file", "first", "n", "ids", "best"])

    dealt = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
    return cut(dealt.mapInArrow(run, "file string, first bigint, n bigint, ids array<bigint>, best array<bigint>"))


class Counts:
    """How many documents hold a pair, from shards of write_shards. In a local folder they are mapped, not read."""

    def __init__(self, shards: Iterable[tuple[str, int]]):
        found = sorted(shards, key=lambda x: x[1])
        self.files, self.first = [f for f, _ in found], np.array([k for _, k in found], np.int64)
        self.open: OrderedDict[int, tuple] = OrderedDict()

    def _shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            fs, base = _open(self.files[i])
            source = pa.memory_map(base) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(base)
            batch = pa.ipc.open_file(source).get_batch(0)
            self.open[i] = tuple(batch.column(c).to_numpy(zero_copy_only=True) for c in (0, 1))
            if len(self.open) > OPEN:
                self.open.popitem(last=False)
        self.open.move_to_end(i)
        return self.open[i]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 for pairs that no document holds."""
        wanted, place = np.unique(keys, return_inverse=True)
        out = np.zeros(len(wanted), np.int64)
        shard = np.searchsorted(self.first, wanted, "right") - 1
        for i in np.unique(shard[shard >= 0]).tolist():
            own = np.flatnonzero(shard == i)
            k, n = self._shard(i)
            at = np.minimum(np.searchsorted(k, wanted[own]), len(k) - 1)
            out[own] = np.where(k[at] == wanted[own], n[at], 0)
        return out[place]


def align(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; see the module.

    n_best: links whose pair is held by as many documents as any pair of its first id. count_sum: the sum of these counts over links.
    The hash is of the groups' ids as text (``a1,a2|b1;a3|b2``). Texts that are null or empty, or that one of the
    tokenizers does not give back byte by byte, have no ids: zeros and an empty text for the hash; they count for no pair. Rows that repeat a
    doc_id, or have none, are documents of their own. An empty table gives an empty one. Very long texts are worked on whole. Other
    columns are ignored whatever their names. The vocabularies bound what the driver sees: one row a shard and a count an id.
    """
    first, second = first or tokenizer_path(), second or tokenizer_path("piece_bpe_32k.model")
    kind = dict(docs.dtypes)["doc_id"]
    listed = write_shards(partial_counts(docs, first, second)).collect()
    shards = [(r.file, r.first) for r in listed]
    best = np.zeros(1 + max((max(r.ids) for r in listed), default=0), np.int64)
    for r in listed:
        np.maximum.at(best, np.array(r.ids, np.int64), np.array(r.best, np.int64))
    name = uuid.uuid4().hex

    def made() -> Aligner:
        counts = Counts(shards)

        def score(pair):
            held = counts(pair)
            return held, held == best[pair >> 32]

        return Aligner(first, second, score)

    def run(batches):
        know = aligner(name, made)
        for b in pieces(batches, operator="align"):
            know.tidy()
            row, n = know.documents(raw(b.column(1)))
            bound = np.concatenate(([0], np.cumsum(n)))
            sums = []
            for rows in know.figures.values():
                c = np.concatenate(([0], np.cumsum(rows.data[row])))
                sums.append(pa.array(c[bound[1:]] - c[bound[:-1]]))
            size = know.size.data[row]
            text = gather(know.pool.data, know.place.data[row], size).tobytes()
            ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[bound].tolist()
            names = [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *sums, pa.array(names, pa.string())], names=["doc_id", *Aligner.FIGURES, "groups_sha256"])

    return docs_of(docs).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{f} bigint' for f in Aligner.FIGURES)}, groups_sha256 string")
