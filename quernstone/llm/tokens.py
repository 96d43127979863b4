"""Byte-level BPE ids, and their binary output as Arrow files of fixed-size lists.

A file holds one stream of ids (documents in ascending doc_id order, an end id after each) cut into sequences
of ``length`` ids. Its record batches have a fixed-size list of ids (16 bits wide if the vocabulary allows, else 32) and one of
a mask (bits) per row, so sequence i of a file is a fixed place in the memory-mapped buffer: reading it copies nothing. Only the last sequence of a file is
padded (mask 0). A second file beside it lists the documents with their places in the stream.
"""

from __future__ import annotations

import importlib
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEARNT, cut, docs_of, given, pieces, raw, shared_folder
from .words import Rows, Split, WordTable, gather

MEMO_PIECES = 600_000
END_ID = 2
FILE_BYTES = 32 << 20
#: Bytes that end a piece: all ASCII white space, NUL (which joins nothing) and the separators U+001C to U+001F.
_ODD_SPACE = np.zeros(256, bool)
_ODD_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return importlib.import_module("public_tokenizers").path(name)

_WIDE_FIRST = {x[:1] for x in _WIDE_SPACE}


class Encoder:
    """Ids of texts, equal to those of the tokenizer's own encode(text, add_special_tokens=False).

    Its pre-tokenizer always cuts before a single space or line feed that stands between two characters that are no
    white space, so a text whose white space is all of that kind is the sequence of its pieces (each with the white
    space before it), and the ids of pieces are remembered. Any other text (runs of white space, other kinds of it,
    special tokens) is encoded as it is. With ``ids=False`` only the numbers of ids are remembered, a small part of the memory.
    """

    def __init__(self, path: str | None = None, most: int = MEMO_PIECES, ids: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or tokenizer_path())
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        # In byte-level vocabularies a leading space is shown as U+0120 and a line feed as U+010A.
        self.opens = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.opens[i] = token[0] in "\u0120\u010a"
        self.table = WordTable(self._learn, most)
        self.pool, self.size = Rows(np.uint32) if ids else None, Rows(np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, new: list[bytes]) -> None:
        size = np.zeros(len(new), np.int64)
        parts: list = [None] * len(new)
        led = [i for i, x in enumerate(new) if x[0] in b" \n"]
        for at in range(0, len(led), 2000):  # all at once: a piece begins at each id that opens with its white space
            some = led[at : at + 2000]
            ids = self._ids([b"".join([new[i] for i in some]).decode()])[0]
            first = np.flatnonzero(self.opens[ids])
            size[some] = np.diff(np.concatenate((first, [len(ids)])))
            for i, x in zip(some, np.split(ids, first[1:]), strict=True) if self.pool else ():
                parts[i] = x
        bare = [i for i, x in enumerate(new) if x[0] not in b" \n"]
        for i, ids in zip(bare, self._ids([new[i].decode() for i in bare]), strict=True):
            parts[i], size[i] = ids, len(ids)
        self.size.extend(size)
        if not self.pool:
            return
        self.pool.extend(np.concatenate(parts))
        ends = np.cumsum(self.size.data[: self.size.n])
        self.place = ends - self.size.data[: self.size.n]

    def _known(self, texts: list[str] | pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(texts, whether each is the sequence of its pieces, how many it then has, their places among what is remembered)"""
        if self.table.tidy():
            self.size.clear()
            if self.pool:
                self.pool.clear()
        rawtexts = raw(texts) if isinstance(texts, pa.Array) else [t.encode() for t in texts]
        split = Split(rawtexts, _ODD_SPACE)
        ends = split.offset + np.fromiter(map(len, rawtexts), np.int64, len(rawtexts))
        # All gaps between words of a text are one space or line feed, and none stands before the first or after the last.
        gap = np.concatenate((split.start[1:], [0])) - split.start - split.size
        inner = np.ones(len(gap), bool)
        has = split.n > 0
        last = split.first[has] + split.n[has] - 1
        inner[last] = False
        after = split.data[np.minimum(split.start + split.size, max(0, len(split.data) - 1))] if len(gap) else gap
        bad = inner & ((gap != 1) | ((after != 0x20) & (after != 0x0A)))
        worse = np.concatenate(([0], np.cumsum(bad)))
        plain = worse[split.first + split.n] == worse[split.first]
        plain[has] &= (split.start[split.first[has]] == split.offset[has]) & (split.start[last] + split.size[last] == ends[has])
        plain[~has] = ends[~has] == split.offset[~has]
        for i, t in enumerate(rawtexts):
            if plain[i] and (any(x in t for x in self.special) or (any(x in t for x in _WIDE_FIRST) and any(x in t for x in _WIDE_SPACE))):
                plain[i] = False
        led = np.ones(len(gap), np.int64)
        led[split.first[has]] = 0
        use = np.repeat(plain, split.n)
        split.start, split.size = (split.start - led)[use], (split.size + led)[use]
        return rawtexts, plain, np.where(plain, split.n, 0), self.table.rows(split)

    def count(self, texts: list[str] | pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        rawtexts, plain, words, row = self._known(texts)
        cum = np.concatenate(([0], np.cumsum(self.size.data[row])))
        n = np.diff(cum[np.concatenate(([0], np.cumsum(words)))])
        for i in np.flatnonzero(~plain).tolist():  # one at a time: what the tokenizer makes of a text is many times its size
            n[i] = len(self._ids([rawtexts[i].decode()])[0])
        return n

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)"""
        rawtexts, plain, words, row = self._known(texts)
        size = self.size.data[row]
        flat = gather(self.pool.data, self.place[row], size) if len(row) else np.zeros(0, np.uint32)
        cum = np.concatenate(([0], np.cumsum(size)))
        bounds = cum[np.concatenate(([0], np.cumsum(words)))]
        if plain.all():
            return flat, np.diff(bounds)
        parts = [flat[bounds[i] : bounds[i + 1]] for i in range(len(plain))]
        odd = np.flatnonzero(~plain).tolist()
        for i, ids in zip(odd, self._ids([rawtexts[i].decode() for i in odd]), strict=True):
            parts[i] = ids
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def encoder(path: str | None = None, ids: bool = True) -> Encoder:
    """This process's encoder: workers serve many tasks, and what one has learnt serves the next."""
    open_ = LEARNT.setdefault("tokens", {})
    if (path, ids) not in open_:
        open_[path, ids] = Encoder(path, ids=ids)
    return open_[path, ids]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens (with the end id) of every row; a null text is empty."""
    docs = docs_of(docs)

    def run(batches):
        count = encoder(path, ids=False).count
        for b in pieces(batches, operator="tokens"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1)) + 1)], names=["doc_id", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class _Writer:
    """Writes ids as fixed-size lists; whole sequences leave memory as soon as they are full."""

    def __init__(self, out, length: int, vocabulary: int, rows: int = 256):
        self.length, self.rows = length, rows
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(out, self.schema)
        self.rest = np.zeros(0, self.kind)

    def _put(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.rest = np.concatenate((self.rest, ids.astype(self.kind)))
        block = self.length * self.rows
        while len(self.rest) >= block:  # every batch but the last has the same number of rows
            self._put(self.rest[:block], np.ones(block, bool))
            self.rest = self.rest[block:]

    def close(self) -> None:
        n = len(self.rest)
        if n:
            pad = -n % self.length
            self._put(np.concatenate((self.rest, np.zeros(pad, self.kind))), np.arange(n + pad) < n)
        self.file.close()


def write_tokens(docs: DataFrame, folder: str | None = None, length: int = 2048, files: int | None = None, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the token files of docs and returns their list: part, file, n_docs, n_tokens, start (ids in all files before).

    Rows are dealt out by ranges of doc_id; rows of one doc_id are ordered by their text and stay in one file. A task
    writes under a name of its own and only the names of tasks that ended well are listed, so tasks that are lost or run
    twice leave nothing that is read. A null doc_id counts as the smallest. An empty table gives an empty list.
    folder: any URI that pyarrow.fs and all executors can reach; a new one in the shared folder if not given. files: one for every
    ``FILE_BYTES`` of text if not given, or as many as there are cores if they have a MB each.
    """
    spark = docs.sparkSession
    docs = docs_of(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    if not files:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-size // FILE_BYTES), min(spark.sparkContext.defaultParallelism, size >> 20))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, writer, out, name = encoder(path), None, None, None
        index_ids, index_n, total = [], [], 0
        for b in pieces(batches, operator="tokens"):
            if writer is None:
                fs, base = _open(folder)
                fs.create_dir(base, recursive=True)
                name = f"part-{part:05d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{base}/{name}.arrow")
                writer = _Writer(out, length, max(end_id + 1, encode.tok.get_vocab_size()))
            ids, n = encode(b.column(1))
            ends = np.cumsum(n)
            writer.add(np.insert(ids, ends, np.uint32(end_id)))
            index_ids.append(b.column(0))
            index_n.append(n + 1)
            total += int((n + 1).sum())
        if writer is not None:
            writer.close()
            out.close()
            n = np.concatenate(index_n)
            ids = pa.chunked_array(index_ids).combine_chunks()
            table = pa.table({"doc_id": ids, "start": np.cumsum(n) - n, "n_tokens": n})
            with fs.open_output_stream(f"{base}/{name}.docs.arrow") as f, pa.ipc.new_file(f, table.schema) as w:
                w.write_table(table, max_chunksize=1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([len(n)]), pa.array([total])], names=["part", "file", "n_docs", "n_tokens"])

    dealt = docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    listed = cut(dealt.mapInArrow(run, "part bigint, file string, n_docs bigint, n_tokens bigint"))
    # One row per file: the number of files is a parameter, so prefix sums may go through the driver.
    at, starts = 0, []
    for r in listed.orderBy("part").collect():
        starts.append((r.part, r.file, r.n_docs, r.n_tokens, at))
        at += r.n_tokens
    return given(spark, starts, "part bigint, file string, n_docs bigint, n_tokens bigint, start bigint")


class TokenFile:
    """Random access to a file of write_tokens: sequence(i) and mask(i) are views of the mapped file."""

    def __init__(self, file: str):
        fs, base = _open(file)
        source = pa.memory_map(base + ".arrow") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(base + ".arrow")
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1

    def _row(self, i: int, column: int) -> pa.Array:
        batch, row = divmod(i, self.rows)
        return self.reader.get_batch(batch).column(column).values.slice(row * self.length, self.length)

    def sequence(self, i: int) -> np.ndarray:
        return self._row(i, 0).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        """Bits of the mapped file."""
        return self._row(i, 1)

    def stream(self):
        """The ids of one record batch after the other, without padding."""
        for k in range(self.reader.num_record_batches):
            b = self.reader.get_batch(k)
            ids, mask = b.column(0).values.to_numpy(zero_copy_only=True), b.column(1).values
            yield ids if mask[-1].as_py() else ids[: mask.true_count]


def read_tokens(listed: DataFrame) -> DataFrame:
    """Per document of the listed files: doc_id, start (ids in all documents before it), n_tokens, ids_crc32."""
    files = listed.select("file", "start").repartitionByRange(max(1, listed.count()), "start")  # one for each task

    def run(batches):
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, base = _open(file)
                with fs.open_input_file(base + ".docs.arrow") as f:
                    reader = pa.ipc.open_file(f)
                    stream, rest = TokenFile(file).stream(), np.zeros(0, np.uint16)
                    for k in range(reader.num_record_batches):
                        docs = reader.get_batch(k)
                        crcs = []
                        for n in docs.column(2).to_pylist():
                            crc = 0
                            while n > len(rest):
                                crc = zlib.crc32(rest.astype("<u4"), crc)
                                n -= len(rest)
                                rest = next(stream)
                            crcs.append(zlib.crc32(rest[:n].astype("<u4"), crc))
                            rest = rest[n:]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(docs.column(1).to_numpy() + start), docs.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
