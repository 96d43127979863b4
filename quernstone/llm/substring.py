"""Substring dedup behind a count-min prefilter.

A window is ``size`` consecutive words. First pass: windows are counted in a count-min sketch. The sketch has one row of cells,
many more than there are counts, so few windows are thought to be repeated that are not; its cells saturate at two, as all that
matters is once or more often. A slice of the documents makes a sketch of its own, held as its taken cells; the slices' sketches
are merged by ranges of cells, each in a task of its own, and the cells that were counted twice or more go back to the slices
that hold them. So no sketch is ever in one place, broadcast or of a fixed size, however many windows there are.

A window is counted under its anchor, the smallest hash of the ``gram``-word sequences in it. Equal windows have equal anchors, so
the count of the anchor is never below that of the window, and a document needs about a quarter as many counts as it has windows.

Second pass: only windows estimated repeated are grouped, exactly but for equal 96-bit digests. A task first settles what its own documents
share and passes on only those of the smallest doc_id, so a window that half of all documents hold comes to the shuffle once for
every few MB of text, and its group is streamed.

Documents are dealt to slices by a hash of their id and text, once; every pass works on that same exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, pieces, raw
from .words import Split, hashes

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_STEP = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5], np.uint64)
#: Bytes of text of a slice, on average, and those within which a task settles what its own documents share.
SLICE, PIECE = 8 << 20, 4 << 20
SETTLED = 1 << 31
#: Cells of the sketch for each byte of text. A text has about a count for every 20 bytes, so some one cell in 300 is taken.
CELLS = 16


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and two 64-bit hashes of each word."""
    split = Split(texts)
    return split.n, *hashes(split.data, split.start, split.size)


def _grams(h: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * step + h[j : j + m]
    return out ^ (out >> np.uint64(31))


def _starts(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows among the concatenated words, and the text of each."""
    offset = np.cumsum(n) - n
    count = np.maximum(n - size + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return offset[text] + inner, text


def _anchors(h: np.ndarray, starts: np.ndarray, size: int, gram: int) -> np.ndarray:
    """The least hash of the grams in the window at each start."""
    g = _grams(h, gram, _STEP[0]) * _ODD[3]
    if not len(starts):
        return np.zeros(0, np.uint64)
    m = len(g) - (size - gram)
    least = g[:m].copy()
    for j in range(1, size - gram + 1):
        np.minimum(least, g[j : j + m], out=least)
    return least[starts]


def _cells(anchor: np.ndarray, log_width: int) -> np.ndarray:
    return ((anchor * _ODD[0]) >> np.uint64(64 - log_width)).astype(np.int64)


def _runs(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, number) of the runs of consecutive places."""
    order = np.lexsort((at, part))
    part, at = part[order], at[order]
    new = np.concatenate(([True], (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    return part[first], at[first], np.diff(np.concatenate((first, [len(at)])))


def _batch(names: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names=names)


def dealt(docs: DataFrame, slice_bytes: int = SLICE) -> tuple[DataFrame, int]:
    """docs (doc_id, text) dealt to slices: slice, id (doc_id as bigint), key (a hash of the text), doc_id, text; and the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("key"), "doc_id", "text")
    slices = max(1, -(-total // slice_bytes))
    return rows.select(F.pmod(F.xxhash64("id", "key"), F.lit(slices)).alias("slice"), "*").repartition("slice"), total


def _ranked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a slice its number among the distinct (id, key), in order; and a row of each number. Rows without an id: -1."""
    i, k = table.schema.get_field_index("id"), table.schema.get_field_index("key")
    has = ~np.asarray(table.column(i).is_null())
    ids, keys = np.asarray(table.column(i).fill_null(0)), np.asarray(table.column(k))
    rows = np.flatnonzero(has)
    rows = rows[np.lexsort((keys[rows], ids[rows]))]
    new = np.concatenate(([True], (ids[rows][1:] != ids[rows][:-1]) | (keys[rows][1:] != keys[rows][:-1]))) if len(rows) else np.zeros(0, bool)
    number = np.full(len(has), -1, np.int64)
    number[rows] = np.cumsum(new) - 1
    return number, rows[new]


def twice(slices: DataFrame, size: int, gram: int, log_width: int) -> DataFrame:
    """slice, cell: the cells taken by a slice that are counted twice or more in all; a document counts once."""

    def count(batches):
        for b in pieces(batches, most=PIECE):
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows:
                continue
            n, h, _ = _hashed(raw(b.column(4)))
            starts, text = _starts(n, size)
            a = _anchors(h, starts, size, gram)
            if not len(a):
                continue
            some = np.concatenate(([True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])))  # one count for a run
            cell, text = _cells(a[some], log_width), text[some]
            part = b.column(0).to_numpy()[text]
            order = np.lexsort((text, part, cell))
            cell, text, part = cell[order], text[order], part[order]
            new = np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))
            again = np.concatenate(([False], (cell[1:] == cell[:-1]) & (part[1:] == part[:-1]) & (text[1:] != text[:-1])))
            first = np.flatnonzero(new)
            yield _batch(["cell", "slice_n"], cell[first], 2 * part[first] + (np.add.reduceat(again, first) > 0))

    def merge(batches):
        last, seen, pending = -1, 0, None  # the cell that the previous batch ended in, its count, and its slice if that is one
        for b in batches:
            cell, part = (c.to_numpy() for c in b.columns)
            if not len(cell):
                continue
            part, n = part >> 1, 1 + (part & 1)
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            total = np.add.reduceat(n, first)
            out_part, out_cell = [], []
            if cell[0] == last:
                if pending is not None:
                    out_part.append([pending])
                    out_cell.append([last])
                total[0] += seen
            more = np.repeat(total > 1, np.diff(np.concatenate((first, [len(cell)]))))
            more[1:] &= (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])
            last, seen = int(cell[-1]), int(total[-1])
            pending = int(part[-1]) if seen == 1 else None
            out_part.append(part[more])
            out_cell.append(cell[more])
            yield _batch(["slice", "cell"], np.concatenate(out_part), np.concatenate(out_cell))

    # All columns go in, so that the exchange is the one that the other passes use.
    counts = slices.mapInArrow(count, "cell bigint, slice_n bigint")  # the count less one is the lowest bit
    return counts.repartition("cell").sortWithinPartitions("cell", "slice_n").mapInArrow(merge, "slice bigint, cell bigint")


def repeated_windows(slices: DataFrame, size: int, gram: int, log_width: int) -> DataFrame:
    """slice, at, n: the n windows from the place ``at`` on (number of the row in its slice, word) start in a document with a smaller id, too."""
    # lo: 32 more bits of the digest, then whether the row is settled (its id is then a number of windows), then the slice in 31 bits.
    names = ["hi", "lo", "id", "at"]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        known = np.unique(right.column("cell").to_numpy()) if right.num_rows and left.num_rows else np.zeros(0, np.int64)
        if not len(known):
            return schema.empty_table()
        number, rows = _ranked(left)
        part = left.column("slice")[0].as_py()
        for b in pieces(left.select(["id", "text"]).take(pa.array(rows)).combine_chunks().to_batches(), most=PIECE):
            at, ids = sum(x for _, x in out), b.column(0).to_numpy()
            n, h, g = _hashed(raw(b.column(1)))
            starts, text = _starts(n, size)
            cell = _cells(_anchors(h, starts, size, gram), log_width)
            near = np.minimum(np.searchsorted(known, cell), len(known) - 1)
            some = known[near] == cell
            starts, text = starts[some], text[some]
            if not len(starts):
                out.append((None, b.num_rows))
                continue
            hi = _grams(h, size, _STEP[0])[starts].view(np.int64)
            lo = (_grams(g, size, _STEP[1])[starts] >> np.uint64(32)).view(np.int64)
            doc, place = ids[text], ((at + text) << 32) + starts - (np.cumsum(n) - n)[text]
            order = np.lexsort((doc, lo, hi))
            hi, lo, doc, place = hi[order], lo[order], doc[order], place[order]
            new = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            first = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
            gone = doc > first
            p, k = _runs(doc[gone] * 0, place[gone])[1:] if gone.any() else (place[:0], place[:0])
            # What is settled is dealt out at random.
            low = np.concatenate((lo[~gone] << 32 | part, np.full(len(p), SETTLED | part)))
            out.append((_batch(names, np.concatenate((hi[~gone], p * 0x9E3779B1)), low, np.concatenate((doc[~gone], k)), np.concatenate((place[~gone], p))), b.num_rows))
        return pa.Table.from_batches([x for x, _ in out if x is not None], schema)

    def settle(batches):
        last = None  # digest and smallest id of the group that the previous batch ended in
        for b in batches:
            hi, lo, doc, at = (c.to_numpy() for c in b.columns)
            part, done, lo = lo & (SETTLED - 1), lo & SETTLED > 0, lo >> 32
            found = [(part[done], at[done], doc[done])]
            hi, lo, doc, part, at = hi[~done], lo[~done], doc[~done], part[~done], at[~done]
            if len(hi):
                new = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
                first = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
                if last and last[:2] == (hi[0], lo[0]):
                    first[: int(np.argmin((hi == hi[0]) & (lo == lo[0]))) or len(hi)] = last[2]
                last = hi[-1], lo[-1], first[-1]
                gone = doc > first
                if gone.any():
                    found.append(_runs(part[gone], at[gone]))
            yield _batch(["slice", "at", "n"], *(np.concatenate(x) for x in zip(*found, strict=True)))

    cells = twice(slices, size, gram, log_width)
    found = slices.groupBy("slice").cogroup(cells.groupBy("slice")).applyInArrow(candidates, ", ".join(f"{x} bigint" for x in names))
    return found.repartition("hi").sortWithinPartitions("hi", F.shiftright("lo", 32), "id").mapInArrow(settle, "slice bigint, at bigint, n bigint")


def substring_dedup(docs: DataFrame, size: int = 13, gram: int = 8, slice_bytes: int = SLICE, log_width: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words, joined by one space).

    A word goes if a window that covers it also starts in a document with a smaller doc_id. A text of fewer than ``size`` words,
    null or empty, has no window and stays whole, as do rows without a doc_id. doc_id: an integer. Rows that repeat a doc_id are
    each a document of their own, none of which is smaller than another; rows that repeat the text, too, get the same result. An empty
    table gives an empty one; other columns are ignored whatever their names. Of a very long text no more than one is in memory beside
    a slice. ``size`` is 1 or more; windows of fewer than ``gram`` words are counted themselves.

    log_width: binary logarithm of the number of cells, in proportion to the texts if not given. It changes what is shuffled, never
    the result.
    """
    if size < 1:
        raise ValueError("a window has one word at least")
    docs = docs_of(docs)
    slices, total = dealt(docs, slice_bytes)
    log_width = log_width or min(62, max(16, (CELLS * total).bit_length()))
    spans = repeated_windows(slices, size, max(1, min(gram, size)), log_width)
    kind = slices.schema["doc_id"].dataType

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        number, _ = _ranked(left)
        at, n = right.column("at").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        owner, pos = at >> 32, at & 0xFFFFFFFF
        bound = np.searchsorted(owner, np.stack((number, number + 1)))
        out, row = [], 0
        for b in pieces(left.select(["doc_id", "text"]).combine_chunks().to_batches(), most=PIECE):
            n_words, n_removed, kept = [], [], []
            for t in raw(b.column(1)):
                words = t.split()
                a, e = bound[:, row] if number[row] >= 0 else (0, 0)
                row += 1
                gone = 0
                if e > a:
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, pos[a:e], 1)
                    np.add.at(mark, np.minimum(pos[a:e] + n[a:e] + size - 1, len(words)), -1)
                    off = np.cumsum(mark)[:-1] > 0
                    gone = int(off.sum())
                    kept.append(b" ".join([w for w, x in zip(words, off.tolist(), strict=True) if not x]).decode("utf-8", "replace"))
                else:
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                n_words.append(len(words))
                n_removed.append(gone)
            out.append(pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"]))
        return pa.Table.from_batches(out, pa.schema([(left.schema.field("doc_id").with_name("doc_id")), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))

    return slices.groupBy("slice").cogroup(spans.groupBy("slice")).applyInArrow(remove, f"doc_id {kind.simpleString()}, n_words bigint, n_removed bigint, kept_text string")
