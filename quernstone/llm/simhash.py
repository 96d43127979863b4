"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits, so 8 positional bytes. Two fingerprints that differ in at most k bits
agree in at least 8 - k positional bytes. The index posts each distinct fingerprint under tuples of
three (position, byte) entries; the tuples are chosen so that any 8 - k positions hold at least one
of them whole, so no pair in reach is missed. Inside a posting list the shared positional bytes of a
pair are tallied, pairs with fewer than 8 - k are dropped, and the rest is verified bit by bit.

Only distinct fingerprints are indexed, a posting list yields a spanning forest of its links and not
the pairs, and lists longer than ``list_most`` are divided by two further positions; what is still too
long (thousands of different fingerprints that agree in 40 bits) is linked through common points at
one bit from one and two bits from the other, which is exact and linear.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, docs_of, given, keep_first, pieces, raw, small_batches
from .graph import components, spanning

SEED = 42
LIST_MOST = 16384


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the lower-cased words of a UTF-8 text; 0 without words."""
    parts = text.lower().split()  # of bytes: A-Z only, and white space is exactly \x20 \x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    starts, last = starts[:n].tolist(), last.tolist()
    for a in range(0, n, 1 << 16):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + (1 << 16)], last[a : a + (1 << 16)], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (bigint with the fingerprint's bits) of every document."""

    def run(batches):
        for b in pieces(batches):
            fps = np.array([fingerprint(x, words) for x in raw(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, fp bigint")


def position_tuples(matches: int) -> list[tuple[int, int, int]]:
    """Triples of the 8 positions such that any ``matches`` positions contain one of them."""
    if matches >= 5:
        parts = (range(0, 4), range(4, 8))
        return [t for p in parts for t in combinations(p, 3)]
    if matches == 4:
        g = ((0, 1, 2), (3, 4, 5), (6, 7))
        own = [t for p in g for t in combinations(p, 3)]
        return own + [(*two, one) for i, p in enumerate(g) for two in combinations(p, 2) for one in g[(i + 1) % 3]]
    if matches == 3:
        return list(combinations(range(8), 3))
    raise ValueError("at most 5 differing bits can be searched with byte triples")


def _byte(p: int):
    return F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))


def _key(positions: tuple[int, ...], label: int):
    out = F.lit(label).cast("bigint")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(p))
    return out


def _forest(batches, bits: int, matches: int):
    """Links inside the posting lists of rows sorted by key, as a spanning forest of each piece."""
    keep: list[pa.RecordBatch] = []
    held = 0

    def links(table: pa.Table):
        key = table["key"].to_numpy()
        fp = table["fp"].to_numpy().view(np.uint64)
        rep = table["rep"].to_numpy()
        order = np.argsort(key, kind="stable")
        key, fp, rep = key[order], fp[order], rep[order]
        left, right = [], []
        alive = np.arange(len(key) - 1)
        lag = 1
        while len(alive):
            alive = alive[alive + lag < len(key)]
            alive = alive[key[alive] == key[alive + lag]]
            x = fp[alive] ^ fp[alive + lag]
            tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            some = tally >= matches
            some[some] = np.bitwise_count(x[some]) <= bits
            if some.any():
                left.append(rep[alive[some]])
                right.append(rep[alive[some] + lag])
            if sum(map(len, left)) > 1 << 20:
                left, right = (list(z) for z in zip(spanning(left, right), strict=True))
            lag += 1
        if left:
            a, b = spanning(left, right)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held and held + batch.num_rows > 1 << 18:
            last = keep[-1].column(0)[-1].as_py()
            first = int(np.searchsorted(keys, last, "right"))  # rows are sorted by key
            keep.append(batch.slice(0, first))
            if first < batch.num_rows:
                yield from links(pa.Table.from_batches(keep))
                keep, held = [], 0
                batch = batch.slice(first)
            else:
                held += batch.num_rows
                continue
        keep.append(batch)
        held += batch.num_rows
    if keep:
        yield from links(pa.Table.from_batches(keep))


def links(groups: DataFrame, bits: int = 3, list_most: int = LIST_MOST) -> DataFrame:
    """Links (a, b) between representatives that connect just what pairs in reach connect.

    groups: fp (distinct), rep (a bigint that names it).
    """
    matches = 8 - bits
    keyed = lambda rows, tuples: rows.select(F.explode(F.array(*[F.struct(_key(t, i + 1).alias("key"), F.col("fp"), F.col("rep")) for i, t in enumerate(tuples)])).alias("x")).select("x.*")

    def too_long(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > list_most).select("key"))

    def within(rows: DataFrame) -> DataFrame:
        dealt = rows.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(lambda it: _forest(it, bits, matches), "a bigint, b bigint")

    tuples = position_tuples(matches)
    posts = keyed(groups, tuples)
    long = too_long(posts)
    if long.isEmpty():
        return within(posts)
    out = within(posts.join(long, "key", "left_anti"))
    # Each long list again under two more positions: five equal bytes, 24 free bits. A pair in such a list
    # shares `matches` positions, the list's own three among them, so with matches >= 5 at least two more.
    hot = posts.join(long, "key").select("key", "fp", "rep")
    if matches < 5:
        return out.unionByName(_through(hot, bits))
    finer = []
    for i, t in enumerate(tuples):
        others = [p for p in range(8) if p not in t]
        for j, two in enumerate(combinations(others, 2)):
            finer.append(F.when(F.shiftrightunsigned("key", 24) == i + 1, F.struct(_key((*t, *two), 64 + 16 * i + j).alias("key"), F.col("fp"), F.col("rep"))))
    fine = hot.select(F.explode(F.array_compact(F.array(*finer))).alias("x")).select("x.*")
    longer = too_long(fine)
    out = out.unionByName(within(fine.join(longer, "key", "left_anti")))
    if not longer.isEmpty():
        out = out.unionByName(_through(fine.join(longer, "key"), bits))
    return out


def _through(rows: DataFrame, bits: int) -> DataFrame:
    """Exact links of lists of any length: a and b are within k bits if and only if some point lies within
    k // 2 bits of one and k - k // 2 bits of the other. Every point in reach of a row is a meeting place."""
    near, far = bits // 2, bits - bits // 2
    masks = [(d, sum(1 << x for x in c)) for d in range(far + 1) for c in combinations(range(64), d)]
    table = given(rows.sparkSession, [(d <= near, _signed(m)) for d, m in masks], "near boolean, mask bigint")
    met = rows.select(F.col("fp"), "rep").distinct().join(F.broadcast(table)).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("at"), "near", "rep")
    hubs = met.groupBy("at").agg(F.min(F.when(F.col("near"), F.col("rep"))).alias("hub"), F.count(F.lit(1)).alias("n")).filter("hub is not null and n > 1").drop("n")
    return met.join(hubs, "at").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, list_most: int = LIST_MOST, keys: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits; with ``keys`` key, the same as a bigint), component_id of every document.

    Documents without words, null texts among them, have fingerprint zero and are linked like any others. Repeated doc_ids keep
    their own rows. A null doc_id is kept; its row gets the component of its fingerprint, null if no row with an id has that one.
    Empty table: empty result. doc_id must be of an integer type; other columns are ignored whatever their names.
    """
    docs = docs_of(docs)
    prints = cut(fingerprints(docs, words))
    groups = cut(prints.groupBy("fp").agg(F.min(F.col("doc_id").cast("bigint")).alias("rep")).filter("rep is not null"))
    labels = components(links(groups, bits, list_most))
    named = groups.join(labels, groups.rep == labels.node, "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    named = cut(named)
    joined = prints.join(named, "fp", "left")
    if keys:
        return joined.select("doc_id", F.col("fp").alias("key"), "component_id")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, words: int = 5, bits: int = 5, **how) -> DataFrame:
    """docs without all but the document of the smallest doc_id in each group of near duplicates; columns as given.

    Of rows that repeat a doc_id with near duplicates one stays. Rows without a doc_id stay: nothing can name them.
    """
    small_batches(docs.sparkSession)
    found = cut(near_duplicates(docs, words, bits, keys=True, **how))
    return keep_first(docs, found, lambda x: _signed(fingerprint(x, words)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
