"""Near duplicates by the Jaccard similarity of word shingles: a byte-position inverted index with count filtering over MinHash
sketches finds candidates, exact intersections decide.

A text is the set of its shingles' hashes; its sketch has 125 positional bytes, each of one minimum. The first ``POSTED`` of them are
indexed, in groups of seven: a set is posted under seven tuples of four (position, byte) entries a group, which leave out one line of a
Fano plane each. Any two positions lie on a line, so a group in which at most two bytes differ has a tuple whole, and a pair that shares
``TALLY`` of the 63 bytes (so differs in at most 26, in two or fewer of some of the nine groups) shares a key, without exception. Of pairs
in the posting lists the shared positional bytes are tallied before sets are fetched, and those with fewer than ``TALLY`` of the posted
ones, or ``AGREE`` of all, are dropped: at 0.8 with probabilities of 2.9e-5 (50 are expected) and 3e-10 (100), at 0.9 of 1.2e-11 and
less. So the index loses none of the pairs that the tally keeps. The rest count only if their sets reach ``SIMILAR``.

Equal sets are one group from the start. The members of a list (groups that share a key) are held against one of them, its hub: the
one whose lists are longest in all, which in a group of copies is the text that they are copies of, or close to it. Links are joined
to components. What is then still apart in a list is compared by its differences from the hub. Say x and y are similar, c is the hub
and y is not similar to c. Write D(x) for the shingles that x and c do not share, the rarest among the members first. Sets are
similar if and only if nine times the number of shingles that they do not share is at most the sum of their sizes; D(x) and D(y)
differ in just the shingles that x and y do not share. From the three sizes and y's distance from c it follows that D(x) and D(y)
share at least (|D(x)| + 1 + floor((|c| - |x|) / 9)) / 2 shingles, and at least |D(y)| - |y| / 4. So one of the shingles that they
share is among the first floor((|D(x)| + 1 - floor((|c| - |x|) / 9)) / 2) of D(x) and the first min(|D(y)|, |y| / 4 + 1) of D(y).
Pairs with such a shingle in common are found by a join and verified. The first part of D(x) is mostly what only x has, so
independent copies of one text have hardly one in common, however many they are: the components are just those of all pairs that
share a key and pass the tally, but the pairs of a large group are never made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, docs_of, given, keep_first, lookup, pieces, raw
from .graph import components
from .simhash import SEED

BANDS, ROWS = 25, 5
#: The least similarity, as a fraction: 4 / 5.
SIMILAR = (4, 5)
#: Positional bytes of the 125 that two sketches share at least.
AGREE = 70
#: Indexed positions, the lines of a Fano plane over seven of them, and the posted bytes that two sketches share at least: with one
#: fewer, three could differ in each of the nine groups.
POSTED, LINES = 63, ((0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5))
TALLY = POSTED - 3 * (POSTED // 7) + 1
#: Groups of positions that are posted at once; the lists of others wait, so that their shuffles are never on disk together.
TOGETHER = 3
#: Places that the set or sketch of a hub is sent to.
SALTS = 8
_RNG = np.random.default_rng(SEED)
_FACTOR, _SHIFT = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the lower-cased words (as in simhash); a shorter text is one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n))


def set_id(shingled: np.ndarray) -> int:
    """A 64-bit name of the set, signed."""
    x = xxhash.xxh3_64_intdigest(shingled.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def band_keys(shingled: np.ndarray) -> np.ndarray:
    """The sketch, packed: the number of five positions, and below it their bytes."""
    if not len(shingled):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingled), 1024):
        np.minimum(least, (shingled[a : a + 1024] * _FACTOR + _SHIFT).min(1), out=least)
    out = np.zeros((BANDS, 8), np.uint8)
    out[:, :ROWS] = (least >> np.uint64(32)).astype(np.uint8).reshape(BANDS, ROWS)
    out[:, ROWS] = np.arange(BANDS)
    return out.view("<i8").ravel().astype(np.int64)


def unpacked(sketched: pa.Array) -> np.ndarray:
    """The positional bytes of sketches (band_keys), a row each."""
    return sketched.flatten().to_numpy().view(np.uint8).reshape(-1, BANDS, 8)[:, :, :ROWS].reshape(-1, BANDS * ROWS)


def posting_keys(positional: np.ndarray, first: int = 0, last: int = POSTED // 7) -> np.ndarray:
    """The keys of rows of positional bytes, of the groups from first to last: the number of the tuple, and below it its four bytes."""
    out = np.zeros((len(positional), 7 * (last - first), 8), np.uint8)
    for i in range(out.shape[1]):
        group, line = first + i // 7, LINES[i % 7]
        out[:, i, :4] = positional[:, [7 * group + p for p in range(7) if p not in line]]
        out[:, i, 4] = 7 * group + i % 7
    return out.view("<i8").reshape(out.shape[:2]).astype(np.int64)


def postings(groups: DataFrame) -> list[DataFrame]:
    """set_id, size, key of all sets with a sketch, ``TOGETHER`` groups of positions a frame."""

    def post(first: int, last: int):
        def run(batches):
            for b in batches:
                b = b.filter(pc.greater(pc.list_value_length(b.column(2)), 0))
                keys = posting_keys(unpacked(b.column(2)), first, last)
                each = pa.array(np.repeat(np.arange(b.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(each), b.column(1).take(each), pa.array(keys.ravel())], names=["set_id", "size", "key"])

        return run

    rows, n = groups.select("set_id", "size", "sketch"), POSTED // 7
    return [rows.mapInArrow(post(i, min(i + TOGETHER, n)), "set_id bigint, size bigint, key bigint") for i in range(0, n, TOGETHER)]


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, set_id, size (of the set), keys (its sketch; none for an empty set) of every row."""

    def run(batches):
        for b in pieces(batches):
            sets = [shingles(x, words) for x in raw(b.column(1))]
            keys = [band_keys(s) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), listed], names=["doc_id", "set_id", "size", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, set_id bigint, size bigint, keys array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """set_id, hashes: each set once."""

    def run(batches):
        for b in pieces(batches, most=1 << 18):
            sets = [shingles(x, words) for x in raw(b.column(1))]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), listed], names=["set_id", "hashes"])

    return docs.mapInArrow(run, "set_id bigint, hashes array<bigint>").groupBy("set_id").agg(F.first("hashes").alias("hashes"))


def enough(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Whether two sketches (band_keys) share ``TALLY`` posted bytes and ``AGREE`` positional bytes in all, of each pair."""
    same = unpacked(x) == unpacked(y)
    return (same[:, :POSTED].sum(1) >= TALLY) & (same.sum(1) >= AGREE)


def _agreeing(pairs: DataFrame, sketched: DataFrame, keep) -> DataFrame:
    """The pairs (a, b, ...) whose sketches may belong to similar sets. sketched: set_id, sketch of the sets in them.

    One b may have a great part of all pairs, so its sketch is sent to ``SALTS`` places.
    """

    def run(batches):
        for p in batches:
            n = p.num_columns - 2
            if p.num_rows:
                yield p.select(range(n)).filter(pa.array(keep(p.column(n), p.column(n + 1))))

    left = sketched.select(F.col("set_id").alias("a"), F.col("sketch").alias("_x"))
    right = pairs.select("b").distinct().join(sketched.withColumnRenamed("set_id", "b"), "b").select("b", F.col("sketch").alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    both = pairs.join(left, "a").withColumn("_salt", F.pmod("a", F.lit(SALTS)).cast("int")).join(right, ["b", "_salt"])
    return both.select(*pairs.columns, "_x", "_y").mapInArrow(run, pairs.schema)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    up, down = SIMILAR
    left = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("_x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("_y"))
    both = pairs.join(left, "a").join(right, "b")
    shared, sizes = F.size(F.array_intersect("_x", "_y")), F.size("_x") + F.size("_y")
    return both.filter((up + down) * shared >= up * sizes).select("a", "b")


def _near_size(x: str, y: str):
    """Sets of other sizes cannot be similar enough."""
    up, down = SIMILAR
    return F.least(x, y) * down >= F.greatest(x, y) * up


def _long(lists: DataFrame) -> DataFrame:
    """set_id, long: how long its lists are in all."""
    return lists.groupBy("set_id").agg(F.sum("n").alias("long"))


def _hubs(lists: DataFrame, long: DataFrame) -> DataFrame:
    """key, hub, hub_size: of each list the member whose lists are longest in all."""
    first = F.struct(-F.coalesce("long", F.lit(0)), "set_id", "size")
    hubs = lists.join(long, "set_id", "left").groupBy("key").agg(F.min(first).alias("h"))
    return hubs.select("key", F.col("h.set_id").alias("hub"), F.col("h.size").alias("hub_size"))


def _members(posts: list[DataFrame]) -> DataFrame | None:
    """hub, hub_size, set_id, size: the members of all lists of two or more, hubs among them; None if there is no such list. posts: set_id,
    size, key. Frames are worked on one after the other; the lengths of the first lists say which sets are hubs in all."""
    out, long = None, None
    for each in posts:
        shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        lists = cut(each.join(shared, "key").select("key", "set_id", "size", "n"))
        if lists.isEmpty():
            continue
        long = long or cut(_long(lists))
        members = cut(lists.join(_hubs(lists, long), "key").select("hub", "hub_size", "set_id", "size").distinct())
        out = members if out is None else out.unionByName(members)
    return out if out is None or len(posts) == 1 else cut(out.distinct())


def _held(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (hub, set_id, size, ...) with c, the size of the hub's set, and d, the shingles that the two do not share.

    A hub may have a great part of all sets for members, so its set is sent to ``SALTS`` places.
    """
    hubs = members.select("hub").distinct().join(sets.withColumnRenamed("set_id", "hub"), "hub").select("hub", F.col("hashes").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    both = members.join(sets, "set_id").withColumn("_salt", F.pmod("set_id", F.lit(SALTS)).cast("int")).join(hubs, ["hub", "_salt"])
    return both.select(*members.columns, F.size("_c").alias("c"), F.concat(F.array_except("hashes", "_c"), F.array_except("_c", "hashes")).alias("d"))


def _by_differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different parts that may be similar, all of those that are and share a hub, given that no set is similar to
    its hub but in another part. members: hub, set_id, size, part."""
    held = cut(_held(members, sets))
    # Shingles that no other member has come first and meet nothing: it is enough to know how many they are.
    each = held.select("hub", "set_id", F.explode("d").alias("e")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("hub", "e")))
    common = each.filter("n > 1").groupBy("hub", "set_id").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("d"))
    ranked = held.select("hub", "set_id", "size", "part", "c", F.size("d").alias("all")).join(common, ["hub", "set_id"])
    d = F.col("all")
    far = 9 * d > F.col("size") + F.col("c")
    first = F.floor((d + 1 - F.floor((F.col("c") - F.col("size")) / 9)) / 2)
    long = F.when(far, F.least(d, F.floor(F.col("size") / 4) + 1)).otherwise(0)
    cut_to = lambda n: F.slice("d.e", 1, F.greatest(F.lit(0), F.least(n - d + F.size("d"), F.size("d"))).cast("int"))
    ranked = cut(ranked.select("hub", "set_id", "size", "part", cut_to(first).alias("first"), cut_to(long).alias("long")))
    x = ranked.select("hub", "set_id", "size", "part", F.explode("first").alias("e"))
    y = ranked.select("hub", F.col("set_id").alias("other"), F.col("size").alias("other_size"), F.col("part").alias("other_part"), F.explode("long").alias("e"))
    pairs = x.join(y, ["hub", "e"]).filter((F.col("part") != F.col("other_part")) & _near_size("size", "other_size"))
    return pairs.select(F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b")).distinct()


def links(groups: DataFrame, sets_of, keep=enough, posts: list[DataFrame] | None = None) -> DataFrame:
    """Links (a, b) of set ids that connect just what similar pairs with a common key, whose sketches ``keep`` lets pass, connect.

    groups: set_id (distinct), size, sketch, and keys unless there are posts (frames of set_id, size, key). sets_of: from a frame of
    set_id to set_id, hashes.
    """
    members = _members(posts or [groups.select("set_id", "size", F.explode("keys").alias("key"))])
    if members is None:
        return given(groups.sparkSession, [], "a bigint, b bigint")
    listed = cut(members.select("set_id").distinct())
    sets = cut(sets_of(listed))
    sketched = cut(groups.join(lookup(listed), "set_id", "left_semi").select("set_id", "sketch"))
    near = members.filter((F.col("set_id") != F.col("hub")) & _near_size("size", "hub_size")).select(F.col("set_id").alias("a"), F.col("hub").alias("b"), "size")
    near = cut(_agreeing(near, sketched, keep)).select(F.col("b").alias("hub"), F.col("a").alias("set_id"), "size")
    alike = _held(near, sets).filter(9 * F.size("d") <= F.col("size") + F.col("c"))
    found = cut(alike.select(F.least("set_id", "hub").alias("a"), F.greatest("set_id", "hub").alias("b")).distinct())
    labels = components(found)
    parts = members.join(labels, members.set_id == labels.node, "left").select("hub", "set_id", "size", F.coalesce("label", "set_id").alias("part"))
    # What is similar to the hub itself has been found, so others are left to compare only where they differ among themselves.
    parts = parts.filter("set_id <> hub")
    apart = parts.groupBy("hub").agg(F.min("part").alias("_p"), F.max("part").alias("_q")).filter("_p < _q").select("hub")
    rest = cut(parts.join(apart, "hub"))
    if rest.isEmpty():
        return found
    return cut(found.unionByName(_similar(cut(_agreeing(_by_differences(rest, sets), sketched, keep)), sets)))


def sets_by(docs: DataFrame, groups: DataFrame, words: int):
    """From a frame of set_id to set_id, hashes: read again from the texts of the groups' documents (rep)."""

    def sets_of(wanted: DataFrame) -> DataFrame:
        reps = groups.join(wanted, "set_id", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
        return _sets(docs.join(lookup(cut(reps)), "doc_id", "left_semi").select("doc_id", "text"), words)

    return sets_of


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, set_id, component_id (a name of the group of near duplicates) of every row; repeated doc_ids keep their own rows.

    Texts without words, null ones among them, are one group. A set that only rows without a doc_id have is linked to no other. An
    empty table gives an empty one; other columns are ignored whatever their names.
    """
    docs = docs_of(docs)
    prints = cut(sketches(docs, words))
    named = prints.filter("doc_id is not null")
    groups = cut(named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("keys").alias("sketch")))
    labels = components(links(groups, sets_by(docs, groups, words), posts=postings(groups)))
    joined = prints.join(labels, prints.set_id == labels.node, "left")
    return joined.select("doc_id", "set_id", F.coalesce("label", "set_id").alias("component_id"))


def dedup(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs without all but the document of the smallest doc_id in each group of near duplicates; columns as given.

    Of rows that repeat a doc_id with near duplicates one stays. Rows without a doc_id stay: nothing can name them.
    """
    found = cut(near_duplicates(docs, words))
    return keep_first(docs, found.withColumnRenamed("set_id", "key"), lambda x: set_id(shingles(x, words)))
