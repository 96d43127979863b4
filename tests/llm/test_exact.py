"""Operators with an exact answer, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import common, decontam, graph, packing, simhash, substring, suffix, tokens
from quernstone.llm import queries as Q

from ..oracle import compare

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t, pattern=WORD):
    return pattern.findall((t or "").encode())


def lowered(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def fingerprint(t, n):
    w = WORD.findall(lowered(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "bits", "most"), [(3, 3, 16384), (3, 3, 2), (5, 5, 16384), (3, 4, 2)])
def test_simhash(docs, texts, n, bits, most):
    fp = {i: fingerprint(t, n) for i, t in texts.items()}
    want = classes(sorted(texts), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= bits)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, n, bits, list_most=most).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in texts}


def test_simhash_dense_group(spark):
    """Many fingerprints in one small ball: posting lists beyond the limit are divided and then linked through meeting points."""
    rng = np.random.default_rng(0)
    fps = {0}
    for _ in range(150):
        x = int(rng.choice(sorted(fps)))
        for b in rng.integers(0, 20, 2):
            x ^= 1 << int(b)
        fps.add(x)
    far = {int(x) for x in rng.integers(0, 2**63, 30)}
    rows = sorted(fps | far)
    g = spark.createDataFrame([(x, i) for i, x in enumerate(rows)], "fp bigint, rep bigint")
    want = classes(range(len(rows)), lambda a, b: (rows[a] ^ rows[b]).bit_count() <= 3)
    for most in (16384, 20, 3):
        labels = {r.node: r.label for r in graph.components(simhash.links(g, 3, most)).collect()}
        assert {i: labels.get(i, i) for i in want} == want


def test_position_tuples():
    from itertools import combinations

    for matches in (3, 4, 5):
        chosen = [set(t) for t in simhash.position_tuples(matches)]
        assert all(any(t <= set(c) for t in chosen) for c in combinations(range(8), matches))


def test_dedup_keeps_one(docs, texts, spark):
    again = docs.unionByName(docs.filter("doc_id = 5")).unionByName(docs.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("bigint")))
    kept = simhash.dedup(again, 5, 5)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and ids.count(None) == 1 and 20 not in ids and 21 not in ids and 3 in ids and 51 not in ids


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.label for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_quality_rules(docs, texts):
    got = {r.doc_id: r for r in suffix.quality_rules(docs).collect()}
    for i, t in texts.items():
        w, r = words(t), got[i]
        covered = lambda n, w=w: {p for v in grams(w, n).values() if len(v) > 1 for s in v for p in range(s, s + n)}
        three, ten = covered(3), covered(10)
        lines = [x for x in (t or "").encode().split(b"\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(three) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed, r.covered_words) == (len(lines) - len(set(lines)), len(three), failed, len(ten))
        if len(w) < 300:
            assert r.longest_repeat == max((n for n in range(len(w)) if any(len(v) > 1 for v in grams(w, n).values())), default=0)
        assert r.kept == (not failed and len(ten) <= 0.3 * len(w) and r.longest_repeat <= 100)


def grams(w, n):
    out = collections.defaultdict(list)
    for k in range(len(w) - n + 1):
        out[tuple(w[k : k + n])].append(k)
    return out


def without_repeats(rows, size):
    """Of each (doc_id, text): number of words, number removed, kept text."""
    first = {}
    for i, t in rows:
        for k in grams(words(t), size) if i is not None else ():
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for k, v in grams(w, size).items() if first[k] < i for s in v for p in range(s, s + size)} if i is not None else set()
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "how"), [(13, {}), (13, {"log_width": 6, "slice_bytes": 3000}), (13, {"slice_bytes": 500}), (5, {}), (1, {"slice_bytes": 20_000})])
def test_substring_dedup(docs, texts, size, how):
    """A sketch that is full decides nothing, nor does the size of slices."""
    got = substring.substring_dedup(docs, size=size, **how).collect()
    assert sorted([tuple(r) for r in got], key=str) == without_repeats(list(texts.items()), size)
    assert sum(r.n_removed for r in got) > 6000


def test_substring_dedup_repeated_ids(spark, texts):
    """Rows that share an id, with equal or other texts, and rows without one."""
    rows = [(1, texts[11]), (1, texts[5]), (1, texts[5]), (2, texts[5]), (2, texts[11] + " " + texts[5]), (2, "short"), (None, texts[5]), (None, None), (3, None), (3, texts[50]), (2, texts[50])]
    for how in ({}, {"slice_bytes": 700}):
        got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id int, text string"), **how).collect()
        assert sorted([tuple(r) for r in got], key=str) == without_repeats(rows, 13)
    with pytest.raises(ValueError, match="one word"):
        substring.substring_dedup(spark.createDataFrame(rows, "doc_id int, text string"), size=0)


def test_substring_dedup_passes_few(spark, data):
    """The sketch passes hardly more windows than are repeated, at the load that it has for inputs of every size."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    n = collections.Counter(k for _, w in rows for k in grams(w, 13))
    repeated = sum(len(v) for _, w in rows for k, v in grams(w, 13).items() if n[k] > 1)
    windows = sum(max(0, len(w) - 12) for _, w in rows)
    slices, total = substring.dealt(docs, 1 << 18)
    cells = collections.defaultdict(set)
    for r in substring.twice(slices, 13, 8, (substring.CELLS * total).bit_length()).collect():
        cells[r.slice].add(r.cell)
    passed = 0
    for r in slices.collect():
        k, h, _ = substring._hashed([r.text.encode()])
        starts, _ = substring._starts(k, 13)
        passed += sum(c in cells[r.slice] for c in substring._cells(substring._anchors(h, starts, 13, 8), (substring.CELLS * total).bit_length()).tolist())
    assert repeated <= passed <= repeated + 0.02 * windows


ITEMS = [(1, "of3 and the Quick-Brown"), (2, None), (3, "one two"), (4, "漢字"), (5, "--"), (6, "ONE"), (6, "x y x"), (7, "a a a a a a a a a a a a")]


def test_decontamination(spark, docs, texts):
    items = [*ITEMS, (8, texts[9][:150]), (9, texts[9][:150]), (10, texts[50][500:900])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    windows = collections.defaultdict(set)
    for item, t in items:
        w = tuple(PLAIN.findall(lowered(t)))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[w[k : k + 10]].add(str(item))
    for most in (8 << 20, 300):
        got = {r.doc_id: r for r in decontam.benchmark_hits(docs, bench, 10, most_bytes=most).collect()}
        for i, t in texts.items():
            w, hit, found = PLAIN.findall(lowered(t)), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if x := windows.get(tuple(w[k : k + n])):
                        hit |= set(range(k, k + n))
                        found |= x
            r = got[i]
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(found), bool(hit))


def test_clean(spark, docs, texts):
    bench = spark.createDataFrame([(1, texts[9])], "item_id int, text string")
    got = {r.doc_id: r for r in decontam.clean(docs, bench).collect()}
    assert 9 not in got and got[8].text == texts[8] and got[8].n_chars == -1 and got[40].text is None
    with_passage = docs.filter("doc_id = 8").withColumn("text", F.concat("text", F.lit("!\n"), F.lit(texts[9]), F.lit(" -- end")))
    r = decontam.clean(with_passage, bench).first()
    assert r.text == texts[8] + "!\n -- end" and r.n_chars == len(r.text)
    assert decontam.clean(docs, bench.limit(0)).count() == len(texts)


def test_token_files(docs, texts):
    tok = tokens.encoder().tok
    listed = tokens.write_tokens(docs, length=16, files=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(listed).collect()}
    stream = []
    for i in sorted(texts):
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert got[i] == (len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        stream += ids
    for r in listed.collect():
        f = tokens.TokenFile(r.file)
        n = -(-r.n_tokens // 16)
        back = np.concatenate([f.sequence(i) for i in range(n)])
        assert back[: r.n_tokens].tolist() == stream[r.start : r.start + r.n_tokens]
        assert sum(f.mask(i).true_count for i in range(n)) == r.n_tokens
        assert f.sequence(0).base is not None  # a view, not a copy


def test_encoder_forgets(texts):
    e, full = tokens.Encoder(most=20), tokens.encoder()
    for t in texts.values():
        assert e([t or ""])[0].tolist() == full.tok.encode(t or "", add_special_tokens=False).ids


def test_other_operators_drop_what_tokens_learnt():
    """An encoder serves the next task of its own operators only."""
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None]})
    kept = tokens.encoder()
    assert sum(b.num_rows for b in common.pieces([batch], operator="tokens")) == 2 and tokens.encoder() is kept
    assert sum(b.num_rows for b in common.pieces([batch])) == 2 and tokens.encoder() is not kept


def test_boundaries():
    from itertools import combinations

    rng = np.random.default_rng(1)
    for _ in range(30):
        x = sorted(rng.choice(60, 9, replace=False).tolist())
        c = rng.integers(1, 9, 9).tolist()
        pad = lambda bounds, x=x, c=c: sum(n * (min(b for b in bounds if b >= v) - v) for v, n in zip(x, c, strict=True))
        for k in (1, 2, 4, 12):
            best = min(pad([*cut, x[-1]]) for cut in combinations(x[:-1], min(k, 9) - 1))
            found = packing.boundaries(x, c, k)
            assert len(found) <= k and pad(found) == best


def test_pack(spark):
    n = {i: (i * 37) % 90 for i in range(200)}
    rows = spark.createDataFrame(list(n.items()), "doc_id bigint, n_tokens bigint").withColumn("bucket", F.lit("clash"))
    got = packing.pack(rows, longest=32, buckets=3, budget=128, parts=4).collect()
    for i, t in n.items():
        mine = sorted((r.piece, r.n_tokens) for r in got if r.doc_id == i)
        assert sum(x for _, x in mine) == t and [p for p, _ in mine] == list(range(len(mine))) and all(x == 32 for _, x in mine[:-1])
    batches = collections.defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket <= 32
        batches[r.bucket, int(r.batch_id.split("-")[1])].append(r)
    for (b, k), rows_ in batches.items():
        full = 128 // b
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
        assert len(rows_) == full or (b, k + 1) not in batches
        assert not (b, k) > max(x for x in batches if x[0] == b)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, data, name):
    compare(spark, data, Q.queries()[name], Q.oracle_sql()[name])


def test_digests(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kept_sha256 for r in Q.op4_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[40] == got[41] == hashlib.sha256(b"").hexdigest()


def test_empty(spark, empty):
    bench = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    for df in (simhash.near_duplicates(empty), simhash.dedup(empty), suffix.quality_rules(empty), substring.substring_dedup(empty), decontam.benchmark_hits(empty, bench), decontam.benchmark_hits(empty, bench.limit(0)), tokens.read_tokens(tokens.write_tokens(empty)), packing.pack(tokens.token_counts(empty))):
        assert df.count() == 0
