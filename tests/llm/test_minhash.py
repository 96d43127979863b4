"""Near duplicates of five-word shingles at 0.8, against brute force."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import minhash

from .test_exact import WORD, classes, lowered


def grams(t):
    w = WORD.findall(lowered(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) and bool(a)


def corpus():
    """Texts of 200 random words, and copies of each in which some words are others: similarities from 0.6 to 1, and chains of copies of copies."""
    rng = np.random.default_rng(1)
    out = {}
    for base in range(12):
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        out[base * 10] = " ".join(w)
        for copy in range(1, 10):
            x = list(out[base * 10 + copy // 2].split() if base % 2 else w)
            for at in rng.choice(200, 1 + copy % 8, replace=False):
                x[at] = f"new{rng.integers(0, 10**6)}"
            out[base * 10 + copy] = " ".join(x)
    return out


def test_near_dedup_reaches_copies_at_08(spark):
    texts = corpus()
    sets = {i: grams(t) for i, t in texts.items()}
    want = classes(sorted(texts), lambda a, b: similar(sets[a], sets[b]))
    low = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in texts for b in texts if a < b]
    assert sum(0.8 <= x < 0.9 for x in low) > 20 and sum(0.6 < x < 0.8 for x in low) > 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(want.values())


def by_component(found):
    rows, least = found.collect(), {}
    for r in rows:
        least[r.component_id] = min(r.doc_id, least.get(r.component_id, r.doc_id))
    return {r.doc_id: least[r.component_id] for r in rows}


def test_large_group(spark, monkeypatch):
    """Copies of one text that lie on both sides of 0.8 from it and from each other, by words replaced, left out, put in or moved,
    and copies of copies: the components are those of all pairs, though few pairs are compared."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 3000, 240)]
    texts, made = {0: base}, [base]
    for i in range(1, 260):
        w = list(made[int(rng.integers(0, len(made)))] if i % 4 == 0 else base)
        for _ in range(int(rng.integers(1, 14))):
            at, how = int(rng.integers(0, len(w))), rng.random()
            if how < 0.5:
                w[at] = f"n{rng.integers(0, 60 if i % 3 else 10**6)}"
            elif how < 0.7:
                del w[at : at + int(rng.integers(1, 4))]
            elif how < 0.9:
                w.insert(at, f"n{rng.integers(0, 60 if i % 3 else 10**6)}")
            else:
                w[at:at] = w[-5:]
        texts[i] = w
        made.append(w)
    texts = {i: " ".join(w) for i, w in texts.items()}
    sets = {i: grams(t) for i, t in texts.items()}
    want = classes(sorted(texts), lambda a, b: similar(sets[a], sets[b]))
    sizes = sorted(np.bincount(list(want.values())), reverse=True)
    assert sizes[0] > 60 and sizes[1] > 1 and sum(x == 1 for x in sizes) > 20
    verified, real = [], minhash._similar
    monkeypatch.setattr(minhash, "_similar", lambda pairs, sets: verified.append(pairs.count()) or real(pairs, sets))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    assert by_component(minhash.near_duplicates(docs)) == want
    assert sum(verified) < 0.2 * len(texts) ** 2 / 2


def test_near_dedup_odd_rows(docs, texts, spark):
    sets = {i: grams(t) for i, t in texts.items()}
    want = set(classes(sorted(texts), lambda a, b: similar(sets[a], sets[b])).values())
    nameless = docs.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("bigint"))
    got = minhash.dedup(docs.unionByName(nameless))
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(want) and sum(r.doc_id is None for r in rows) == 1
    assert {r.doc_id: r.text for r in rows if r.doc_id is not None} == {i: texts[i] for i in want}
    assert minhash.dedup(docs.limit(0)).count() == 0
    assert minhash.dedup(docs.filter("doc_id = 8")).count() == 1


def test_clashing_ids(spark):
    """Rows of one doc_id are one document only if they are near copies."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a, 1), (5, a + " tail", 2), (5, b, 3), (3, b + " tail", 4), (7, "some other text", 5), (7, "quite another one", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    assert sorted(r.n for r in minhash.dedup(docs).collect()) == [1, 4, 5, 6]
