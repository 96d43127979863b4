"""Near duplicates of four-word shingles with sequential verification, against brute force; and hot keys of joins."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.llm import bayes, common, graph
from quernstone.llm import queries as Q

from .test_exact import WORD, classes, lowered
from .test_minhash import corpus


def grams(t):
    w = WORD.findall(lowered(t or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def wanted(texts):
    sets = {i: grams(t) for i, t in texts.items()}
    return sets, classes(sorted(texts), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))


def test_op13(spark, texts, tmp_path):
    every = dict(texts) | {1000 + i: t for i, t in corpus().items()} | {2000 + i: texts[9].upper() if i else "the SAME" for i in range(3)} | {2010: "the same"}
    sets, least = wanted(every)
    rows = [*every.items(), (3, every[3]), (None, every[5]), (None, "nothing else is like this text at all"), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "'x' as part", "0 as size").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op13_bayes_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = got.collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is not None) == sorted((i, len(sets[i]), least[i], least[i] == i) for i, _ in rows if i is not None)
    rest = sorted((r.n_shingles, str(r.component_id), r.kept) for r in found if r.doc_id is None)
    assert rest == sorted([(len(sets[5]), str(least[5]), False), (5, "None", True), (0, "None", True)])


def test_empty(spark, empty):
    assert bayes.near_duplicates(empty).collect() == []


def test_posterior_by_integration():
    """The closed form against the integral over all similarities."""
    s = (np.arange(200_000) + 0.5) / 200_000
    p = s + (1 - s) / 256
    for m, n in ((5, 16), (12, 16), (57, 96), (100, 128)):
        like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p))
        assert abs(like[s >= 0.8].sum() / like.sum() - bayes.posterior(m, n, 0.8)) < 1e-5


def test_bounds_and_misses():
    fewest = bayes.bounds(0.8)
    for n, least in zip(range(bayes.BATCH, bayes.SIZE + 1, bayes.BATCH), fewest, strict=True):
        assert bayes.posterior(least, n, 0.8) >= bayes.MISS and (least == 0 or bayes.posterior(least - 1, n, 0.8) < bayes.MISS)
    assert bayes.miss(0.8, fewest) < 1e-5 and bayes.miss(0.5, fewest) > 0.99
    strict = bayes.bounds(0.8, 1e-2)
    assert bayes.miss(0.8, strict) > bayes.miss(0.8, fewest)


def test_sieve_drops_batch_by_batch():
    fewest, rng = bayes.bounds(0.8), np.random.default_rng(2)
    x = rng.integers(0, 256, (400, bayes.SIZE), np.uint8)
    y = np.where(rng.random(x.shape) < rng.random((400, 1)), x, x + 1).astype(np.uint8)
    agree = np.cumsum(x == y, 1)[:, bayes.BATCH - 1 :: bayes.BATCH]
    want = (agree >= np.array(fewest)).all(1)
    assert 20 < want.sum() < 380
    binary = lambda z: pa.array([r.tobytes() for r in z], pa.binary())
    assert bayes.sieve(fewest)(binary(x), binary(y)).tolist() == want.tolist()


def test_large_group_is_dealt_out(spark, monkeypatch):
    """A third of all rows are near copies of one text: their components are those of all pairs."""
    monkeypatch.setattr(common, "HEAVY_LEAST", 20)
    monkeypatch.setattr(common, "HEAVY_MOST", 50)
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 3000, 160)]
    texts = {0: " ".join(base)}
    for i in range(1, 220):
        w = list(base)
        for at in rng.choice(160, int(rng.integers(1, 12)), replace=False):
            w[at] = f"n{rng.integers(0, 10**6)}"
        texts[i] = " ".join(w)
    texts |= {1000 + i: texts[0] for i in range(100)} | {5000 + i: " ".join(f"x{v}" for v in rng.integers(0, 5000, 60)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in bayes.near_duplicates(docs).collect()} == wanted(texts)[1]


def test_star_is_dealt_out(spark):
    """The edges of one node do not meet in one task."""
    n = 200_000
    edges = spark.range(1, n).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b")).repartition(16)
    counts = common.cut(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    sizes = common.spread_join(edges, counts, "a").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == n - 1 and max(r["count"] for r in sizes) < 0.1 * n
    assert graph.components(edges).agg(F.count("*").alias("n"), F.max("label").alias("label")).first() == (n - 1, 0)
