import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.functions import vectors as V
from quernstone.operators import bm25, chunk, embed, fusion, hnsw, ivf, kmeans, knn, metrics, project, quantize, rag, rerank
from quernstone.sources import files, synthetic


def vectors(spark, x, extra="", rows=()):
    rows = rows or [()] * len(x)
    return spark.createDataFrame([(i, [float(v) for v in e], *r) for i, (e, r) in enumerate(zip(x, rows, strict=True))], "id bigint, embedding array<float>" + extra)


def one(spark, u, v, f):
    return spark.createDataFrame([(list(map(float, u)), list(map(float, v)))], "u array<float>, v array<float>").select(f(F.col("u"), F.col("v"))).first()[0]


@pytest.mark.parametrize(("u", "v", "cosine", "l2", "l1"), [((1, 0), (1, 0), 0, 0, 0), ((1, 0), (0, 1), 1, 2**0.5, 2), ((1, 0), (-1, 0), 2, 2, 2), ((0, 0), (3, 4), 1, 5, 7)])
def test_distances(spark, u, v, cosine, l2, l1):
    assert one(spark, u, v, V.cosine_distance) == pytest.approx(cosine)
    assert one(spark, u, v, V.euclidean) == pytest.approx(l2)
    assert one(spark, u, v, V.manhattan) == pytest.approx(l1)
    assert one(spark, u, v, lambda a, b: V.distance(a, b, "dot")) == pytest.approx(-np.dot(u, v))
    with pytest.raises(ValueError, match="unknown metric"):
        V.distance(F.col("u"), F.col("v"), "chebyshev")


def test_batch_search_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    v = vectors(spark, x).repartition(3)
    q = v.filter("id < 7").select(F.col("id").alias("qid"), "embedding")
    want = {(i, int(j)) for i in range(7) for j in np.argsort(np.linalg.norm(x.astype(np.float32) - x[i].astype(np.float32), axis=1), kind="stable")[:5]}
    for most in (128, 1 << 20):
        assert {(r.qid, r.id) for r in knn.batch_search(v, q, 5, "l2", most_bytes=most).collect()} == want
    assert knn.batch_search(v, q.limit(0), 5).count() == 0
    assert knn.batch_search(v.limit(0), q, 5).count() == 0


def test_ties_by_id(spark):
    v = vectors(spark, [[1, 0]] * 9)
    q = v.limit(1).select(F.col("id").alias("qid"), "embedding")
    assert sorted(r.id for r in knn.batch_search(v, q, 4).collect()) == [0, 1, 2, 3]
    assert [r.id for r in knn.search(v, [1.0, 0.0], 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_graph(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    g = hnsw.Graph(16, "l2", m=8, seed=3)
    for e in x:
        g.add(e)
    assert all(len(n) <= (g.m0 if y == 0 else g.m) and i not in n for y, layer in enumerate(g.links) for i, n in layer.items())
    assert all(i in g.links[0][j] for i, n in g.links[0].items() for j in n)
    reached, todo = {g.entry}, [g.entry]
    while todo:
        todo = [y for n in todo for y in g.links[0][n] if y not in reached and not reached.add(y)]
    assert len(reached) == 400
    v = vectors(spark, x, ", is_deleted boolean, tag string", [(i % 10 == 0, "rare" if i < 3 else "common") for i in range(400)])
    built = hnsw.build(v, 2, metric="l2", m=8, seed=3)
    q = v.filter("id >= 380").select(F.col("id").alias("qid"), "embedding")
    got = hnsw.search(built, q, 10, 64, "l2").collect()
    assert not any(r.id % 10 == 0 for r in got)
    exact = {(r.qid, r.id) for r in knn.batch_search(v.filter("not is_deleted"), q, 10, "l2").collect()}
    assert len(exact & {(r.qid, r.id) for r in got}) >= 0.9 * len(exact)
    rare = hnsw.search(built, q, 10, 64, "l2", {"tag": "rare"}, v.filter("not is_deleted")).collect()
    assert {r.id for r in rare} == {1, 2}
    same = hnsw.build(v, 2, metric="l2", m=8, seed=3)
    assert hnsw.edges(built).exceptAll(hnsw.edges(same)).isEmpty()
    assert hnsw.topology(built, 20).filter("a >= b").isEmpty()
    assert {r.type for r in hnsw.trace(built, x[0].tolist(), metric="l2").collect()} >= {"entry", "beam_candidate"}


def test_kmeans_and_cells(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, size=(40, 4)) for c in (0, 5, 10)])
    v = vectors(spark, x)
    cells = ivf.train(v, 3, "l2")
    a = ivf.assign(v, cells, "l2").cache()
    assert sorted(r["count"] for r in a.groupBy("cluster").count().collect()) == [40, 40, 40]
    q = v.filter("id in (0, 50)").select(F.col("id").alias("qid"), "embedding")
    assert {(r.qid, r.id) for r in ivf.search(a, q, cells, 5, 1, "l2").collect()} == {(r.qid, r.id) for r in knn.batch_search(v, q, 5, "l2").collect()}
    same = vectors(spark, [[1, 2]] * 4)
    assert kmeans.train(same, 2).shape == (1, 2, 2)
    assert ivf.cell_stats(ivf.assign(same, ivf.train(same, 2, "l2"), "l2"), ivf.train(same, 2, "l2")).first().n_cells == 2


def test_quantizers(spark):
    rng = np.random.default_rng(3)
    v = vectors(spark, rng.normal(size=(200, 32)))
    for sym in (True, False):
        p = quantize.scalar_params(v, sym)
        assert quantize.error_stats(quantize.scalar_decode(quantize.scalar_encode(v, p, sym), p), 32.0).first().mse < 0.001
    book = quantize.product_train(v, 4, 16, 5).cache()
    codes = quantize.product_encode(v, book).cache()
    q = v.filter("id < 2").select(F.col("id").alias("qid"), "embedding")
    adc = {(r.qid, r.id): r.distance for r in quantize.adc_search(codes, q, book, 200).collect()}
    assert len(adc) == 400 == quantize.adc_search(codes, q, book, 200, most_bytes=1).count()
    tables, code = {r.qid: r.table for r in quantize.adc_table(q, book).collect()}, {r.id: r.code for r in codes.collect()}
    assert all(d == pytest.approx(sum(tables[a][m][c] for m, c in enumerate(code[b])), abs=1e-6) for (a, b), d in adc.items())
    p = quantize.scalar_params(v)
    encoded = quantize.scalar_encode(v, p)
    near = {(r.qid, r.id): r.distance for r in quantize.scalar_search(encoded, q, p, 5).collect()}
    exact = quantize.scalar_decode(encoded, p).select("id", "decoded").crossJoin(q).select("qid", "id", V.euclidean(F.col("decoded"), F.col("embedding"), squared=True).alias("d")).collect()
    for a in (0, 1):
        best = sorted((r.d, r.id) for r in exact if r.qid == a)[:5]
        assert [near[a, i] for _, i in best] == pytest.approx([d for d, _ in best], abs=1e-6)
    back = quantize.product_decode(codes, book).select("id", "decoded").crossJoin(q)
    for r in back.select("qid", "id", V.euclidean(F.col("decoded"), F.col("embedding"), squared=True).alias("d")).collect():
        assert adc[r.qid, r.id] == pytest.approx(r.d, abs=1e-6)
    assert quantize.divisor(30, 8) == 6


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "a"), (2, "dogs chase the cat cat", "b"), (3, "nothing here", "a"), (4, None, "a")], "id int, text string, kind string")
    q = spark.createDataFrame([(0, "cat cat mat"), (1, ""), (2, "unseen")], "qid int, text string")
    index = bm25.build(docs, ["kind"])
    got = bm25.search(index, q, 5).collect()
    assert {r.qid for r in got} == {0} and {r.id for r in got} == {1, 2}
    assert max(r.score for r in got) == 1.0
    only = bm25.search(index, q, 5, query_filter={"kind": "a"}).collect()
    assert [r.id for r in only] == [1] and only[0].raw == pytest.approx(next(r.raw for r in got if r.id == 1))


def test_fusion_and_rerank(spark):
    d = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 2, 0.8)], "qid int, id int, rank bigint, score double")
    s = spark.createDataFrame([(0, 2, 1, 1.0), (0, 3, 2, 0.5)], "qid int, id int, rank bigint, score double")
    got = {r.id: r.score for r in fusion.fuse(d, s, 10).collect()}
    assert got == pytest.approx({1: 0.65 / 61, 2: 0.65 / 62 + 0.35 / 61, 3: 0.35 / 62})
    assert {r.id: r.score for r in fusion.fuse(d, s, 10, "convex").collect()} == pytest.approx({1: 0.585, 2: 0.87, 3: 0.175})
    c = spark.createDataFrame([(0, "red fox", 1, 1, "blue"), (0, "red fox", 2, 2, "a red fox"), (0, "red fox", 3, 3, "fox")], "qid int, query string, id int, rank int, text string")
    ranked = rerank.rerank(c, 3).orderBy("rank").collect()
    assert [r.id for r in ranked] == [2, 3, 1] and ranked[0].rerank_score == pytest.approx(1 / (1 + np.exp(-2.0)))
    broken = rerank.rerank(c, 3, model=lambda q, t: F.lit(float("nan"))).orderBy("rank").collect()
    assert [r.id for r in broken] == [2, 3, 1]
    assert [r.id for r in rerank.rerank(c, 3, min_score=0.5).orderBy("rank").collect()] == [2, 3]


def test_metrics(spark):
    res = spark.createDataFrame([(0, 1, "a"), (0, 2, "a"), (0, 3, "b"), (1, 1, "z")], "qid int, rank int, id string")
    truth = spark.createDataFrame([(0, "b"), (0, "c")], "qid int, id string")
    got = {r.qid: r for r in metrics.per_query(metrics.judged(res, truth)).collect()}
    assert got[0].recall_3 == 0.5 and got[0].precision_3 == pytest.approx(1 / 3) and got[0].rr == 0.5 and got[0].ap == pytest.approx(0.25)
    assert got[1].recall_3 == 1.0 and got[1].ndcg_3 == 1.0 and got[1].rr == 0.0
    assert metrics.summary(metrics.judged(res.limit(0), truth.limit(0))).count() == 0


def test_chunkers(spark):
    docs = spark.createDataFrame([(1, "One. Two is here. Three!  Four? five. Six"), (2, ""), (3, None), (4, "x" * 1200), (5, "   ")], "doc_id int, text string")
    assert [r.text for r in docs.select(F.explode(X.sentences(F.col("text"))).alias("text")).collect()][:4] == ["One.", "Two is here.", "Three!", "Four? five."]
    f = chunk.fixed(docs, 500, 100).filter("doc_id = 4").orderBy("chunk_index").collect()
    assert [(r.char_start, r.char_end) for r in f] == [(0, 500), (400, 900), (800, 1200)]
    assert {r.doc_id for r in chunk.fixed(docs).collect()} == {1, 4}
    s = chunk.by_sentence(docs, 20, 1).filter("doc_id = 1").orderBy("chunk_index").collect()
    assert [r.sentence_count for r in s] == [2, 1, 1, 1] or all(len(r.text) <= 20 for r in s)
    assert chunk.semantic(docs, embed.bag_of_words, least=1, most=30).filter("doc_id = 1").count() >= 2
    assert {r.strategy for r in chunk.compare(docs).collect()} == {"fixed", "sentence", "semantic"}


def test_embed(spark):
    docs = spark.createDataFrame([(1, "a cat"), (2, " a cat "), (3, "dogs"), (4, None)], "id int, text string")
    got = {r.id: r.embedding for r in embed.embed(docs, model=lambda t: embed.stand_in(t, 32)).collect()}
    assert len(got) == 4 and got[1] == got[2] != got[3]
    assert np.allclose(embed.stand_in(["a cat"], 32), embed.stand_in(["a cat"], 32))


def test_answers(spark):
    c = spark.createDataFrame([(0, "what do foxes eat", 1, 10, "Foxes eat many small animals. They sleep in the day. Foxes eat berries in autumn.", 0.9, 0.8), (0, "what do foxes eat", 2, 11, "Short.", 0.5, 0.01), (1, "moon", 1, 12, "tiny", 0.1, None)], "qid int, query string, pos bigint, id int, text string, score double, rerank_score double")
    got = {r.qid: r.answer for r in rag.answers(c).collect()}
    assert "Foxes eat many small animals. [1]" in got[0] and "[2]" not in got[0] and got[1].startswith("Nothing relevant")
    answered = rag.answers(c)
    assert {(r.pos, r.is_cited) for r in rag.citations(c, answered).filter("qid = 0").collect()} == {(1, True), (2, False)}
    assert 0 < rag.grounding(c, answered).filter("qid = 0").first().grounding < 1
    assert rag.prompts(c).count() == 2
    assert rag.generate("p", [("a", lambda p: " "), ("b", lambda p: 1 / 0), ("c", lambda p: 3), ("d", lambda p: "yes")]) == ("d", "yes")
    assert rag.generate("p", []) == (None, None)


def test_cache():
    now = [0.0]
    c = rag.QueryCache(2, 10, lambda: now[0])
    c.put({"q": 1}, "a")
    c.put({"q": 2}, "b")
    assert c.get({"q": 1}) == "a"
    c.put({"q": 3}, "c")
    assert c.get({"q": 2}) is None and c.get({"q": 1}) == "a"
    now[0] = 11
    assert c.get({"q": 1}) is None and c.stats()["hits"] == 2


def test_projection(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, size=(10, 6)) for c in (0, 4, 8)])
    v = vectors(spark, x, ", source string", [("s" * 40 if i < 10 else f"c{i // 10}",) for i in range(30)])
    m = project.fit(v)
    p = project.points(v, m)
    r = p.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.countDistinct("cluster")).first()
    assert max(r[0], r[1]) == pytest.approx(680, abs=0.1) and r[2] == 3 and m.explained[0] > 80
    s = np.linalg.svd(x.astype(np.float32) - x.astype(np.float32).mean(0), compute_uv=False)
    assert m.explained[0] == pytest.approx(100 * s[0] ** 2 / (s**2).sum(), abs=0.1)
    assert project.clusters(p).filter("count = 10").count() == 3
    assert project.fit(v.limit(0)) is None and project.fit(v.limit(1)).explained == [100.0, 0.0]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# The Title\nbody &amp; more\t x")
    (tmp_path / "b.py").write_bytes(b"print('x')\xff\n")
    (tmp_path / "c.exe").write_text("no")
    got = {r.source: r for r in files.load_files(spark, str(tmp_path)).collect()}
    assert got["a.md"].title == "The Title" and got["a.md"].text.endswith("body & more x") and got["b.py"].text == "print('x')" and got["b.py"].file_type == "py"
    assert {r.source for r in files.load_uploads(spark, str(tmp_path)).collect()} == {"a.md", "b.py"}
    assert files.from_text(spark, "hi", "s", {"title": "T"}).first().title == "T"
    with pytest.raises(RuntimeError, match="pypdf"):
        files.load_pdf(spark, str(tmp_path))


@pytest.mark.parametrize("how", [{}, {"select": "nearest"}, {"extend": True}, {"refill": False}])
def test_graph_switches(spark, how):
    x = np.random.default_rng(9).normal(size=(150, 16))
    v = vectors(spark, x)
    g = hnsw.build(v, metric="l2", m=8, m0=16, ef_build=48, seed=3, **how).cache()
    assert g.select(F.max(F.size(F.element_at("links", 1)))).first()[0] <= 16
    q = v.filter("id % 10 = 0").select(F.col("id").alias("qid"), "embedding")
    exact = {(r.qid, r.id) for r in knn.batch_search(v, q, 10, "l2").collect()}
    found = {(r.qid, r.id) for r in hnsw.search(g, q, 10, 64, "l2").collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert {tuple(r) for r in hnsw.edges(hnsw.build(v, metric="l2", m=8, m0=16, ef_build=48, seed=3, **how)).collect()} == {tuple(r) for r in hnsw.edges(g).collect()}


def test_unknown_selection():
    with pytest.raises(ValueError, match="unknown selection"):
        hnsw.Graph(dim=2, select="farthest")


def test_made_up_vectors(spark):
    a = {r.id: tuple(r.embedding) for r in synthetic.clustered(spark, 50, 4, seed=1).collect()}
    b = {r.id: tuple(r.embedding) for r in synthetic.clustered(spark, 50, 4, seed=1).repartition(7).filter("id < 50").collect()}
    assert a == b and len(set(a.values())) == 50
    later = synthetic.clustered(spark, 50, 4, seed=1, first=50).first()
    assert later.id >= 50 and min(np.linalg.norm(np.array(later.embedding) - np.array(x)) for x in a.values()) < 2


def test_batch_search_of_text_ids(spark):
    """Ids of text, ties among them, and more queries than a block has."""
    v = spark.createDataFrame([(f"é{i:03d}" if i % 2 else f"z{i:03d}", [float(i % 5), 1.0]) for i in range(40)], "id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(j, [float(j % 5), 1.0]) for j in range(1100)], "qid int, embedding array<float>")
    got = {}
    for r in knn.batch_search(v, q, 3, "l2").collect():
        got.setdefault(r.qid, []).append((r.rank, r.id))
    ids = {c: sorted(f"é{i:03d}" if i % 2 else f"z{i:03d}" for i in range(40) if i % 5 == c)[:3] for c in range(5)}
    assert len(got) == 1100 and all([i for _, i in sorted(x)] == ids[j % 5] for j, x in got.items())


def test_clean_of_odd_references(spark):
    texts = ["a &amp; b &#65;&#x42;", "&#" + "9" * 5000 + "; x", "&#" + "0" * 5000 + "65; y", "&#x" + "f" * 9 + ";", "&nosuch; &", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(1).orderBy("i").select(X.clean(F.col("text"))).collect()]
    assert got == ["a & b AB", "\ufffd x", "A y", "\ufffd", "&nosuch; &", ""]
