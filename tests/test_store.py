import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import embed
from quernstone.session import Engine
from quernstone.sources import corpus
from quernstone.sources.store import InvalidVectors, Store
from quernstone.streaming import ingest


def model(texts):
    return embed.bag_of_words(texts, 48)


def rows(spark, *r):
    return spark.createDataFrame([(i, [float(x) for x in v], t) for i, v, t in r], "id string, embedding array<float>, tag string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s")).create(2, "cosine", "flat")


def test_writes(spark, store):
    assert store.read() is None
    store.upsert(rows(spark, ("a", (1, 0), "x"), ("b", (0, 1), "y")))
    store.upsert(rows(spark, ("a", (1, 1), "z")))
    assert {(r.id, r.tag) for r in store.read().collect()} == {("a", "z"), ("b", "y")}
    assert store.delete(spark.createDataFrame([("b",), ("none",)], "id string")) == 1
    assert store.delete(spark.createDataFrame([("b",)], "id string")) == 0
    assert [r.id for r in store.read().collect()] == ["a"]
    store.upsert(rows(spark, ("b", (0, 1), "again")))
    before = store.read()
    store.compact()
    assert store.config()["writes"] == [] and store.read().count() == 2 and before.count() == 2
    assert store.get("b").first().tag == "again"
    store.journal("note", {"n": 1})
    assert Store(spark, store.folder).read().count() == 2


@pytest.mark.parametrize("bad", [[("a", (1, 0, 0), "x")], [("a", (float("nan"), 0), "x")], [("a", (0, 0), "x")], [("a", (1, 0), "x"), ("a", (0, 1), "x")], [(None, (1, 0), "x")]])
def test_bad_rows_change_nothing(spark, store, bad):
    store.upsert(rows(spark, ("k", (1, 0), "x")))
    with pytest.raises(InvalidVectors):
        store.upsert(rows(spark, *bad))
    assert [r.id for r in store.read().collect()] == ["k"]


def test_engine(spark, tmp_path):
    store = Store(spark, str(tmp_path / "e")).create(48, "cosine", "flat")
    e = Engine(store, model)
    docs = spark.createDataFrame([("fox", "Foxes eat small animals and berries. They live in dens."), ("moon", "The moon circles the earth. It has no air at all."), ("bread", "Bread is made of flour and water. Yeast makes it rise.")], "doc_id string, text string")
    e.ingest(docs, "sentence", size=60, overlap=0)
    n = e.rows().count()
    e.ingest(docs, "sentence", size=60, overlap=0)
    assert e.rows().count() == n
    q = spark.createDataFrame([(0, "what do foxes eat"), (1, "what is bread made of")], "qid int, text string")
    truth = spark.createDataFrame([(0, "fox"), (1, "bread")], "qid int, id string")
    for index in ("flat", "ivf", "hnsw"):
        e.switch_index(index, **({"nlist": 2, "nprobe": 2} if index == "ivf" else {}))
        top = {r.qid: r.source for r in e.hybrid(q, 1).collect()}
        assert top == {0: "fox", 1: "bread"}, index
    assert {r.source for r in e.hybrid(q, 5, query_filter={"source": "moon"}).collect()} == {"moon"}
    assert e.evaluate(q, truth).first().recall_10 == 1.0
    out = e.ask(q, top_k=3)
    assert {r.qid for r in out["answers"].collect()} == {0, 1} and out["citations"].count() > 0 and out["grounding"].count() == 2
    first = e.ask_one("what do foxes eat", top_k=2)
    assert e.ask_one("what do foxes eat", top_k=2) is first and e.cache_stats()["hits"] == 1
    assert e.quantize("scalar").first().ratio == pytest.approx(4.0) and e.quantize("product", 8, 4).first().n == n
    with pytest.raises(ValueError, match="divide"):
        e.quantize("product", 7)
    assert e.project()[0].count() == n and e.project_query(model(["fox"])[0].tolist(), 3)["neighbours"].count() == 3
    assert e.hnsw_trace(model(["fox"])[0].tolist()).count() > 0 and e.hnsw_topology().columns == ["shard", "layer", "a", "b"]
    assert e.stats()["count"] == n
    assert e.delete(e.rows().filter("source = 'moon'").select("id")) > 0
    e.compact()
    assert e.rows().filter("source = 'moon'").isEmpty()


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st")).create(48, "cosine", "flat")
    src = tmp_path / "in"
    spark.createDataFrame([("a", "One thing. Another thing."), ("b", "A third thing here.")], "doc_id string, text string").write.json(str(src))
    stream = spark.readStream.schema("doc_id string, text string").json(str(src))
    for _ in range(2):  # the second run finds nothing new
        ingest.start(stream, store, str(tmp_path / "cp"), model=model).awaitTermination()
    assert sorted(store.read().select(F.collect_set("source")).first()[0]) == ["a", "b"] and store.read().count() == 2
    assert np.isfinite(store.read().first().embedding).all()


def test_concurrent_writes(spark, store, tmp_path):
    """Of two writers that start from one manifest both get in, and so does a write that comes in while rows are compacted."""
    other = Store(spark, store.folder)
    store.upsert(rows(spark, ("a", (1, 0), "x")))
    version = other._version()
    other._version = iter([version - 1, version, version, version + 1, version + 1]).__next__  # as if it had looked before
    other._append(rows(spark, ("b", (0, 1), "y")), 1)
    assert {r.id for r in store.read().collect()} == {"a", "b"}
    late, write = Store(spark, store.folder), store._write

    def meanwhile(r, by=None):
        name = write(r, by)
        late.upsert(rows(spark, ("c", (1, 1), "z")))
        return name

    store._write = meanwhile
    store.compact()
    assert {r.id for r in late.read().collect()} == {"a", "b", "c"} and len(late.config()["writes"]) == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, store):
    """Below the join with later writes, too."""
    store.upsert(rows(spark, ("a", (1, 0), "x"), ("b", (0, 1), "y")))
    assert "EqualTo(tag,x)" in plan(store.read().filter("tag = 'x'"))
    store.upsert(rows(spark, ("b", (1, 1), "x")))
    found = store.read().filter("tag = 'x'")
    assert "EqualTo(tag,x)" in plan(found) and {r.id for r in found.collect()} == {"a", "b"}
    assert store.read().filter("tag = 'y'").isEmpty()


def test_replaced_vectors(spark, store):
    store.upsert(rows(spark, ("a", (1, 0), "x"), ("b", (0, 1), "y")))
    assert store.replace_vectors(spark.createDataFrame([("a", [0.0, 2.0]), ("none", [1.0, 1.0])], "id string, embedding array<float>")) == 1
    assert {(r.id, tuple(r.embedding), r.tag) for r in store.read().collect()} == {("a", (0.0, 2.0), "x"), ("b", (0.0, 1.0), "y")}


def test_older_snapshot(spark, store, tmp_path):
    old = tmp_path / "old"
    old.mkdir()
    np.save(old / "vectors.npy", np.array([[1, 0], [0, 1], [1, 1], [2, 1]], np.float32))
    np.save(old / "deleted.npy", np.array([False, True, False, False]))
    (old / "config.json").write_text("{}")
    lines = [{"id": "a", "metadata": {"tag": "x", "n": 1}}, {"id": "b", "metadata": {"tag": "y"}}, {"id": "c", "metadata": {}}, {"id": "a", "metadata": {"tag": "z", "n": 2}}]
    (old / "metadata.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    assert store.import_snapshot(str(old)) == 2
    assert {(r.id, tuple(r.embedding), r.tag, r.n) for r in store.read().collect()} == {("a", (2.0, 1.0), "z", 2), ("c", (1.0, 1.0), None, None)}


def test_large_snapshot_in_ranges(spark, store, tmp_path, monkeypatch):
    """Lines without a metadata entry, nested and mixed values, blank lines, and files that many tasks read."""
    n = 3000
    x = np.random.default_rng(1).normal(size=(n, 2)).astype(np.float32)
    np.save(tmp_path / "vectors.npy", x)
    np.save(tmp_path / "deleted.npy", np.arange(n) % 5 == 0)
    lines = [{"id": i, "tag": f"t{i}"} if i % 2 else {"id": i, "metadata": {"tag": f"m{i}", "list": [i], "any": i if i % 4 else "x"}} for i in range(n)]
    (tmp_path / "metadata.jsonl").write_text("\n".join(json.dumps(v) + "\n" * (i % 3 == 0) for i, v in enumerate(lines)))
    monkeypatch.setattr("quernstone.sources.vectors.PART_BYTES", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert store.import_snapshot(str(tmp_path)) == n - n // 5
        got = {r.id: r for r in store.read().collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got.keys() == {i for i in range(n) if i % 5}
    for i, r in got.items():
        assert tuple(r.embedding) == tuple(x[i].tolist()) and r.tag == (f"t{i}" if i % 2 else f"m{i}")
        assert r.list == (None if i % 2 else f"[{i}]") and r.any == (None if i % 2 else str(i) if i % 4 else "x")
    np.save(tmp_path / "deleted.npy", np.zeros(n - 1, bool))
    with pytest.raises(InvalidVectors, match="2999 marks"):
        store.import_snapshot(str(tmp_path))


def test_a_batch_is_written_once(spark, store, tmp_path):
    a, b = rows(spark, ("a", (1, 0), "x")), rows(spark, ("a", (1, 1), "y"))
    assert store.upsert(a, ("app", 0)) == 1 and store.upsert(b, ("app", 0)) == 0 and store.upsert(b, ("other", 0)) == 1
    folders = lambda: len(list((tmp_path / "s" / "rows").iterdir()))
    n = folders()
    assert store.upsert(a, ("app", 0)) == 0 and folders() == n
    late, write = Store(spark, store.folder), store._write

    def meanwhile(r, by=None):  # the same batch is committed by a second driver between look and commit
        store._write = write
        assert late.upsert(a, ("app", 1)) == 1
        return write(r, by)

    store._write = meanwhile
    assert store.upsert(b, ("app", 1)) == 0 and folders() == n + 1 and store.config()["batches"] == {"app": 1, "other": 0}
    store.compact()
    assert store.upsert(b, ("app", 1)) == 0 and store.get("a").first().tag == "x"


def test_cells_are_pruned_and_never_move(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(300, 8))
    table = lambda ids, m: spark.createDataFrame([(i, m[j].tolist(), "t") for j, i in enumerate(ids)], "id int, embedding array<float>, tag string")
    e = Engine(Store(spark, str(tmp_path / "c")).create(8, "l2", "ivf", nlist=6, nprobe=6))
    e.upsert(table(range(300), x))
    q = table([0, 1], x).select(F.col("id").alias("qid"), "embedding")
    exact = lambda m: {(a, int(b)) for a in (0, 1) for b in np.argsort(((m - x[a]) ** 2).sum(1))[:5]}
    got = e.dense(q, 5)
    assert {(r.qid, r.id) for r in got.collect()} == exact(x)
    assert "PartitionFilters: [cluster" in plan(got)
    one = e.dense(q.filter("qid = 0"), 5, nprobe=1)
    assert "PartitionFilters: [isnotnull(cluster" in plan(one) and one.count() == 5
    cells = sorted(r.centroid for r in e.store.kept("ivf")["cells"].collect())
    y = np.concatenate((x, x[:2] + 0.001))
    e.upsert(table([300, 301], y[300:]))
    assert {(r.qid, r.id) for r in e.dense(q, 5).collect()} == exact(y) and sorted(r.centroid for r in e.store.kept("ivf")["cells"].collect()) == cells
    e.compact()
    assert {(r.qid, r.id) for r in e.dense(q, 5).collect()} == exact(y)


def test_graph_with_later_writes(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(200, 8))
    table = lambda ids, m: spark.createDataFrame([(i, m[j].tolist(), "t") for j, i in enumerate(ids)], "id int, embedding array<float>, tag string")
    e = Engine(Store(spark, str(tmp_path / "g")).create(8, "l2", "hnsw", ef_search=200))
    e.upsert(table(range(200), x))
    q = table([7], x[7:8]).select(F.col("id").alias("qid"), "embedding")
    assert e.dense(q, 1).first().id == 7
    e.upsert(table([7, 200], np.stack((x[8], x[7] + 0.01))))
    e.delete(spark.createDataFrame([(8,)], "id int"))
    top = [r.id for r in e.dense(q, 200).orderBy("rank").collect()]
    assert top[0] == 200 and 8 not in top and top.count(7) == 1 and len(top) == 200
    found, steps = e.dense_with_trace(x[7].tolist(), 3)
    assert found.count() == 3 and steps.count() > 0
    e.switch_index("flat")
    found, steps = e.dense_with_trace(x[7].tolist(), 3)
    assert found.count() == 3 and steps.count() == 0


def test_strategies(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path / "i")).create(48, "cosine", "flat"), model)
    docs = spark.createDataFrame([(None, "from a title", "One thing is here. Another thing is there.", 7), ("", None, "Neither id nor title. But text.", None)], "doc_id string, title string, text string, year int")
    for strategy in ("semantic", "fixed"):
        assert e.ingest(docs, strategy, size=200) == 2
    assert {r.source for r in e.rows().collect()} == {"from a title", "doc"} and {r.year for r in e.rows().collect()} == {7, None}
    with pytest.raises(ValueError, match="unknown strategy"):
        e.ingest(docs, "by chance")


def test_files(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.md").write_text("# Foxes\nFoxes live in dens.")
    (d / "b.txt").write_text("The moon has no air.")
    (d / "c.exe").write_text("not this one")
    e = Engine(Store(spark, str(tmp_path / "f")).create(48, "cosine", "flat"), model)
    assert e.ingest_files(str(d)) == 2
    assert {(r.source, r.title, r.file_type) for r in e.rows().collect()} == {("a.md", "Foxes", "markdown"), ("b.txt", "b.txt", "txt")}
    (d / "x.pdf").write_bytes(b"%PDF-1.4")
    with pytest.raises(RuntimeError, match="pypdf"):
        e.ingest_files(str(d))


def test_seed_generators_and_benchmark(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path / "q")).create(48, "cosine", "flat"), model)
    assert e.seed() >= 20
    q = corpus.questions(spark).select("qid", "text")
    assert e.evaluate(q, corpus.truth(spark)).first().recall_10 >= 0.9
    some = q.filter("qid < 3")

    def moody(prompt):
        if "bees" in prompt.split("Question:")[1]:
            raise OSError("down")
        return " " if "owls" in prompt.split("Question:")[1] else "Told so [1]."

    out = e.ask(some, [("first", moody), ("second", lambda p: "By dance [1]." if "bees" in p.split("Question:")[1] else None)])
    got = {r.qid: (r.provider, r.answer) for r in out["answers"].collect()}
    assert got[0] == ("second", "By dance [1].") and got[1][0] == "extractive" and got[2] == ("first", "Told so [1].")
    assert out["citations"].filter("qid = 2 and is_cited").count() == 1
    runs = {r["name"]: r for r in e.benchmark(300, 10, 5, nlist=4, probes=(1, 4), efs=(64,))}
    assert runs["exact"]["recall_k"] == 1.0 == runs["ivf nprobe=4"]["recall_k"] and runs["hnsw ef=64"]["recall_k"] >= 0.9 and all(r["qps"] > 0 for r in runs.values())
