"""Vector files, read by any split of them."""

import numpy as np
import pytest

from quernstone.operators import knn, sweep
from quernstone.sources import vectors

RNG = np.random.default_rng(3)


def fvecs(path, x):
    np.hstack((np.full((len(x), 1), x.shape[1], "<i4").view("<f4"), x.astype("<f4"))).tofile(path)


def values(df):
    rows = sorted(df.collect(), key=lambda r: (r.file, r.pos))
    return [r.pos for r in rows], np.array([r.embedding for r in rows], np.float32)


@pytest.mark.parametrize("part", [1, 37, 100, 1 << 20])
@pytest.mark.parametrize("kind", ["fvecs", "f4", "f8", "i2", "bool"])
def test_any_split(spark, tmp_path, part, kind):
    x = (RNG.standard_normal((57, 5)) * 9).astype({"fvecs": "f4", "bool": bool}.get(kind, kind))
    path = str(tmp_path / ("a.fvecs" if kind == "fvecs" else "a.npy"))
    fvecs(path, x) if kind == "fvecs" else np.save(path, x)
    df = vectors.load(spark, path, part)
    assert df.rdd.getNumPartitions() == -(-57 // max(1, part // vectors.layout(path).row))
    pos, got = values(df)
    assert pos == list(range(57)) and np.array_equal(got, x.astype(np.float32))


def test_pushed_filters(spark, tmp_path, monkeypatch):
    x = RNG.standard_normal((1000, 4)).astype(np.float32)
    fvecs(tmp_path / "a.fvecs", x)
    df = vectors.load(spark, f"file://{tmp_path}/a.fvecs", 400)
    for condition, want in (("pos >= 990", range(990, 1000)), ("pos > 5 and pos <= 8", range(6, 9)), ("pos in (3, 700, 5000)", (3, 700)), ("pos = 20", (20,)), ("pos < 0", ()), ("pos >= 2000", ()), ("pos = 7 and file = 'a.fvecs'", (7,)), ("pos = 7 and file = 'b'", ())):
        some = df.filter(condition)
        pos, got = values(some)
        assert pos == list(want) and np.array_equal(got.reshape(-1, 4), x[list(want)]), condition
        assert some.rdd.getNumPartitions() <= 3, condition  # of 50


def test_many_files_and_faults(spark, tmp_path):
    np.save(tmp_path / "b.npy", np.ones((3, 2)))
    np.save(tmp_path / "c.npy", np.arange(4))
    fvecs(tmp_path / "a.fvecs", np.zeros((2, 2)))
    (tmp_path / "empty.fvecs").write_bytes(b"")
    (tmp_path / "note.txt").write_text("x")
    assert sorted((r.file, r["count"]) for r in vectors.load(spark, str(tmp_path)).groupBy("file").count().collect()) == [("a.fvecs", 2), ("b.npy", 3), ("c.npy", 4)]
    assert vectors.load(spark, f"{tmp_path}/*.npy").count() == 7
    np.save(tmp_path / "wide.npy", np.asfortranarray(np.ones((3, 2))))
    (tmp_path / "short.fvecs").write_bytes(b"\x02\0\0\0abc")
    for bad in ("wide.npy", "short.fvecs", "note.txt", "none.npy"):
        with pytest.raises(Exception, match=r"row by row|does not hold|neither|none.npy"):
            vectors.load(spark, str(tmp_path / bad)).collect()


def test_sweep_over_a_file(spark, tmp_path):
    """Recall of searches over vectors of a file, as over those of a table."""
    x = RNG.standard_normal((400, 8)).astype(np.float32)
    fvecs(tmp_path / "base.fvecs", x)
    np.save(tmp_path / "query.npy", x[:20] + 0.01)
    base = vectors.load(spark, str(tmp_path / "base.fvecs"), 1000).withColumnRenamed("pos", "id").select("id", "embedding")
    asked = vectors.load(spark, str(tmp_path / "query.npy")).withColumnRenamed("pos", "qid").select("qid", "embedding")
    exact = knn.batch_search(base, asked, 5, "l2").persist()
    assert {r.qid: r.id for r in exact.filter("rank = 1").collect()} == {i: i for i in range(20)}
    out = sweep.measure({"exact": lambda: knn.batch_search(base, asked, 5, "l2")}, exact, 20, 5)
    assert out[0]["recall_k"] == 1.0
