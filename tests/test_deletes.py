"""Deletes as bitmaps of places in files."""

import pytest
from pyspark.sql import functions as F

from quernstone.session import Engine
from quernstone.sources import store as S
from quernstone.sources.store import Store


def made(spark, folder, n=1000, index="flat", **params):
    s = Store(spark, str(folder)).create(2, "l2", index, **params)
    s.upsert(rows(spark, 0, n))
    return s


def rows(spark, a, b, tag="first"):
    return spark.range(a, b).repartition(3).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit(tag).alias("tag"), F.concat(F.lit("word"), (F.col("id") % 10).cast("string"), F.lit(" common")).alias("text"))


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


def left(s):
    return {r.id: r.tag for r in s.read().select("id", "tag").collect()}


def test_only_bitmaps_are_written(spark, tmp_path):
    s = made(spark, tmp_path)
    before = {x["name"] for x in [s.config()["base"], *s.config()["writes"]]}
    assert s.delete(ids(spark, 3, 4, 999, 5000)) == 3 and s.delete(ids(spark, 3, 5)) == 1 and s.delete(ids(spark, 3)) == 0
    c = s.config()
    assert {x["name"] for x in [c["base"], *c["writes"]]} == before and c["gone"]["rows"] == 4
    table = spark.read.parquet(f"{s.folder}/{c['gone']['name']}")
    assert table.columns == ["file", "page", "words"] and table.count() <= 3
    assert left(s).keys() == set(range(1000)) - {3, 4, 5, 999}


def test_no_anti_join_and_filters_at_the_scan(spark, tmp_path):
    s = made(spark, tmp_path)
    s.delete(ids(spark, 1, 2))
    plan = s.read().filter("tag = 'first'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "BroadcastHashJoin" in plan and "EqualTo(tag,first)" in plan
    assert "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_a_deleted_row_hides_older_ones_and_can_come_again(spark, tmp_path):
    s = made(spark, tmp_path, 10)
    s.upsert(rows(spark, 2, 5, "second"))
    s.upsert(rows(spark, 3, 4, "third"))
    assert s.delete(ids(spark, 2, 3, 7)) == 3
    assert left(s) == {i: "second" if i == 4 else "first" for i in range(10) if i not in (2, 3, 7)}
    s.upsert(rows(spark, 3, 4, "again"))
    want = left(s)
    assert want[3] == "again" and 2 not in want
    s.compact()
    assert left(s) == want and s.config()["gone"] is None and not s.config()["writes"]
    assert s.delete(ids(spark, 3)) == 1 and 3 not in left(s)


@pytest.mark.parametrize("page", [1, 64, 128])
def test_pages(spark, tmp_path, monkeypatch, page):
    monkeypatch.setattr(S, "PAGE", max(64, page))
    monkeypatch.setattr(S, "PAGES", 0 if page == 1 else 8000)  # joined by a shuffle
    s = made(spark, tmp_path, 700)
    gone = [i for i in range(700) if i % 7 == 0 or 300 < i < 420]
    assert s.delete(ids(spark, *gone[::2])) + s.delete(ids(spark, *gone)) == len(gone)
    assert left(s).keys() == set(range(700)) - set(gone)


def test_who_comes_second_tries_again(spark, tmp_path):
    s, other = made(spark, tmp_path, 50), Store(spark, str(tmp_path))
    write, done = s._write, []

    def meanwhile(r, by=None):
        name = write(r, by)
        if not done:
            done.append(other.delete(ids(spark, 1, 9)))
            other.compact()
            other.upsert(rows(spark, 60, 61))
        return name

    s._write = meanwhile
    assert s.delete(ids(spark, 1, 2)) == 1 and done == [2]
    assert left(s).keys() == set(range(50)) - {1, 2, 9} | {60}


@pytest.mark.parametrize("index", ["flat", "ivf", "hnsw"])
def test_kept_tables_learn_of_deletes(spark, tmp_path, index):
    """Cells, graph and lexical index are made once; deletes, writes and both are seen on top of them."""
    e = Engine(made(spark, tmp_path, 60, index, **({"nlist": 3, "nprobe": 3} if index == "ivf" else {})))
    asked = spark.createDataFrame([(0, [20.0, 1.0], "word7 common")], "qid int, embedding array<double>, text string")
    near = lambda: {r.id for r in e.dense(asked, 5).collect()}
    words = lambda: {r.id for r in e.bm25(asked, 100).collect() if r["rank"] <= 3}
    assert near() == {18, 19, 20, 21, 22} and words() == {7, 17, 27}
    tables = e.store.config()["tables"].keys()
    e.delete(ids(spark, 20, 21, 17))
    assert near() == {16, 18, 19, 22, 23} and words() == {7, 27, 37}
    e.upsert(rows(spark, 20, 21))
    assert near() == {18, 19, 20, 22, 23}
    e.delete(ids(spark, 20, 7))
    assert near() == {16, 18, 19, 22, 23} and words() == {27, 37, 47} and e.store.config()["tables"].keys() == tables
    e.compact()
    assert near() == {16, 18, 19, 22, 23} and words() == {27, 37, 47}
