"""Filters over metadata of mixed types in a VARIANT column, against the language's meaning in plain Python."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.plans.filters import compile_filter
from quernstone.session import Engine
from quernstone.sources.store import Store

from .test_filters import OPS, holds

VALUES = [1, 2, 1.5, 2.0, -3, 10**18 + 1, 1e300, True, False, "x", "1", "", "true", None, [1, 2], [], {"z": 1}, ["x", None]]
ROWS = [{"a": v, "b": VALUES[(7 * i + 3) % len(VALUES)], "it's": i % 3} for i, v in enumerate(VALUES)]
ROWS += [{"a": v} for v in (1, "x", None)] + [{"b": "x"}, {"a.b": 1}, {"it's \"q\"": 2, "a": 1}, {}, None]

scalars = st.sampled_from([v for v in VALUES if not isinstance(v, list | dict)] + [0, 3, 1.25, 10**18, 10**25, "y"])
nested = st.sampled_from([[1, 2], [], {"z": 1}, ["x", None], [2]])
checks = st.one_of(
    scalars,
    st.dictionaries(st.sampled_from(sorted(OPS)), scalars, min_size=1, max_size=2),
    st.fixed_dictionaries({"$eq": nested}),
    st.fixed_dictionaries({"$ne": nested}),
    st.fixed_dictionaries({"$in": st.lists(st.one_of(scalars, nested), max_size=3)}),
    st.fixed_dictionaries({"$nin": st.lists(st.one_of(scalars, nested), max_size=3)}),
)
leaves = st.dictionaries(st.sampled_from(["a", "b", "a.b", "it's", "it's \"q\"", "missing"]), checks, min_size=1, max_size=2)
filters = st.recursive(leaves, lambda c: st.one_of(st.builds(lambda x: {"$not": x}, c), st.builds(lambda x: {"$and": x}, st.lists(c, min_size=1, max_size=2)), st.builds(lambda x: {"$or": x}, st.lists(c, min_size=1, max_size=2))), max_leaves=4)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("variant") / "t")
    rows = [(i, None if r is None else json.dumps(r)) for i, r in enumerate(ROWS)]
    spark.createDataFrame(rows, "id int, text string").select("id", F.parse_json("text").alias("metadata")).write.parquet(path)
    return spark.read.parquet(path)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(f=filters)
def test_mixed_types(table, f):
    got = {r.id for r in table.filter(compile_filter(f, table.schema)).collect()}
    assert got == {i for i, row in enumerate(ROWS) if row and holds(f, row)}


def test_a_type_error_is_the_rows_own(table):
    """One field, compared with a number, a text and a boolean."""
    got = lambda f: {i for i in (r.id for r in table.filter(compile_filter(f, table.schema)).collect()) if i < len(VALUES)}
    assert got({"a": {"$lt": 2}}) == {i for i, v in enumerate(VALUES) if isinstance(v, int | float) and v < 2}
    assert got({"a": {"$lt": "2"}}) == {i for i, v in enumerate(VALUES) if isinstance(v, str) and v < "2"}
    assert got({"a": 1}) == {i for i, v in enumerate(VALUES) if v == 1 and v is not None}
    assert got({"a": {"$ne": "x"}}) == {i for i, v in enumerate(VALUES) if v is not None and v != "x"}
    assert got({"$not": {"a": {"$gt": 0}}}) == {i for i, v in enumerate(VALUES) if not (isinstance(v, int | float) and v > 0)}


def test_only_asked_entries_are_read(table):
    plan = table.filter(compile_filter({"a": {"$gt": 1}}, table.schema)).select("id")._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "bigint" in schema and "double" in schema, plan


def test_own_columns_come_first(spark):
    t = spark.createDataFrame([(1, 5, '{"n": "text", "m": 1}'), (2, None, '{"n": 5, "m": 1}')], "id int, n int, j string").select("id", "n", F.parse_json("j").alias("metadata"))
    assert [r.id for r in t.filter(compile_filter({"n": 5, "m": 1}, t.schema)).collect()] == [1]


def test_engine(spark, tmp_path):
    """Free-form metadata through writes, deletion, compaction and all searches."""
    e = Engine(Store(spark, str(tmp_path)).create(dim=3, metric="l2", index="flat"))
    meta = [{"year": 2020, "tags": ["a"]}, {"year": "2020"}, {"year": 2021.5}, {}, {"other": None}, {"year": True}]
    rows = lambda ids: spark.createDataFrame([(i, [float(i), 1.0, 0.0], f"word{i} common", json.dumps(meta[i])) for i in ids], "id int, embedding array<double>, text string, j string").select("id", "embedding", "text", F.parse_json("j").alias("metadata"))
    e.upsert(rows([0, 1, 2, 3]))
    e.upsert(rows([4, 5, 2]))
    asked = spark.createDataFrame([(0, "common", [0.0, 1.0, 0.0])], "qid int, text string, embedding array<double>")
    ids = lambda df: {r.id for r in df.collect()}
    recent = {"year": {"$gte": 2000}}
    for _ in range(2):
        assert ids(e.dense(asked, 10, recent)) == {0, 2} and ids(e.bm25(asked, 10, recent)) == {0, 2} and ids(e.hybrid(asked, 10, query_filter=recent)) == {0, 2}
        assert ids(e.dense(asked, 10, {"$not": recent})) == {1, 3, 4, 5} and ids(e.dense(asked, 10, {"tags": ["a"]})) == {0}
        e.compact()
    assert e.delete(spark.createDataFrame([(0,)], "id int")) == 1
    assert ids(e.dense(asked, 10, recent)) == {2}
