import operator

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quernstone.plans.filters import InvalidFilter, compile_filter

ROWS = [(i, a, b) for i, (a, b) in enumerate([(1, "x"), (2, None), (None, "y"), (3, "z"), (None, None), (2, "x"), (-1, "")])]
OPS = {"$eq": operator.eq, "$ne": operator.ne, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def holds(e, row):
    """What the language means, in plain Python."""

    def field(value, checks):
        if value is None:
            return False
        for op, target in checks.items():
            try:
                ok = value in target if op == "$in" else value not in target if op == "$nin" else OPS[op](value, target)
            except TypeError:
                ok = False
            if not ok:
                return False
        return True

    out = []
    for k, c in e.items():
        if k in ("$and", "$or"):
            out.append((all if k == "$and" else any)([holds(x, row) for x in c]))
        elif k == "$not":
            out.append(not holds(c, row))
        else:
            out.append(field(row.get(k), c if isinstance(c, dict) else {"$eq": c}))
    return all(out)


values = st.one_of(st.integers(-1, 4), st.sampled_from(["x", "y", ""]))
checks = st.one_of(values, st.dictionaries(st.sampled_from(sorted(OPS)), values, min_size=1, max_size=2), st.fixed_dictionaries({"$in": st.lists(values, max_size=3)}), st.fixed_dictionaries({"$nin": st.lists(values, max_size=3)}))
leaves = st.dictionaries(st.sampled_from(["a", "b", "missing"]), checks, min_size=1, max_size=2)
filters = st.recursive(leaves, lambda c: st.one_of(st.builds(lambda x: {"$not": x}, c), st.builds(lambda x: {"$and": x}, st.lists(c, min_size=1, max_size=2)), st.builds(lambda x: {"$or": x}, st.lists(c, min_size=1, max_size=2))), max_leaves=5)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, a int, b string").cache()


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(f=filters)
def test_two_valued(table, f):
    got = {r.id for r in table.filter(compile_filter(f, table.schema)).collect()}
    assert got == {i for i, a, b in ROWS if (a, b) != (None, None) and holds(f, {"a": a, "b": b})}  # no metadata passes nothing


def test_nan(spark):
    t = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id int, x double")
    for f, want in (({"x": {"$gt": 0}}, {2}), ({"x": {"$ne": 5.0}}, {1, 2}), ({"$not": {"x": {"$gt": 0}}}, {1})):
        assert {r.id for r in t.filter(compile_filter(f, t.schema)).collect()} == want


@pytest.mark.parametrize("bad", [{"$xor": []}, {"a": {}}, {"a": {"$near": 1}}, {"$and": []}, {"a": {"$in": 3}}, {"$not": {}}, {"$or": [3]}])
def test_errors(table, bad):
    with pytest.raises(InvalidFilter):
        compile_filter(bad, table.schema)


def test_nothing_to_filter(table):
    assert compile_filter(None, table.schema) is None and compile_filter({}, table.schema) is None


def test_pushed_to_the_scan(spark, data):
    t = spark.read.parquet(f"{data}/part.parquet")
    for f in ({"p_size": {"$gt": 10}}, {"$not": {"p_size": {"$gt": 10}}}):
        plan = t.filter(compile_filter(f, t.schema))._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: []" not in plan and "p_size" in plan.split("PushedFilters")[1]
