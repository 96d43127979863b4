import pytest

from quernstone.queries import QUERIES, SQL

from .oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    compare(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_recall(spark, data):
    for r in QUERIES["ann_recall"](spark, data).collect():
        assert r.recall_10 >= 0.9, r
    assert QUERIES["recall_given_cells"](spark, data).first().recall_k >= 0.9


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
