"""What an executor holds beside the operators' own work: one pool of Python workers, and in them no ids that nobody asked for."""

import numpy as np
import pyarrow as pa

from quernstone.llm import common, packing, pii, tokens


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_given_rows_need_no_python_worker(spark):
    rows = [(1, None, "a"), (2, True, None)]
    df = common.given(spark, rows, "x bigint, y boolean, z string")
    assert [tuple(r) for r in df.orderBy("x").collect()] == rows and df.dtypes == [("x", "bigint"), ("y", "boolean"), ("z", "string")]
    assert "ExistingRDD" not in plan(df)
    none = common.given(spark, [], "x bigint")
    assert none.collect() == [] and none.dtypes == [("x", "bigint")]


def test_operators_start_no_second_pool(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "'call 555-123-4567' AS text", "id + 1 AS n_tokens")
    for df, first in ((pii.pseudonymise(docs, "a secret of some length"), "key"), (packing.pack(docs), "bucket")):
        assert len(df.collect()) == 3 and f"LocalTableScan [{first}#" in plan(df)


def test_counts_without_ids(texts):
    some = [x or "" for x in texts.values()]
    full, counts = tokens.Encoder(), tokens.Encoder(ids=False)
    for _ in range(2):  # learnt, then remembered
        assert counts.count(some).tolist() == full(some)[1].tolist()
        assert counts.count(pa.array(some)).tolist() == full(some)[1].tolist()
    assert counts.pool is None and full.pool.n > 0
    few = tokens.Encoder(most=20, ids=False)
    assert np.concatenate([few.count(some[i : i + 3]) for i in range(0, len(some), 3)]).tolist() == full(some)[1].tolist()
    assert counts.count([]).tolist() == [] and counts.count([""]).tolist() == [0]
