"""Work that one task would have alone is dealt out, and texts that are not found are not shuffled."""

import numpy as np
from pyspark.sql import functions as F

from quernstone import queries
from quernstone.operators import bm25, hnsw


def test_shards_are_small_and_lie_in_several_tasks(spark):
    assert hnsw.shard_count(spark.range(10_256)) == 2 and hnsw.shard_count(spark.range(102_564)) == 13
    x = np.random.default_rng(2).normal(size=(160, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, embedding array<double>")
    built = hnsw.build(v, 8, metric="l2", m=4).withColumn("task", F.spark_partition_id())
    at = {(r.shard, r.task) for r in built.collect()}
    assert len({s for s, _ in at}) == len(at) == 8 and len({t for _, t in at}) >= 4
    assert built.count() == 160


def test_only_found_texts_leave_the_scan(spark, data):
    got = queries.QUERIES["rerank_lexical"](spark, data)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin [id" not in plan
    found = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (2, 9, "c")], "qid bigint, id bigint, x string")
    docs = spark.createDataFrame([(5, "five"), (6, "six")], "id bigint, text string")
    want = {(5, "five", 1, "a"), (5, "five", 2, "b")}
    assert {tuple(r) for r in bm25.with_texts(found, docs, 3).collect()} == {tuple(r) for r in bm25.with_texts(found, docs, 1 << 40).collect()} == want


def test_every_shard_is_a_task_of_its_own(spark):
    vectors = spark.range(400).selectExpr("id", "array(float(id % 7), float(id % 5), 1.0f) AS embedding")
    graph = hnsw.build(vectors, shards=13, seed=7)
    assert graph._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # and none is dealt out again
    places = graph.select("shard", F.spark_partition_id().alias("at")).distinct().collect()
    assert len(places) == len({r.shard for r in places}) == len({r["at"] for r in places}) == 13
