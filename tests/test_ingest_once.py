from pyspark.sql import functions as F

from quernstone.operators import embed
from quernstone.sources.store import Store
from quernstone.streaming.ingest import chunk_rows


def test_chunks_are_shuffled_and_computed_once(spark, tmp_path):
    docs = spark.range(40).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("some words "), F.col("id") % 20).alias("text"))
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return embed.bag_of_words(texts)

    rows = chunk_rows(docs, model, "fixed", 500, 0)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    store = Store(spark, str(tmp_path / "s")).create(64, index="flat")
    assert store.upsert(rows) == 20 and store.read().count() == 20
    assert seen.value == 20
