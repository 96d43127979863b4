"""Texts are embedded once for all ingests."""

import numpy as np
from pyspark.sql import functions as F

from quernstone.operators import embed
from quernstone.session import Engine
from quernstone.sources.store import Store


def counting(log):
    def model(texts):
        with open(log, "a") as f:  # executors are on this machine
            f.writelines(f"{t!r}\n" for t in texts)
        return embed.bag_of_words(texts, 16)

    return model


def test_model_is_not_called_again(spark, tmp_path):
    log = tmp_path / "log"
    cache = embed.Cache(spark, f"file://{tmp_path}/embedded")
    e = Engine(Store(spark, str(tmp_path / "a")).create(16, "cosine", "flat"), counting(str(log)), cache)
    docs = spark.createDataFrame([(f"d{i}", f"Sentence number {i % 5} is here. Another one follows it.") for i in range(8)], "doc_id string, text string")
    assert e.ingest(docs, "sentence", 30, 0) == 16
    calls = log.read_text().splitlines()
    assert len(calls) == len(set(calls)) == 6
    other = Engine(Store(spark, str(tmp_path / "b")).create(16, "cosine", "flat"), counting(str(log)), embed.Cache(spark, f"file://{tmp_path}/embedded"))
    assert e.ingest(docs, "sentence", 30, 0) == 16 and other.ingest(docs, "sentence", 30, 0) == 16
    assert log.read_text().splitlines() == calls
    more = docs.limit(1).unionByName(spark.createDataFrame([("new", "Only this is new.")], "doc_id string, text string"))
    other.ingest(more, "sentence", 30, 0)
    assert log.read_text().splitlines()[6:] == ["'Only this is new.'"]
    for r in other.rows().collect():
        assert np.allclose(r.embedding, embed.bag_of_words([r.text], 16)[0])


def test_keys_beyond_the_bound_and_repeated_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embed, "KEYS", 3)
    cache = embed.Cache(spark, f"file://{tmp_path}/c")
    rows = spark.createDataFrame([(i, f" text {i % 7} ") for i in range(20)] + [(20, None)], "i int, text string")
    first = {r.i: r.embedding for r in embed.embed(rows, model=lambda t: embed.bag_of_words(t, 8), cache=cache).collect()}
    cache.add(spark.read.parquet(f"{tmp_path}/c").drop("bucket"))  # as a job that ran twice would
    again = embed.embed(rows, model=None, cache=cache)
    assert {r.i: r.embedding for r in again.collect()} == first and again.count() == 21
    assert spark.read.parquet(f"{tmp_path}/c").select(F.countDistinct("_key")).first()[0] == 8
