import numpy as np
from pyspark.sql import functions as F

from quernstone.operators import embed
from quernstone.queries import QUERIES

#: The hashes of the two words of each text have one place and opposite signs; all four words of the last text cancel out as well.
CANCELLED = ["bpwvivqv mzjtm.", "Onre arboes,", "onre arboes, thaningwh erlyin"]


def test_texts_with_words_have_a_direction():
    m = embed.bag_of_words([*CANCELLED, "onre", "", "  "])
    assert np.allclose(np.linalg.norm(m, axis=1), [1, 1, 1, 1, 0, 0])


def test_texts_whose_words_cancel_out_are_ingested(spark, tmp_path):
    """They were zero vectors, at which the whole write was given up; a table of 0.1 GB happens to have none."""
    docs = spark.createDataFrame([*enumerate(CANCELLED), (3, "other words"), (4, " "), (5, None)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.id, r.source) for r in QUERIES["engine_ingest"](spark, str(tmp_path)).collect()}
    want = docs.filter("trim(text) <> ''").select(F.substring(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":fixed:10000:0:"), "text"), 256), 1, 16), F.col("doc_id").cast("string"))
    assert got == {tuple(r) for r in want.collect()} and len(got) == 4
