"""Frames that are cut: their shuffle files go."""

import time

from pyspark.sql import functions as F

from quernstone.llm.common import cut


def shuffled(spark):
    """The names of the shuffle files there are."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def test_cut_leaves_no_shuffle_files(spark):
    """Those of a cut frame go without a collection of garbage; others stay, and what they belong to can be read again."""
    rows = spark.range(20_000).select((F.col("id") % 997).alias("a.b"), F.col("id").alias("c"))
    summed = rows.groupBy("`a.b`").agg(F.sum("c").alias("c"))
    want = sorted(summed.collect())
    before = shuffled(spark)
    assert before
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = cut(summed.filter("c >= 0").distinct())
    until = time.time() + 10
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert got.columns == ["a.b", "c"] and sorted(got.collect()) == sorted(summed.collect()) == want
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
