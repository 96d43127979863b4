from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.queries import QUERIES, SQL

from .oracle import TABLES, compare


def cleaned(spark, text, **how):
    return spark.createDataFrame([(text,)], "t string").select(X.clean(F.col("t"), **how)).first()[0]


def test_references_without_a_semicolon(spark):
    assert cleaned(spark, "a &amp b &amp; c &#65 &#65; &ampx; &notit; &nosuch;", closed=True) == "a &amp b & c &#65 A &ampx; &notit; &nosuch;"
    assert cleaned(spark, "a &amp b &amp; c &#65 &#65;") == "a & b & c A A"


def test_query_on_cut_references(spark, data, tmp_path):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{data}/{t}.parquet")
    (tmp_path / "pages.parquet").unlink()
    rows = [(1, "u", "<title>a&amp;&amp</title>&quo &am &copy;"), (2, "u", "x&amp;quot; &middot; &quot"), (3, "u", "")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).toPandas().to_parquet(tmp_path / "pages.parquet")
    compare(spark, str(tmp_path), QUERIES["clean_text"], SQL["clean_text"])
