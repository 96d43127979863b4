"""Loading text files as documents: doc_id, text (cleaned), source, file_path, file_type, title, page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

MAX_BYTES = 10 * 1024 * 1024
ALLOWED = frozenset("pdf md markdown txt py js ts java c cpp h hpp go rs rb php sh sql json yaml yml toml html htm css csv".split())


def _named(df: DataFrame) -> DataFrame:
    base = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))
    return df.withColumn("source", base).withColumn("file_type", F.when(kind == "", "text").otherwise(kind))


def _documents(df: DataFrame) -> DataFrame:
    is_md = F.col("file_type").isin("md", "markdown")
    heading = F.nullif(F.regexp_extract("raw", r"(?m)^#\s+(.+)$", 1), F.lit(""))
    title = F.when(is_md, F.coalesce(heading, F.col("source"))).otherwise(F.col("source"))
    return df.select(F.substring(F.sha2(F.concat("path", F.lit(":"), "raw"), 256), 1, 16).alias("doc_id"), X.clean(F.col("raw")).alias("text"), "source", F.col("path").alias("file_path"), F.when(is_md, "markdown").otherwise(F.col("file_type")).alias("file_type"), title.alias("title"), F.lit(None).cast("int").alias("page"))


def load_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """All files under a path or glob but PDFs. Bytes that are no UTF-8 are dropped."""
    df = _named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    if max_bytes is not None:
        df = df.filter(F.col("length") <= max_bytes)
    # Undecodable bytes come out as U+FFFD and are dropped; a U+FFFD that was in the file goes with them.
    decoded = F.replace(F.try_validate_utf8(F.make_valid_utf8(F.col("content").cast("string"))), F.lit("�"), F.lit(""))
    return _documents(df.filter("file_type <> 'pdf'").withColumn("raw", decoded))


def load(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """All files under a path or glob, each by its kind: a PDF is a document per page, any other file is one. Files that are too large
    are left out; PDFs without the package that reads them raise, they are not passed over."""
    docs = load_files(spark, path, max_bytes)
    pdfs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").endswith(".pdf")).drop("content")
    pdfs = pdfs if max_bytes is None else pdfs.filter(F.col("length") <= max_bytes)
    return docs.unionByName(load_pdf(spark, path, max_bytes)) if not pdfs.isEmpty() else docs


def load_uploads(spark: SparkSession, path: str) -> DataFrame:
    """load() under the limits for uploads: known extensions, at most MAX_BYTES."""
    docs = load(spark, path, MAX_BYTES)
    return docs.filter(F.lower(F.regexp_extract("source", r"\.([^.]+)$", 1)).isin(sorted(ALLOWED)))


def load_pdf(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """One document per page with text; needs pypdf on the executors."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf, which is not installed") from e

    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                    t = page.extract_text() or ""
                    if t.strip():
                        out.append((p, t, i))
            yield pd.DataFrame(out, columns=["path", "raw", "page"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").endswith(".pdf"))
    files = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    raw = files.select("path", "content").mapInPandas(pages, "path string, raw string, page int")
    named = _named(raw)
    return named.select(F.substring(F.sha2(F.concat_ws(":", "path", "page", "raw"), 256), 1, 16).alias("doc_id"), X.clean(F.col("raw")).alias("text"), "source", F.col("path").alias("file_path"), F.lit("pdf").alias("file_type"), F.col("source").alias("title"), "page")


def from_text(spark: SparkSession, text: str, source: str = "text", metadata: dict[str, str] | None = None) -> DataFrame:
    """One document; metadata overrides the defaults."""
    fields = {"source": source, "file_path": None, "file_type": "text", "title": source} | (metadata or {})
    df = spark.createDataFrame([(text, *[fields[k] for k in ("source", "file_path", "file_type", "title")])], "raw string, source string, file_path string, file_type string, title string")
    return df.select(F.substring(F.sha2(F.concat("source", F.lit(":"), "raw"), 256), 1, 16).alias("doc_id"), X.clean(F.col("raw")).alias("text"), "source", "file_path", "file_type", "title", F.lit(None).cast("int").alias("page"))
