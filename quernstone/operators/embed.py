"""Embeddings: a model given as a function, or a deterministic stand-in made of seeded noise."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 384
#: Folders of a cache, and keys that are broadcast to it.
BUCKETS, KEYS = 64, 500_000
#: Words whose vectors a worker keeps (150 MB).
WORDS = 98_304


#: One generator for all seeds: to make one takes ten times as long as to seed it again.
_NOISE = np.random.RandomState(0)
_WORDS: dict[int, tuple[dict[str, int], np.ndarray]] = {}


def _seeded(text: str, digits: int, dim: int) -> np.ndarray:
    _NOISE.seed(int(hashlib.md5(text.encode()).hexdigest()[:digits], 16))
    return _NOISE.randn(dim).astype(np.float32)


def _rows(words: list[str], dim: int) -> np.ndarray:
    """The words' vectors, from a table of at most ``WORDS`` of them that begins anew when it is full."""
    places, table = _WORDS.setdefault(dim, ({}, np.empty((WORDS, dim), np.float32)))
    if len(places) + len(words) > WORDS:
        places.clear()
    at = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        j = places.get(w)
        if j is None:
            j = places[w] = len(places)
            table[j] = 0.3 * _seeded(w, 6, dim)
        at[i] = j
    return table[at]


def stand_in(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors: noise seeded by the text plus 0.3 times noise seeded by each of its words, so texts with common words are near."""
    out = np.empty((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        v = _seeded(t, 8, dim)
        words = t.lower().split()
        for a in range(0, len(words), 512):
            # Row after row, so the sum is the same as if words were added one by one.
            v = np.add.reduce(np.concatenate((v[None], _rows(words[a : a + 512], dim))), axis=0)
        n = np.linalg.norm(v)
        out[i] = v / n if n > 0 else v
    return out


def bag_of_words(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed word counts with hashed signs: cheap, and texts with common words are near. Where the signs cancel all words
    out they are left off, so only a text without words has no direction."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        words = t.lower().split()
        for w in words:
            h = crc32(w.encode())
            out[i, h % dim] += 1.0 if h & 0x10000 else -1.0
        if not out[i].any():
            for w in words:
                out[i, crc32(w.encode()) % dim] += 1.0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1.0, n)


class Cache:
    """Embeddings by a hash of the text, in a folder that driver and executors share. One model, one folder.

    It is only ever added to, by whole Parquet files, so jobs at the same time or twice add equal rows and do no harm.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_SUCCESS")
        self._there = lambda: path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def known(self, keys: DataFrame) -> DataFrame:
        """_key, embedding of those keys (_key, distinct) that are there. The keys go to the scan, as long as there are at most ``KEYS``."""
        if not self._there():
            return self.spark.createDataFrame([], "_key string, embedding array<float>")
        few = keys.limit(KEYS + 1).count() <= KEYS
        rows = self.spark.read.parquet(self.folder).join(F.broadcast(keys) if few else keys, "_key", "left_semi")
        return rows.groupBy("_key").agg(F.first("embedding").alias("embedding"))

    def add(self, rows: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int")
        rows.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(self.folder)


def _run(model: Callable[[list[str]], np.ndarray], batch: int, text_col: str):
    """Batches with an embedding: that of the first text of each _key, whose rows follow each other."""

    def run(batches):
        last, vector = None, None
        for b in batches:
            for at in range(0, b.num_rows, batch):
                s = b.slice(at, batch)
                keys, texts = s.column(s.schema.get_field_index("_key")).to_pylist(), s.column(s.schema.get_field_index(text_col))
                new = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]
                found = [np.asarray(model([t or "" for t in texts.take(pa.array(new)).to_pylist()]), np.float32)] if new else []
                m = np.concatenate(found if new[:1] == [0] else [vector, *found])
                which = np.searchsorted(new, np.arange(len(keys)), "right") - (new[:1] == [0])
                last, vector = keys[-1], m[-1:]
                offsets = pa.array(np.arange(len(keys) + 1) * m.shape[1], pa.int32())
                listed = pa.ListArray.from_arrays(offsets, pa.array(m[which].ravel()))
                yield pa.RecordBatch.from_arrays([*s.columns, listed], names=[*s.schema.names, "embedding"])

    return run


def embed(rows: DataFrame, text_col: str = "text", model: Callable[[list[str]], np.ndarray] | None = None, batch: int = 32, cache: Cache | None = None, same: str | None = None) -> DataFrame:
    """rows with ``embedding``. Texts that are equal once trimmed are embedded once; with a cache, once for all calls.

    Rows are dealt out by a hash of the text, once, and pass the model in its order. same: a column whose equal values name equal texts;
    rows that repeat it are one row, with the first value that is not null of each column.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = rows.withColumn("_key", F.md5(F.trim(text).cast("binary"))).repartition("_key")
    if same:
        # They are in one place already.
        keyed = keyed.groupBy("_key", same).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c != same]).select(*rows.columns, "_key")

    def made(x: DataFrame) -> DataFrame:
        return x.mapInArrow(_run(model or stand_in, batch, text_col), T.StructType([*x.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))

    # A VARIANT column cannot pass through Arrow; rows with one meet their vectors by a join.
    if cache is None and "variant" not in rows.schema.simpleString():
        return made(keyed.sortWithinPartitions("_key", text)).drop("_key")
    once = keyed.groupBy("_key").agg(F.min(text).alias(text_col))
    if cache is None:
        return keyed.join(made(once).drop(text_col), "_key").drop("_key")
    keys = keyed.select("_key").distinct()
    cache.add(made(once.join(cache.known(keys).select("_key"), "_key", "left_anti")).drop(text_col))
    return keyed.join(cache.known(keys), "_key").drop("_key")
