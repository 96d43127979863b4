"""Scalar (8-bit) and product quantization."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import kmeans, knn


def scalar_params(vectors: DataFrame, symmetric: bool = True) -> DataFrame:
    """j, scale, zero of each dimension: max|x| / 127 and 0, or (max - min) / 255 and the minimum. Scales are at least 1e-8."""
    each = vectors.select(F.posexplode(V.as_double(F.col("embedding"))).alias("j", "x"))
    if symmetric:
        return each.groupBy("j").agg(F.greatest(F.max(F.abs("x")) / 127.0, F.lit(1e-8)).alias("scale"), F.lit(0.0).alias("zero"))
    return each.groupBy("j").agg(F.greatest((F.max("x") - F.min("x")) / 255.0, F.lit(1e-8)).alias("scale"), F.min("x").alias("zero"))


def _packed(params: DataFrame) -> DataFrame:
    """One row with all parameters in order of dimension; their number is that of the dimensions."""
    rows = F.sort_array(F.collect_list(F.struct("j", "scale", "zero")))
    return params.agg(F.transform(rows, lambda p: p["scale"]).alias("_scale"), F.transform(rows, lambda p: p["zero"]).alias("_zero"))


def scalar_encode(vectors: DataFrame, params: DataFrame, symmetric: bool = True) -> DataFrame:
    """vectors with ``code`` (array<smallint>): rounded half to even, clipped to -127..127 or 0..255."""
    low, high = (-127, 127) if symmetric else (0, 255)
    steps = F.zip_with(F.zip_with(V.as_double(F.col("embedding")), F.col("_zero"), lambda x, z: x - z), F.col("_scale"), lambda x, s: F.rint(x / s))
    code = F.transform(steps, lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))).cast("smallint"))
    return vectors.crossJoin(F.broadcast(_packed(params))).withColumn("code", code).drop("_scale", "_zero")


def scalar_decode(encoded: DataFrame, params: DataFrame) -> DataFrame:
    """encoded with ``decoded`` (array<double>)."""
    back = F.zip_with(F.zip_with(F.col("code"), F.col("_scale"), lambda c, s: c.cast("double") * s), F.col("_zero"), lambda x, z: x + z)
    return encoded.crossJoin(F.broadcast(_packed(params))).withColumn("decoded", back).drop("_scale", "_zero")


def squared_error(a: Column, b: Column) -> Column:
    return V.euclidean(a, b, squared=True)


def error_stats(decoded: DataFrame, code_bytes: float) -> DataFrame:
    """One row: n, mse (per coordinate), raw_bytes (32-bit floats), code_bytes, ratio."""
    n, dim = F.count(F.lit(1)), F.max(F.size("embedding"))
    raw = n * dim * 4
    return decoded.agg(n.alias("n"), (F.sum(squared_error(F.col("embedding"), F.col("decoded"))) / (n * dim)).alias("mse"), raw.alias("raw_bytes"), (n * F.lit(code_bytes)).alias("code_bytes"), (raw / (n * F.lit(code_bytes))).alias("ratio"))


def divisor(dim: int, most: int) -> int:
    """The largest number of equal sub-vectors, at most ``most``."""
    return max(m for m in range(1, min(most, dim) + 1) if dim % m == 0)


def product_train(vectors: DataFrame, parts: int = 8, clusters: int = 256, steps: int = 20, seed: int = 42) -> DataFrame:
    """Codebook: m, code, centroid. The number of parts falls to a divisor of the dimension."""
    first = vectors.select(F.size("embedding")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "m int, code int, centroid array<double>")
    books = kmeans.train(vectors, clusters, divisor(first[0], parts), "l2", steps, seed)
    return vectors.sparkSession.createDataFrame([(m, j, c.tolist()) for m, book in enumerate(books) for j, c in enumerate(book)], "m int, code int, centroid array<double>")


def given_codebook(vectors: DataFrame, parts: int, clusters: int) -> DataFrame:
    """A codebook of the sub-vectors of the ``clusters`` vectors of the smallest ids."""
    few = vectors.orderBy("id").limit(clusters)
    numbered = few.select(F.posexplode(F.sort_array(F.collect_list(F.struct("id", "embedding")))).alias("code", "x"))
    size = F.size("x.embedding") / parts
    return numbered.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("m"), "code", "x").select("m", "code", F.slice(V.as_double(F.col("x.embedding")), (F.col("m") * size + 1).cast("int"), size.cast("int")).alias("centroid"))


def _books(codebook: DataFrame) -> DataFrame:
    """One row: an array over parts of arrays over codes of centroids; parts x clusters is a parameter of the index."""
    book = codebook.groupBy("m").agg(F.transform(F.sort_array(F.collect_list(F.struct("code", "centroid"))), lambda c: c["centroid"]).alias("book"))
    return book.agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "book"))), lambda b: b["book"]).alias("_books"))


def _part(v: Column, m: Column, book: Column) -> Column:
    size = F.size(F.element_at(book, 1))
    return F.slice(V.as_double(v), m * size + 1, size)


def product_encode(vectors: DataFrame, codebook: DataFrame) -> DataFrame:
    """vectors with ``code`` (array<smallint>): per part the nearest centroid, the smallest of equally near ones."""

    def nearest(book, m):
        sub = _part(F.col("embedding"), m, book)
        return F.array_min(F.transform(book, lambda c, j: F.struct(V.euclidean(sub, c, squared=True).alias("d"), j.alias("j"))))["j"].cast("smallint")

    return vectors.crossJoin(F.broadcast(_books(codebook))).withColumn("code", F.transform("_books", nearest)).drop("_books")


def product_decode(encoded: DataFrame, codebook: DataFrame) -> DataFrame:
    """encoded with ``decoded`` (array<double>)."""
    parts = F.transform(F.col("code"), lambda c, m: F.element_at(F.element_at(F.col("_books"), m + 1), c.cast("int") + 1))
    return encoded.crossJoin(F.broadcast(_books(codebook))).withColumn("decoded", F.flatten(parts)).drop("_books")


def adc_table(queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """qid, table: for each part the squared distances from the query's part to all its centroids."""
    rows = F.transform(F.col("_books"), lambda book, m: F.transform(book, lambda c: V.euclidean(_part(F.col("embedding"), m, book), c, squared=True)))
    return queries.select("qid", "embedding").crossJoin(F.broadcast(_books(codebook))).select("qid", rows.alias("table"))


def adc_search(encoded: DataFrame, queries: DataFrame, codebook: DataFrame, k: int = 10, most_bytes: int = knn.PASS_BYTES) -> DataFrame:
    """qid, id, rank, distance: the k rows nearest to each query by the squared distance to the decoded vectors, by table lookups only.

    encoded: id, code. Tables go to the scan, ``most_bytes`` of them at a time, and a partition keeps k rows per query.
    """
    books: list[list] = []
    for r in codebook.orderBy("m", "code").collect():  # parts x clusters rows, a parameter of the index
        books += [[]] if r.m == len(books) else []
        books[r.m].append(r.centroid)
    table_bytes = 8 * sum(map(len, books))
    book = [np.array(b, np.float64) for b in books]

    def groups():
        for qids, q in knn.passes(queries, max(1, most_bytes * 8 * len(np.hstack([b[0] for b in book])) // table_bytes)):
            parts = np.split(q, len(book), axis=1)
            yield qids, [((p[:, None, :] - b[None]) ** 2).sum(2) for p, b in zip(parts, book, strict=True)]

    def measure(codes, tables, a, b):
        c = codes.flatten().to_numpy(zero_copy_only=False).reshape(len(codes), -1)
        return sum(t[a:b][:, c[:, m]].T for m, t in enumerate(tables))

    return knn.nearest(encoded.select("id", "code"), groups(), knn.in_blocks(measure), k, queries.schema["qid"]).drop("tag")


def scalar_search(encoded: DataFrame, queries: DataFrame, params: DataFrame, k: int = 10) -> DataFrame:
    """qid, id, rank, distance: the k rows nearest to each query by the squared distance to the decoded vectors. encoded: id, code."""
    rows = params.orderBy("j").collect()  # one for each dimension
    scale, zero = (np.array([r[c] for r in rows]) for c in ("scale", "zero"))

    def measure(codes, q, a, b):
        x = codes.flatten().to_numpy(zero_copy_only=False).reshape(len(codes), -1) * scale + zero
        return knn.distances(x, q[a:b], "l2") ** 2

    return knn.nearest(encoded.select("id", "code"), knn.passes(queries), knn.in_blocks(measure), k, queries.schema["qid"]).drop("tag")
