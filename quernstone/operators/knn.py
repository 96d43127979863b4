"""Exact nearest neighbours.

One query is ``filter, distance, order by, limit``, which Spark runs as a top-k with no shuffle of rows. A batch of
queries is sent to the scan, ``PASS_BYTES`` of them at a time, where an Arrow kernel goes through them in blocks of ``QUERY_BLOCK``
and keeps the k nearest rows of each partition per query; only those, partitions x queries x k rows, meet in the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField

from ..functions import vectors as V
from ..plans.filters import compile_filter

QUERY_BLOCK = 1024
ROWS = 4096
#: Query vectors that one pass over the rows takes along.
PASS_BYTES = 64 << 20


def _filtered(vectors: DataFrame, query_filter: dict | None) -> DataFrame:
    c = compile_filter(query_filter, vectors.schema)
    return vectors if c is None else vectors.filter(c)


def search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", query_filter: dict | None = None) -> DataFrame:
    """The k rows nearest to one vector: id, rank, distance, score; ties by id.

    vectors: id, embedding, and any columns that the filter names.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    near = _filtered(vectors, query_filter).select("id", V.distance(F.col("embedding"), q, metric).alias("distance")).orderBy("distance", "id").limit(k)
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")).cast("bigint"))
    return ranked.select("id", "rank", "distance", V.score(F.col("distance"), metric).alias("score"))


def distances(m: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """rows x queries, in double."""
    if metric == "cosine":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.EPSILON)
        return 1.0 - unit(m) @ unit(q).T
    if metric == "dot":
        return -(m @ q.T)
    if metric == "l2":
        s = (m * m).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (m @ q.T)
        return np.sqrt(np.maximum(s, 0))
    if metric == "manhattan":
        return np.stack([np.abs(m - x).sum(1) for x in q], 1)
    raise ValueError(f"unknown metric {metric!r}; one of {', '.join(V.METRICS)}")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sortable(column: pa.Array) -> np.ndarray:
    """Ids as numbers or as fixed-width text, in the order that Spark has them in."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist(), str)


def top_rows(k: int, parts, asked, qid_type: pa.DataType):
    """A kernel over batches of rows whose first column is their id: the k nearest rows of the partition for each query.

    asked: a broadcast of qids and of what parts() needs of them, so one pass over the rows serves all of them. parts(batch, asked)
    yields (rows, queries, distances, tags): numbers of rows of the batch and of queries, a matrix, and a number to keep for each row.
    """

    def run(batches):
        qids, q = asked.value
        edge = np.full(len(qids), np.inf)  # the k-th distance of each query so far
        kept, id_type = None, None  # ids, distances, queries, tags

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                own, found = _sortable(b.column(0)), []
                for rows, queries, d, tags in parts(b, q):
                    few = min(k, len(rows))
                    # All rows up to the k-th distance of a query, equal ones included: ids decide among them.
                    near = np.minimum(np.partition(d, few - 1, axis=0)[few - 1] if few == k else np.inf, edge[queries])
                    row, query = np.nonzero(d <= near)
                    found.append((own[rows[row]], d[row, query], queries[query], tags[row]))
                if not found:
                    continue
                ids, dist, who, tag = (np.concatenate(x) for x in zip(*([kept] if kept else []), *found, strict=True))
                order = np.lexsort((ids, dist, who))
                ids, dist, who, tag = ids[order], dist[order], who[order], tag[order]
                place = np.arange(len(who)) - np.searchsorted(who, who, "left")
                last = place == k - 1
                edge[who[last]] = dist[last]
                kept = tuple(x[place < k] for x in (ids, dist, who, tag))
        if kept and len(kept[0]):
            ids, dist, who, tag = kept
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in who.tolist()], qid_type), pa.array(ids.tolist(), id_type), pa.array(dist), pa.array(tag, pa.int64())], names=["qid", "id", "distance", "tag"])

    return run


def in_blocks(measure):
    """parts() for top_rows: all rows (id, value) against all queries, in blocks. measure(values, asked, from, to) has the distances."""

    def parts(batch, asked):
        rows = np.arange(batch.num_rows)
        total = len(asked[0]) if isinstance(asked, list) else len(asked)
        for a in range(0, total, QUERY_BLOCK):
            b = min(a + QUERY_BLOCK, total)
            yield rows, np.arange(a, b), measure(batch.column(1), asked, a, b), np.zeros(len(rows), np.int64)

    return parts


def passes(queries: DataFrame, most_bytes: int = PASS_BYTES) -> Iterator[tuple[list, np.ndarray]]:
    """The queries (qid, embedding), ids and vectors, in groups of at most most_bytes."""
    qids, rows = [], []
    for r in queries.select("qid", "embedding").toLocalIterator():
        qids.append(r.qid)
        rows.append(np.asarray(r.embedding, np.float64))
        if len(qids) * rows[0].nbytes >= most_bytes:
            yield qids, np.array(rows)
            qids, rows = [], []
    if qids:
        yield qids, np.array(rows)


def nearest(rows: DataFrame, groups: Iterable[tuple[list, object]], parts, k: int, qid: StructField) -> DataFrame:
    """qid, id, rank, distance, tag of the k nearest rows to each query; ties by id. groups: qids and what parts() needs of them, as
    top_rows() takes them; each group is a pass over the rows."""
    kinds = dict(rows.dtypes)
    schema = f"qid {qid.dataType.simpleString()}, id {kinds[rows.columns[0]]}, distance double, tag bigint"
    local = None
    for asked in groups:
        part = rows.mapInArrow(top_rows(k, parts, rows.sparkSession.sparkContext.broadcast(asked), to_arrow_type(qid.dataType)), schema)
        local = part if local is None else local.unionByName(part)
    if local is None:
        local = rows.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("distance", 12), "id")).cast("bigint")
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "id", "rank", "distance", "tag")


def batch_search(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", query_filter: dict | None = None, most_bytes: int = PASS_BYTES) -> DataFrame:
    """The k rows nearest to each query: qid, id, rank, distance, score; ties by id.

    queries: qid, embedding. The rows are read once for every ``most_bytes`` of query vectors.
    """
    rows = _filtered(vectors, query_filter).select("id", "embedding")
    best = nearest(rows, passes(queries, most_bytes), in_blocks(lambda x, q, a, b: distances(matrix(x), q[a:b], metric)), k, queries.schema["qid"])
    return best.select("qid", "id", "rank", "distance", V.score(F.col("distance"), metric).alias("score"))


def pairwise(vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """a, b, distance of every pair of a bounded set (a neighbour list, the centroids); the diagonal is 0 but for dot."""
    n = vectors.limit(QUERY_BLOCK + 1).count()
    if n > QUERY_BLOCK:
        raise ValueError(f"pairwise() is for at most {QUERY_BLOCK} vectors; use batch_search()")
    a, b = vectors.select(F.col("id").alias("a"), F.col("embedding").alias("u")), vectors.select(F.col("id").alias("b"), F.col("embedding").alias("v"))
    d = V.distance(F.col("u"), F.col("v"), metric)
    d = d if metric == "dot" else F.when(F.col("a") == F.col("b"), 0.0).otherwise(d)
    return a.join(F.broadcast(b)).select("a", "b", d.alias("distance"))
