"""Packing into optimal length buckets.

The global histogram of sequence lengths goes through a dynamic programme that chooses the bucket boundaries with
the least padding in all. Batches under a token budget then form inside each bucket. Sequences longer than
``longest`` are cut into pieces, none of which is dropped; so the histogram has at most ``longest`` entries, which
bounds what the driver holds whatever the number of documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, given


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding; the first of equally good cuts.

    best[k][j], the least padding of the first j lengths in k buckets, is taken over the last bucket's start i. Its
    cost satisfies the quadrangle inequality, so the best start never moves left as j grows: divide and conquer.
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(x)
    rows, ids = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * x)))
    best = np.concatenate(([0], np.full(n, np.inf)))
    starts = []
    for _ in range(min(buckets, n)):
        new, start = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + x[j - 1] * (rows[j] - rows[i]) - (ids[j] - ids[i])
            k = int(np.argmin(cost))
            new[j], start[j] = cost[k], i[k]
            if lo < j:
                todo.append((lo, j - 1, a, int(i[k])))
            if j < hi:
                todo.append((j + 1, hi, int(i[k]), b))
        starts.append(start)
        best = new
    out, j = [], n
    for start in reversed(starts):
        if j <= 0:
            break
        out.append(int(x[j - 1]))
        j = int(start[j])
    return out[::-1]


def pack(lengths: DataFrame, longest: int = 2048, buckets: int = 8, budget: int = 16384, parts: int | None = None) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, n_tokens, bucket (length that it is padded to), batch_id, slot.

    lengths: doc_id, n_tokens. A batch holds up to max(1, budget // bucket) pieces of one bucket, ordered by doc_id and
    piece; every batch of a bucket but its last is full. Documents of no tokens, or of null, have no piece. Rows that repeat a
    doc_id have pieces each, ordered by their tokens; a null doc_id comes first. Of equally good boundaries the first are
    taken. An empty table gives an empty one; other columns are ignored whatever their names. Row numbers come from the sizes of sorted ranges, so no bucket meets in one task however full it is.
    """
    spark = lengths.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.col("n_tokens")
    rows = lengths.filter("n_tokens > 0").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), ((n - 1) / longest).cast("int")), lambda i: F.least(F.lit(longest).cast("bigint"), n - i.cast("bigint") * longest))).alias("piece", "n_tokens"))
    rows = cut(rows)
    histogram = rows.groupBy("n_tokens").count().collect()  # at most `longest` rows
    bounds = boundaries([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets)
    bucket = F.lit(None).cast("bigint")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("bigint")).otherwise(bucket)
    sorted_ = rows.withColumn("bucket", bucket).repartitionByRange(parts, "bucket", "doc_id", "piece", "n_tokens").sortWithinPartitions("bucket", "doc_id", "piece", "n_tokens")
    placed = cut(sorted_.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy("bucket", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy("bucket", "part").collect()  # parts + buckets rows at most
    before, seen, table = 0, None, []
    for r in sizes:
        before = 0 if r["bucket"] != seen else before
        seen = r["bucket"]
        table.append((r["bucket"], r["part"], before - r["first"]))
        before += r["n"]
    shifts = given(spark, table, "bucket bigint, part bigint, shift bigint")
    row = F.col("at") + F.col("shift")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    joined = placed.withColumn("part", part).join(F.broadcast(shifts), ["bucket", "part"])
    return joined.select("doc_id", F.col("piece").cast("int").alias("piece"), "n_tokens", "bucket", F.concat_ws("-", "bucket", F.floor(row / size)).alias("batch_id"), (row % size).cast("int").alias("slot"))
