"""Two-dimensional PCA maps: moments in one aggregate, a small eigenproblem on the driver, projection as an expression.

Vectors of more than ``WIDE`` numbers are taken by a QR factorisation in tree form instead: each task keeps one triangle of its centred
rows, tasks of a next step join ``FAN`` triangles each into one, and the last one, whose singular vectors are the axes, is all that
the driver sees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double
from .knn import matrix

SPAN, FILL = 800.0, 0.85
#: Dimensions from which triangles are joined, how many at once, and rows that are added to one at once.
WIDE, FAN, ROWS = 512, 4, 4096


@dataclass
class Projection:
    mean: list[float]
    axes: list[list[float]]  # two
    explained: list[float]  # percent
    scale: float = 1.0
    middle: tuple[float, float] = (0.0, 0.0)

    def raw(self, v: Column, axis: int) -> Column:
        offset = sum(m * a for m, a in zip(self.mean, self.axes[axis], strict=True))
        parts = F.zip_with(as_double(v), F.array(*[F.lit(a) for a in self.axes[axis]]), lambda x, a: x * a)
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) - offset

    def place(self, v: Column) -> tuple[Column, Column]:
        return tuple(F.round((self.raw(v, i) - self.middle[i]) * self.scale, 2) for i in (0, 1))


def moments(vectors: DataFrame, dim: int) -> DataFrame:
    """i, n, t (sum of coordinate i), r0, r1, ... (sums of its products with each coordinate). dim x dim sums leave a partition."""

    def add(batches):
        n, total, outer = 0, None, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                total = x.sum(0) + (0 if total is None else total)
                outer = x.T @ x + (0 if outer is None else outer)
                n += len(x)
        if n:
            for i, row in enumerate(outer):
                yield pa.RecordBatch.from_pydict({"i": [i], "n": [float(n)], "t": [float(total[i])], "row": [row.tolist()]})

    parts = vectors.select("embedding").mapInArrow(add, "i bigint, n double, t double, row array<double>")
    return parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), *[F.sum(F.element_at("row", j + 1)).alias(f"r{j}") for j in range(dim)])


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def _packed(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["part", "r"])


def means(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Number of vectors and mean of each coordinate; one row of sums leaves a task."""

    def add(batches):
        n, total = 0, np.zeros(dim)
        for b in batches:
            n += b.num_rows
            total += matrix(b.column(0)).sum(0) if b.num_rows else 0
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "j": [list(range(dim))], "t": [total.tolist()]})

    sums = vectors.select("embedding").mapInArrow(add, "n bigint, j array<bigint>, t array<double>")
    n = sums.agg(F.sum("n")).first()[0] or 0
    each = sums.select(F.explode(F.arrays_zip("j", "t")).alias("x")).groupBy("x.j").agg(F.sum("x.t").alias("t")).orderBy("j")
    return n, np.array([r.t for r in each.collect()]) / max(n, 1)  # dim rows


def triangle(vectors: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of the centred vectors: R.T @ R is the sum of their outer products."""
    dim = len(mean)

    def local(batches):
        from pyspark import TaskContext

        r, held, n = np.zeros((0, dim)), [], 0
        for b in batches:
            if b.num_rows:
                held.append(matrix(b.column(0)) - mean)
                n += b.num_rows
            if n >= ROWS:
                r, held, n = _triangle([r, *held]), [], 0
        if held or len(r):
            yield _packed(TaskContext.get().partitionId(), _triangle([r, *held]))

    def joined(key, table):
        r = np.zeros((0, dim))
        for x in table.column("r"):  # FAN of them
            r = _triangle([r, np.frombuffer(x.as_buffer()).reshape(-1, dim)])
        return pa.Table.from_batches([_packed(key[0].as_py(), r)])

    rows = vectors.select("embedding")
    left, parts = rows.rdd.getNumPartitions(), rows.mapInArrow(local, "part int, r binary")
    while left > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(joined, "part int, r binary")
        left = -(-left // FAN)
    return np.frombuffer(parts.select("r").first()[0]).reshape(-1, dim)


def _wide(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean, eigenvalues of the scatter and its axes in rows, the largest first."""
    n, mean = means(vectors, dim)
    _, size, axes = np.linalg.svd(triangle(vectors, mean), full_matrices=False)
    return n, mean, size**2, axes


def fit(vectors: DataFrame) -> Projection | None:
    """None without vectors. An axis points to where its largest loading is positive."""
    first = vectors.select(F.size("embedding")).first()
    if first is None:
        return None
    dim = first[0]
    if dim > WIDE:
        n, mean, value, axes = _wide(vectors, dim)
    else:
        rows = moments(vectors, dim).orderBy("i").collect()  # dim rows
        n = rows[0].n
        mean = np.array([r.t for r in rows]) / n
        value, axes = np.linalg.eigh(np.array([list(r[3:]) for r in rows]) - n * np.outer(mean, mean))
        value, axes = value[::-1], axes[:, ::-1].T
    if n < 2:
        return Projection(mean.tolist(), np.eye(2, dim).tolist(), [100.0, 0.0])
    top, total, axes = value[:2], value.sum(), axes[:2]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    if len(axes) < 2:
        axes, top = np.vstack((axes, np.zeros(dim))), np.append(top, 0.0)
    out = Projection(mean.tolist(), axes.tolist(), [round(float(100 * max(v, 0) / total), 1) for v in top] if total > 1e-9 else [50.0, 50.0])
    x, y = out.raw(F.col("embedding"), 0), out.raw(F.col("embedding"), 1)
    a, b, c, d = vectors.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    out.scale, out.middle = SPAN * FILL / max(b - a, d - c, 1e-6), ((a + b) / 2, (c + d) / 2)
    return out


def label(columns: list[str]) -> Column:
    """The first of source, paper_title, title that is there and not empty, shortened beyond 28 characters."""
    named = [F.nullif(F.col(c), F.lit("")) for c in ("source", "paper_title", "title") if c in columns]
    full = F.coalesce(*named, F.lit("General Knowledge"))
    return F.when(F.length(full) > 28, F.concat(F.substring(full, 1, 25), F.lit("..."))).otherwise(full)


def points(vectors: DataFrame, model: Projection) -> DataFrame:
    """id, x, y, cluster, colour: clusters are numbered by the smallest id in them."""
    x, y = model.place(F.col("embedding"))
    rows = vectors.select("id", x.alias("x"), y.alias("y"), label(vectors.columns).alias("cluster"))
    # Numbers are given to the labels, which are few where a legend makes sense at all, by where they stand in the sorted list of them.
    order = rows.groupBy("cluster").agg(F.min("id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("first", "cluster"))).alias("_all"))
    number = F.array_position(F.col("_all.cluster"), F.col("cluster")).cast("int") - 1
    return rows.crossJoin(F.broadcast(order)).withColumn("colour", number).drop("_all")


def clusters(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cluster", "colour").agg(F.count(F.lit(1)).alias("count"))
