"""Helpers shared by the training-data operators.

Conventions of every operator here: input columns are picked by name (extra columns are
ignored or carried through untouched, whatever they are called), a null text is the empty
text, and no intermediate result is ever kept in an executor's own folder.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BATCH_BYTES = 1 << 20
#: Rows of ids that may be broadcast; some 16 MB.
LOOKUP = 500_000
#: A key is heavy if it has over one ``HEAVY_MOST``-th of all rows, and ``HEAVY_LEAST`` rows.
HEAVY_MOST, HEAVY_LEAST = 100_000, 500
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # not glibc
    _LIBC = None
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_LIMIT, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context.

    Only where all tasks run on this machine, as in tests, an unset one is replaced by a folder of its own; elsewhere it raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches of this session to ``BATCH_BYTES``, unless it has a limit of its own: a batch of ten thousand long
    texts would have to be in memory at once, on both sides."""
    if spark.conf.get(_BATCH_LIMIT, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; its lineage is cut there, and the shuffle files that it took go at once.

    Otherwise these would stay until the driver happens to collect its garbage, a whole operator's at a time. The setting holds for
    a plan of this call's own, so no frame of the caller's loses files that it may read again.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def given(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver has. They go to the JVM as Arrow: createDataFrame makes an RDD of Python objects of a list, for which
    every executor starts a second pool of Python workers, and these stay beside those of the operators for a minute."""
    kind = T.StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    table = pa.table([pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(columns, kind, strict=True)], names=kind.names)
    return spark.createDataFrame(table, kind)


def lookup(ids: DataFrame) -> DataFrame:
    """ids (a few numbers a row, already computed) to join a larger table with: broadcast if there are at most ``LOOKUP`` of them,
    else left to a sort-merge join."""
    return F.broadcast(ids) if ids.limit(LOOKUP + 1).count() <= LOOKUP else ids


def spread_join(rows: DataFrame, counted: DataFrame, *keys: str) -> DataFrame:
    """rows joined with counted (already computed: one row a key, n: how many of rows have it) without sending a heavy key to one task.

    Rows of heavy keys stay where they are and meet a broadcast: each has over one ``HEAVY_MOST``-th of the rows, so there are fewer than
    ``HEAVY_MOST`` of them, whatever the size of the table. All other rows are shuffled.
    """
    sizes = counted.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    bound = max(HEAVY_LEAST, (sizes["all"] or 0) // HEAVY_MOST)
    if (sizes["most"] or 0) <= bound:
        return rows.join(counted, list(keys))
    heavy = F.col("n") > bound
    hot = counted.filter(heavy)
    rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(counted.filter(~heavy), list(keys))
    return rows.join(F.broadcast(hot), list(keys)).unionByName(rest)


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, as doc_id and text; a null text becomes the empty one."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null: empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def give_back() -> None:
    """Returns memory that is free to the system: workers stay, for tasks of other kinds, and would keep the most that they ever had."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


#: What tasks of one operator have learnt in this worker and leave to the next; tasks of other operators drop it, and so does a worker
#: that has had nothing to do for ``IDLE_S`` seconds.
LEARNT: dict[str, object] = {}
IDLE_S = 3.0
_BUSY = {"tasks": 0, "begun": 0}


def _rest(begun: int) -> None:
    if not _BUSY["tasks"] and _BUSY["begun"] == begun:
        LEARNT.clear()
        give_back()


def _later(seconds: float, what: Callable, *args) -> None:
    timer = threading.Timer(seconds, what, args)
    timer.daemon = True
    timer.start()


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 1 << 19, operator: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, sliced so that a slice holds about ``most`` bytes of text (or one longer row)."""
    for other in [x for x in LEARNT if x != operator]:
        del LEARNT[other]
    give_back()
    _BUSY["tasks"] += 1
    _BUSY["begun"] += 1
    begun = _BUSY["begun"]
    try:
        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(text))
            size = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
            ends = np.cumsum(size)
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
                yield batch.slice(at, to - at)
                at = to
                done += 1
                if done % 4 == 0:
                    give_back()
    finally:
        _BUSY["tasks"] -= 1
        # What the task itself still holds is free a moment later, when the worker is idle.
        _later(1.0, give_back)
        _later(IDLE_S, _rest, begun)


def keep_first(docs: DataFrame, found: DataFrame, key: Callable[[bytes], int]) -> DataFrame:
    """The rows of docs (with columns doc_id, text) that have the smallest doc_id of their component, and those without a doc_id.

    found: doc_id, key, component_id of every row. Rows that share a doc_id are told apart by ``key`` of their texts; of those in
    one component the first by text, and then by all columns, stays.
    """
    named = found.filter("doc_id is not null")
    least = cut(named.groupBy("component_id").agg(F.min("doc_id").alias("_kept_id")))
    again = cut(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_again_id")))
    kept = docs.join(lookup(least.select("_kept_id")), docs["doc_id"] == F.col("_kept_id"), "left_semi")
    if not again.isEmpty():
        on = docs["doc_id"] == F.col("_again_id")
        rows = kept.join(again, on, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

        def keyed(batches):
            for b in pieces(batches):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([key(x) for x in raw(b.column(2))], pa.int64())], names=["row", "doc_id", "text", "key"])

        rows = rows.mapInArrow(keyed, T.StructType([*rows.schema, T.StructField("key", T.LongType())]))
        groups = named.join(again, named["doc_id"] == F.col("_again_id"), "left_semi").select("key", "component_id").distinct()
        rows = rows.join(groups, "key").join(least, "component_id").filter("doc_id = _kept_id")
        rank = F.row_number().over(Window.partitionBy("component_id").orderBy("text", F.to_json("row")))
        kept = kept.join(again, on, "left_anti").unionByName(rows.withColumn("_rank", rank).filter("_rank = 1").select("row.*"))
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def smallest(rows: DataFrame, group: str, order: str, most: int, salts: int = 64) -> DataFrame:
    """Of each group the ``most`` rows of the smallest ``order``, in one pass.

    Each task keeps at most ``most`` rows of a group before anything is shuffled, and groups are dealt out by salt first, so that
    a group that has most of the rows does not meet in one task.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    for keys in ([group, "_salt"], [group]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        salted = salted.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    return salted.drop("_salt")
