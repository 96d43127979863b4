"""Files of vectors as a data source: .fvecs (a length and 32-bit floats for each vector) and .npy (a matrix, or a vector of numbers).

A file is read by ranges of its rows, each of which is a range of bytes, so one file is as many tasks as it has ranges. Filters on
``pos`` are pushed: ranges that hold no such row are not read, and of a range only the bytes of its rows. Only headers are read on the
driver. Paths are those of pyarrow.fs (local files, s3://, hdfs:// and others), which all executors must reach.

    register(spark)
    spark.read.format("vectors").load("s3://bucket/sift/*.fvecs")     # file, pos, embedding
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a partition, and rows of a batch that goes to Spark.
PART_BYTES, BATCH_ROWS = 32 << 20, 4096
_PUSHED = "spark.sql.python.filterPushdown.enabled"


@dataclass
class File:
    """rows of ``row`` bytes from byte ``first`` on; skip: bytes of a row before its numbers."""

    path: str
    first: int
    row: int
    skip: int
    rows: int
    kind: str


@dataclass
class Part(InputPartition):
    file: File
    start: int
    stop: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path)) if re.match(r"^[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


def _found(path: str) -> list[str]:
    """The files of a path, a folder or a pattern, with the file system's prefix."""
    fs, base = _open(path)
    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
    if "*" in base or "?" in base:
        names = [x.path for x in fs.get_file_info(pafs.FileSelector(base.rsplit("/", 1)[0])) if fnmatch.fnmatch(x.path.rsplit("/", 1)[-1], base.rsplit("/", 1)[-1])]
    elif fs.get_file_info(base).type == pafs.FileType.Directory:
        names = [x.path for x in fs.get_file_info(pafs.FileSelector(base)) if x.path.endswith((".fvecs", ".npy"))]
    else:
        names = [base]
    if not names:
        raise FileNotFoundError(path)
    return [prefix + n for n in sorted(names)]


def layout(path: str) -> File:
    """Read from the head of a file."""
    fs, base = _open(path)
    size = fs.get_file_info(base).size
    with fs.open_input_file(base) as f:
        if path.endswith(".fvecs"):
            dim = int(np.frombuffer(f.read(4), "<i4")[0]) if size else 0
            row = 4 + 4 * dim
            if dim < 0 or size % row:
                raise ValueError(f"{path} does not hold vectors of {dim} numbers")
            return File(path, 0, row, 4, size // row, "<f4")
        if not path.endswith(".npy"):
            raise ValueError(f"{path} is neither .fvecs nor .npy")
        version = np.lib.format.read_magic(f)
        shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if by_column and len(shape) > 1 or len(shape) not in (1, 2) or dtype.kind not in "fiub":
            raise ValueError(f"{path} is no matrix of numbers, row by row")
        row = dtype.itemsize * (shape[1] if len(shape) == 2 else 1)
        if size - f.tell() < row * shape[0]:
            raise ValueError(f"{path} is cut off")
        return File(path, f.tell(), row, 0, shape[0], dtype.str)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part_bytes = options["path"], int(options.get("partbytes", PART_BYTES))
        self.low, self.high, self.only = 0, None, None

    def pushFilters(self, filters: list[Filter]):
        """Those on pos; all others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("pos",):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                stop = f.value + isinstance(f, LessThanOrEqual)
                self.high = stop if self.high is None else min(self.high, stop)
            elif isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = some if self.only is None else self.only & some
            else:
                yield f

    def partitions(self) -> list[Part]:
        out = []
        for path in _found(self.path):
            file = layout(path)
            each = max(1, self.part_bytes // max(1, file.row))
            stop = file.rows if self.high is None else min(file.rows, self.high)
            for a in range(self.low // each * each, max(stop, 0), each):
                start, end = max(a, self.low), min(a + each, stop)
                if start < end and (self.only is None or any(start <= x < end for x in self.only if x is not None)):
                    out.append(Part(file, start, end))
        return out or [Part(None, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.file is None:
            return
        f = part.file
        fs, base = _open(f.path)
        dtype = np.dtype(f.kind)
        dim = (f.row - f.skip) // dtype.itemsize
        with fs.open_input_file(base) as source:
            for a in range(part.start, part.stop, BATCH_ROWS):
                b = min(a + BATCH_ROWS, part.stop)
                source.seek(f.first + a * f.row)
                raw = np.frombuffer(source.read((b - a) * f.row), np.uint8).reshape(b - a, f.row)
                if f.skip and (raw[:, :4].copy().view("<i4") != dim).any():
                    raise ValueError(f"{f.path} holds vectors of several lengths")
                values = np.ascontiguousarray(raw[:, f.skip :]).view(dtype).astype(np.float32)
                pos = np.arange(a, b)
                if self.only is not None:
                    keep = np.isin(pos, [x for x in self.only if x is not None])
                    pos, values = pos[keep], values[keep]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1) * dim, pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([f.path.rsplit("/", 1)[-1]] * len(pos), pa.string()), pa.array(pos), lists], names=["file", "pos", "embedding"])


class VectorFiles(DataSource):
    """Option partBytes: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "file string, pos bigint, embedding array<float>"

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters to it."""
    spark.dataSource.register(VectorFiles)
    spark.conf.set(_PUSHED, "true")


def load(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """file, pos, embedding."""
    register(spark)
    return spark.read.format("vectors").option("partBytes", part_bytes).load(path)
