"""Versioned Parquet storage of a collection: a base of rows and the writes since, read as the latest row of each id.

A write adds a folder of its own; nothing is changed in place, so a failed write leaves the earlier state whole, and writers at the same time
do not meet but in the manifest. A delete writes bitmaps of places in the files of rows, nothing of the rows themselves. ``compact`` writes the active rows into a new base; readers keep the files that
they have planned against. All paths go through Spark's own file systems.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from . import vectors

#: Rows of writes whose ids are broadcast to the base.
DELTA = 500_000
#: Rows of a file that one bitmap is for, and bitmaps (8 KB each) that are broadcast.
PAGE, PAGES = 1 << 16, 8_000


class InvalidVectors(ValueError):
    """Rows that may not be stored; nothing has been committed."""


def latest(log: DataFrame) -> DataFrame:
    """The active rows of a log: of each id the row of the largest seq, unless it is a deletion."""
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    return log.withColumn("_r", newest).filter("_r = 1 and not is_deleted").drop("_r", "seq", "is_deleted")


def validate(rows: DataFrame, dim: int, metric: str = "cosine") -> int:
    """Number of rows. Raises if an id comes twice or is null, or a vector may not be stored. One aggregate, whatever the number of rows."""
    checks = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.count_if(~V.valid(F.col("embedding"), dim, metric)).alias("bad")).first()
    if checks.ids != checks.n:
        raise InvalidVectors(f"{checks.n - checks.ids} rows repeat an id of the batch or have none")
    if checks.bad:
        raise InvalidVectors(f"{checks.bad} vectors do not have {dim} finite numbers" + " and a norm above zero" * (metric == "cosine"))
    return checks.n


class Conflict(RuntimeError):
    """Someone else has committed in between, again and again."""


class Repeated(RuntimeError):
    """The batch has been committed before."""


class Store:
    """One collection under a folder. Columns besides id and embedding are its metadata.

    A manifest, a numbered file that is never changed, names the folders of rows: a base, in which every id comes once, and the writes
    since. Reading is the base without the ids of the writes, and the latest rows of these. Only the writes go through a window, and
    filters reach both scans. Deleted rows are told by bitmaps (file, page of the file, 64-bit words), each state of which is a
    table of its own; they meet the scans by a broadcast join of files and pages, or beyond ``PAGES`` a shuffled one, never by ids.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(name)

    # Manifests are numbered; the largest number holds.
    def _version(self) -> int:
        found = self._fs.globStatus(self._path(f"{self.folder}/manifest/*.json")) or []
        return max((int(x.getPath().getName().split(".")[0]) for x in found), default=-1)

    def config(self) -> dict | None:
        return self._read(self._version())

    def _read(self, version: int) -> dict | None:
        if version < 0:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/manifest/{version:09d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change, attempts: int = 20) -> dict:
        """Writes change(manifest) under the next number. A rename that does not overwrite decides between writers: who comes second
        tries again on what the first has made."""
        for _ in range(attempts):
            version = self._version()
            config = change(self._read(version))
            new = self._path(f"{self.folder}/manifest/.{uuid.uuid4().hex}")
            out = self._fs.create(new, False)
            out.write(bytearray(json.dumps(config, sort_keys=True).encode()))
            out.close()
            context = self._hadoop.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            try:
                context.rename(new, self._path(f"{self.folder}/manifest/{version + 1:09d}.json"), self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))
                return config
            except Py4JJavaError as e:
                self._fs.delete(new, False)
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
        raise Conflict(f"{attempts} attempts to commit to {self.folder} came second")

    def create(self, dim: int, metric: str = "cosine", index: str = "hnsw", **params) -> Store:
        self._index(index)
        if metric not in V.METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        self._commit(lambda _: {"dim": dim, "metric": metric, "index": index, "params": params, "base": None, "writes": [], "gone": None, "tables": {}})
        return self

    @staticmethod
    def _index(index: str) -> None:
        if index not in ("flat", "ivf", "hnsw"):
            raise ValueError(f"unknown index {index!r}")

    def _write(self, rows: DataFrame, by: str | None = None) -> str:
        name = f"rows/{uuid.uuid4().hex}"
        (rows.write.partitionBy(by) if by else rows.write).parquet(f"{self.folder}/{name}")
        return name

    def _append(self, rows: DataFrame, n: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Rows are computed once: written, looked at where they lie unless their number n says that they have been, and only then committed."""
        name, kept = self._write(rows.withColumn("is_deleted", F.lit(False))), False
        try:
            if n is None:
                c = self.config()
                n = validate(self.spark.read.parquet(f"{self.folder}/{name}"), c["dim"], c["metric"])
            entry = {"name": name, "rows": n}

            def change(c):
                if batch and self._seen(c, batch):
                    raise Repeated(f"batch {batch[1]} of {batch[0]} is there")
                # The first rows of all are the base; their ids have been seen to be distinct.
                first = c["base"] is None and not c["writes"]
                done = {"batches": c.get("batches", {}) | {batch[0]: batch[1]}} if batch else {}
                return c | done | ({"base": entry} if first else {"writes": [*c["writes"], entry]})

            if n:
                self._commit(change)
                kept = True
        finally:
            if not kept:
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        return n

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """How many rows were written. batch: an application's name and the number of its batch; a number that is not above the last one
        that the application has committed is passed over, before anything is written and again at the commit."""
        if batch and self._seen(self.config(), batch):
            return 0
        try:
            n = self._append(rows, batch=batch)
        except Repeated:
            return 0
        if n:
            self.journal("upsert", {"rows": n})
        return n

    @staticmethod
    def _seen(c: dict, batch: tuple[str, int]) -> bool:
        return c.get("batches", {}).get(batch[0], -1) >= batch[1]

    def delete(self, ids: DataFrame, attempts: int = 20) -> int:
        """How many active rows have gone. ids: id. Only bitmaps are written."""
        for _ in range(attempts):
            c = self.config()
            active = self._active(c, places=True)
            if active is None:
                return 0
            found = active.join(ids.select("id").distinct(), "id", "left_semi").select("_file", "_at")
            name = self._write(self._bits(found, c.get("gone")))
            written = self.spark.read.parquet(f"{self.folder}/{name}")
            pages, rows = written.agg(F.count(F.lit(1)), F.sum(F.aggregate("words", F.lit(0), lambda n, w: n + F.bit_count(w)))).first()
            n = (rows or 0) - (c["gone"]["rows"] if c.get("gone") else 0)
            if not n:
                return 0
            entry = {"name": name, "rows": rows, "pages": pages}
            try:
                self._commit(lambda now, c=c, entry=entry: self._unmoved(now, c) | {"gone": entry})
            except Conflict:
                continue  # someone else has deleted, or compacted the files
            self.journal("delete", {"rows": n})
            return n
        raise Conflict(f"{attempts} attempts to delete from {self.folder} came second")

    @staticmethod
    def _unmoved(now: dict, c: dict) -> dict:
        """The manifest, if bitmaps made on c still hold: writes may have come in meanwhile."""
        if now["base"] != c["base"] or now.get("gone") != c.get("gone") or any(w not in now["writes"] for w in c["writes"]):
            raise Conflict("files were compacted, or rows deleted, by someone else")
        return now

    def _bits(self, places: DataFrame, old: dict | None) -> DataFrame:
        """file, page, words: the bitmaps of some places, with those that are there."""
        bit = (F.col("_at") % PAGE).cast("int")
        each = places.select(F.col("_file").alias("file"), F.floor(F.col("_at") / PAGE).cast("int").alias("page"), F.floor(bit / 64).cast("int").alias("w"), (bit % 64).alias("b"))
        words = each.groupBy("file", "page", "w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b"))).alias("x"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(PAGE // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("bigint")))
        new = words.groupBy("file", "page").agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("m")).select("file", "page", dense.alias("words"))
        if not old:
            return new
        both = self.spark.read.parquet(f"{self.folder}/{old['name']}").withColumnRenamed("words", "_old").join(new, ["file", "page"], "full_outer")
        return both.select("file", "page", F.coalesce(F.zip_with("words", "_old", lambda x, y: x.bitwiseOR(y)), "words", "_old").alias("words"))

    def _gone(self, rows: DataFrame, entry: dict | None, name: str = "_gone") -> DataFrame:
        """rows (read from files, with _file and _at) with a column that says whether their bit is set."""
        if not entry:
            return rows.withColumn(name, F.lit(False))
        bits = self.spark.read.parquet(f"{self.folder}/{entry['name']}").select(F.col("file").alias("_file"), F.col("page").alias("_page"), F.col("words").alias("_words"))
        bits = F.broadcast(bits) if entry["pages"] <= PAGES else bits
        keyed = rows.withColumn("_page", F.floor(F.col("_at") / PAGE).cast("int")).join(bits, ["_file", "_page"], "left")
        bit = (F.col("_at") % PAGE).cast("int")
        word = F.element_at("_words", F.floor(bit / 64).cast("int") + 1)
        return keyed.withColumn(name, F.coalesce(F.getbit(word, bit % 64) == 1, F.lit(False))).drop("_page", "_words")

    def _files(self, names: list[str], merge: bool) -> DataFrame:
        """The rows of some folders, with the names of their files and their places in them."""
        rows = self.spark.read.option("mergeSchema", str(merge).lower()).parquet(*[f"{self.folder}/{n}" for n in names])
        return rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))

    def _log(self, writes: list[dict], gone: dict | None, places: bool = False) -> DataFrame:
        """The rows of some writes, with their place among these as seq."""
        names = [w["name"].split("/")[-1] for w in writes]
        rows = self._gone(self._files([w["name"] for w in writes], True), gone)
        rows = rows.withColumn("seq", F.array_position(F.lit(names), F.element_at(F.split("_path", "/"), -2))).withColumn("is_deleted", F.col("is_deleted") | F.col("_gone"))
        return rows.drop("_gone", "_path", *(() if places else ("_file", "_at")))

    def replace_vectors(self, vectors: DataFrame) -> int:
        """New embeddings (id, embedding) for active rows, whose other columns stay; ids that are not active are passed over."""
        active = self.read()
        return 0 if active is None else self.upsert(active.drop("embedding").join(vectors.select("id", "embedding"), "id"))

    def _base(self, c: dict, places: bool = False) -> DataFrame | None:
        if not c["base"]:
            return None
        if not places and not c.get("gone"):
            return self.spark.read.parquet(f"{self.folder}/{c['base']['name']}").drop("is_deleted")
        rows = self._gone(self._files([c["base"]["name"]], False), c.get("gone")).filter(~F.col("_gone"))
        return rows.drop("is_deleted", "_gone", "_path", *(() if places else ("_file", "_at")))

    def _active(self, c: dict, places: bool = False) -> DataFrame | None:
        """The base (each id once) with the writes on top. places: with _file and _at."""
        base, writes = self._base(c, places), c["writes"]
        if not writes:
            return base
        log = self._log(writes, c.get("gone"), places)
        if base is None:
            return latest(log)
        ids = log.select("id").distinct()
        ids = F.broadcast(ids) if sum(w["rows"] for w in writes) <= DELTA else ids
        return base.join(ids, "id", "left_anti").unionByName(latest(log), allowMissingColumns=True)

    def read(self) -> DataFrame | None:
        """The active rows; None if nothing was ever written."""
        c = self.config()
        return self._active(c) if c else None

    def get(self, id) -> DataFrame | None:
        rows = self.read()
        return None if rows is None else rows.filter(F.col("id") == id)

    def compact(self) -> None:
        """Active rows become the base. Writes that come in meanwhile stay writes; tables of an index stay if they cover what was compacted."""
        c = self.config()
        active = self.read()
        if active is None or not (c["writes"] or c.get("gone")):
            return
        entry = {"name": self._write(active.withColumn("is_deleted", F.lit(False))), "rows": active.count()}
        done = [w["name"] for w in c["writes"]]

        def change(now):
            self._unmoved(now, c)
            covered = lambda t: set(done) <= set(t["writes"]) and t.get("gone") == c.get("gone")
            tables = {k: t | {"writes": [w for w in t["writes"] if w not in done], "gone": None} for k, t in now["tables"].items() if covered(t)}
            return now | {"base": entry, "writes": [w for w in now["writes"] if w["name"] not in done], "gone": None, "tables": tables}

        self._commit(change)
        self.journal("compact", {"rows": entry["rows"]})

    def switch_index(self, index: str, **params) -> None:
        """Changes the access path; parameters of the former one go."""
        self._index(index)
        self._commit(lambda c: c | {"index": index, "params": params})
        self.journal("switch_index", {"index": index, **params})

    def write_table(self, rows: DataFrame, by: str | None = None) -> tuple[str, DataFrame]:
        """A table for keep(): its name, and what was written."""
        name = self._write(rows, by)
        return name, self.spark.read.parquet(f"{self.folder}/{name}")

    def keep(self, name: str, c: dict, by: dict[str, str] | None = None, **tables: DataFrame | str) -> None:
        """Stores what was made of the rows of the manifest c: cells, graphs, codebooks, or names of tables that have been written.
        by: the column that a table's folders are named by."""
        by = by or {}
        entry = {"tables": {k: t if isinstance(t, str) else self._write(t, by.get(k)) for k, t in tables.items()}, "writes": [w["name"] for w in c["writes"]], "gone": c.get("gone")}
        self._commit(lambda now: now | {"tables": now["tables"] | {name: entry}})
        self.journal("keep", {"name": name})

    def kept(self, name: str) -> dict[str, DataFrame] | None:
        """The tables stored under a name; None if there are none."""
        t = (self.config() or {"tables": {}})["tables"].get(name)
        return {k: self.spark.read.parquet(f"{self.folder}/{f}") for k, f in t["tables"].items()} if t else None

    def forget(self, name: str) -> None:
        self._commit(lambda c: c | {"tables": {k: t for k, t in c["tables"].items() if k != name}})

    def since(self, name: str) -> list[dict]:
        """The writes that the tables stored under a name know nothing of."""
        c = self.config()
        covered = set(c["tables"][name]["writes"])
        return [w for w in c["writes"] if w["name"] not in covered]

    def later(self, name: str) -> tuple[DataFrame | None, DataFrame | None]:
        """The ids that writes and deletes have touched since the tables stored under a name were made, and the active rows of the writes;
        (None, None) if there are none."""
        c, writes = self.config(), self.since(name)
        old, new = c["tables"][name].get("gone"), c.get("gone")
        if not writes and old == new:
            return None, None
        n = sum(w["rows"] for w in writes)
        log = self._log(writes, new) if writes else None
        ids = log.select("id") if writes else None
        if old != new:
            names = [w["name"] for w in ([c["base"]] if c["base"] else []) + c["writes"]]
            dead = self._gone(self._gone(self._files(names, True).select("id", "_file", "_at"), new), old, "_before").filter("_gone and not _before").select("id")
            ids = dead if ids is None else ids.unionByName(dead)
            n += new["rows"] - (old["rows"] if old else 0)
        ids = ids.distinct()
        return F.broadcast(ids) if n <= DELTA else ids, latest(log) if writes else self.read().limit(0)

    def on_top(self, rows: DataFrame, name: str, derive) -> DataFrame:
        """rows of a kept table with later writes on top; derive adds to the rows of these what was derived for the table."""
        ids, later = self.later(name)
        return rows if ids is None else rows.join(ids, "id", "left_anti").unionByName(derive(later), allowMissingColumns=True)

    def journal(self, op: str, data: dict) -> None:
        """A line for people to read; nothing is ever replayed from it."""
        line = json.dumps({"at": datetime.now(UTC).isoformat(), "op": op, "data": data}, sort_keys=True, default=str)
        out = self._fs.create(self._path(f"{self.folder}/journal/{uuid.uuid4().hex}.json"), False)
        out.write(bytearray(line.encode() + b"\n"))
        out.close()

    def import_snapshot(self, folder: str) -> int:
        """Upserts the active rows of a snapshot in the older layout: vectors.npy, deleted.npy and metadata.jsonl, a line (id and
        metadata) for each vector. All three are read in ranges and joined by their place; of an id that comes twice the last row stays.
        Values of a key that differ in type become texts, nested ones JSON."""
        folder = folder.rstrip("/")
        path = {x: f"{folder}/{x}" for x in ("vectors.npy", "deleted.npy", "metadata.jsonl")}
        lines = numbered_lines(self.spark, path["metadata.jsonl"])
        counts = [vectors.layout(path["vectors.npy"]).rows, vectors.layout(path["deleted.npy"]).rows, lines.count()]
        if len(set(counts)) > 1:
            raise InvalidVectors("the snapshot has {} vectors, {} marks and {} lines of metadata".format(*counts))
        if not counts[0]:
            return 0
        schema = self.spark.read.option("mode", "FAILFAST").json(path["metadata.jsonl"]).schema
        row = lines.select("pos", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x"))
        own = schema["metadata"].dataType.fields if "metadata" in schema.names and isinstance(schema["metadata"].dataType, T.StructType) else []
        top = [f for f in schema if f.name not in ("id", "metadata")]
        columns = {}
        for where, fields in (("x.metadata", own), ("x", top)):
            for f in fields:
                c = F.col(f"{where}.`{f.name}`")
                c = F.to_json(c) if isinstance(f.dataType, T.StructType | T.ArrayType) else c
                columns.setdefault(f.name, []).append(F.when(F.col("x.metadata").isNotNull() == (where != "x"), c) if own else c)
        columns = {k: F.coalesce(*some) if len(some) < 2 or own else some[0] for k, some in columns.items() if k not in ("id", "embedding")}
        matrix = vectors.load(self.spark, path["vectors.npy"]).select("pos", "embedding")
        alive = vectors.load(self.spark, path["deleted.npy"]).filter(F.col("embedding")[0] == 0).select("pos")
        rows = matrix.join(alive, "pos").join(row.select("pos", F.col("x.id").alias("id"), *[c.alias(k) for k, c in columns.items()]), "pos")
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("pos")))
        return self.upsert(rows.withColumn("_r", last).filter("_r = 1").select("id", "embedding", *[f"`{k}`" for k in columns]))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, value of the lines of one file that are not blank. Lines are numbered within the blocks that tasks read; what is added up in
    order are only the blocks' counts."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    blocks = lines.groupBy("_block").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(F.broadcast(blocks.withColumn("_before", before)), "_block").select((F.col("_before") + F.col("_n") - F.col("_first")).alias("pos"), "value")


def collection_stats(rows: DataFrame) -> DataFrame:
    """One row: count, dim, raw_kb (32-bit floats)."""
    dim = F.coalesce(F.max(F.size("embedding")), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("count"), dim.cast("bigint").alias("dim"), (F.count(F.lit(1)) * dim * 4 / 1024.0).alias("raw_kb"))
