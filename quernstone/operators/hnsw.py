"""Layered proximity graphs, one per shard, and their search.

Graph search follows pointers and is not relational, so a graph lives inside one task: vectors are dealt to shards of bounded size, each shard
builds its own graph, every query searches every shard, and the shards' results are ranked together. Nodes and edges are plain tables, so a graph
is stored, inspected and rebuilt like any other data. Removed rows keep routing but are not returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.filters import compile_filter
from . import knn

#: Rows of a shard. A graph is built by one task, row by row, so shards are small enough for a table of some ten thousand rows to be dealt out.
SHARD_ROWS = 8_192
#: Queries that are worth loading a shard for.
LEAST_QUERIES = 256


@dataclass
class Graph:
    """m links a node (m0 on the lowest layer); ``links[layer][node]`` are sets of node numbers."""

    dim: int
    metric: str = "cosine"
    m: int = 16
    m0: int | None = None
    ef_build: int = 64
    seed: int = 0
    select: str = "spread"  # or nearest
    extend: bool = False
    refill: bool = True
    levels: list[int] = field(default_factory=list)
    links: list[dict[int, set[int]]] = field(default_factory=list)
    entry: int = -1

    def __post_init__(self):
        if self.select not in ("spread", "nearest"):
            raise ValueError(f"unknown selection {self.select!r}")
        self.m0 = self.m0 or 2 * self.m
        self.rng = np.random.default_rng(self.seed)
        self.data = np.zeros((16, self.dim))

    def gaps(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        rows = self.data[nodes]
        if self.metric == "cosine":
            return np.maximum(0.0, 1.0 - rows @ q)
        if self.metric == "dot":
            return -(rows @ q)
        d = rows - q
        return np.abs(d).sum(1) if self.metric == "manhattan" else np.sqrt((d * d).sum(1))

    def prepared(self, v) -> np.ndarray:
        v = np.asarray(v, np.float64)
        return v / max(np.linalg.norm(v), V.EPSILON) if self.metric == "cosine" else v

    def beam(self, q: np.ndarray, starts: list[int], ef: int, layer: int, accept=None) -> list[tuple[float, int]]:
        """Up to ef (distance, node), nearest first, found in rounds: a round opens all nodes of the one before that are not farther
        than the worst result so far. accept only says what may be a result, not what may be walked over."""
        links = self.links[layer]
        seen, new = set(starts), sorted(starts)
        nodes, gaps = np.zeros(0, np.int64), np.zeros(0)
        while new:
            e = self.gaps(q, new)
            fine = np.array([accept(n) for n in new], bool) if accept else slice(None)
            nodes, gaps = np.concatenate((nodes, np.array(new)[fine])), np.concatenate((gaps, e[fine]))
            order = np.lexsort((nodes, gaps))[:ef]
            nodes, gaps = nodes[order], gaps[order]
            limit = gaps[-1] if len(gaps) == ef else np.inf
            opened = [n for n, d in zip(new, e.tolist(), strict=True) if d <= limit]
            new = sorted(set().union(*[links.get(n, ()) for n in opened]) - seen)
            seen.update(new)
        return list(zip(gaps.tolist(), nodes.tolist(), strict=True))

    def descend(self, q: np.ndarray, down_to: int, trace: list | None = None) -> int:
        """From the entry, the nearest node that greedy steps find on the layer above down_to."""
        now = self.entry
        d = float(self.gaps(q, [now])[0])
        if trace is not None:
            trace.append((self.levels[now], "entry", None, now, d))
        for layer in range(self.levels[self.entry], down_to, -1):
            while True:
                near = sorted(self.links[layer].get(now, ()))
                if not near:
                    break
                e = self.gaps(q, near)
                i = int(e.argmin())
                if e[i] >= d:
                    break
                if trace is not None:
                    trace.append((layer, "hop", now, near[i], float(e[i])))
                now, d = near[i], float(e[i])
            if trace is not None:
                trace.append((layer - 1, "descend", now, now, d))
        return now

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, nearest first, those nearer to the new node than to any chosen one; then, with refill, the nearest of the
        others. With select="nearest" just the nearest."""
        if self.select == "nearest":
            return [n for _, n in found[:most]]
        chosen, rest = [], []
        for d, n in found:
            if len(chosen) == most:
                break
            if not chosen or (self.gaps(self.data[n], chosen) > d).all():
                chosen.append(n)
            else:
                rest.append(n)
        return chosen + (rest[: most - len(chosen)] if self.refill else [])

    def extended(self, q: np.ndarray, found: list[tuple[float, int]], layer: int) -> list[tuple[float, int]]:
        """The candidates and their neighbours."""
        nodes = sorted({n for _, n in found}.union(*[self.links[layer].get(n, ()) for _, n in found]))
        return sorted(zip(self.gaps(q, nodes).tolist(), nodes, strict=True)) if nodes else []

    def add(self, v) -> int:
        q = self.prepared(v)
        n = len(self.levels)
        if n == len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        self.data[n] = q
        level = int(-math.log(max(self.rng.random(), 1e-9)) / math.log(self.m)) if self.m > 1 else 0
        self.levels.append(level)
        while len(self.links) <= level:
            self.links.append({})
        for layer in range(level + 1):
            self.links[layer][n] = set()
        if self.entry < 0:
            self.entry = n
            return n
        top = self.levels[self.entry]
        starts = [self.descend(q, min(level, top))]
        for layer in range(min(level, top), -1, -1):
            found = self.beam(q, starts, self.ef_build, layer)
            most = self.m0 if layer == 0 else self.m
            candidates = [c for c in self.extended(q, found, layer) if c[1] != n] if self.extend else found
            for x in self.spread(candidates, self.m):
                self.links[layer][n].add(x)
                own = self.links[layer][x]
                own.add(n)
                if len(own) > most:
                    others = sorted(own)
                    ranked = sorted(zip(self.gaps(self.data[x], others).tolist(), others, strict=True))
                    keep = set(self.spread(ranked, most))
                    for y in own - keep:
                        self.links[layer][y].discard(x)
                    self.links[layer][x] = keep
            starts = [x for _, x in found]
        if level > top:
            self.entry = n
        return n

    def search(self, v, k: int, ef: int, accept=None, active: int | None = None) -> list[tuple[float, int]]:
        """ef doubles until k rows are accepted or it covers all active rows."""
        if self.entry < 0:
            return []
        q = self.prepared(v)
        ef, active = max(ef, k), active if active is not None else len(self.levels)
        start = [self.descend(q, 0)]
        while True:
            found = self.beam(q, start, ef, 0, accept)
            if len(found) >= k or ef >= active:
                return found[:k]
            ef *= 2


NODES = "shard int, node int, id {id}, level int, is_deleted boolean, is_entry boolean, embedding array<double>"
STEPS = "shard int, step int, layer int, type string, from_id {id}, to_id {id}, distance double"
EDGES = "shard int, layer int, src int, dst int"


def _build(rows: pd.DataFrame, how: dict) -> Graph:
    g = Graph(dim=len(rows["embedding"].iloc[0]), **how)
    for v in rows["embedding"]:
        g.add(v)
    return g


def shard_count(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
    return max(1, -(-vectors.count() // shard_rows))


def _sharded(vectors: DataFrame, shards: int) -> DataFrame:
    deleted = F.coalesce("is_deleted", F.lit(False)) if "is_deleted" in vectors.columns else F.lit(False)
    return vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", V.as_double(F.col("embedding")).alias("embedding"), deleted.alias("is_deleted"))


def build(vectors: DataFrame, shards: int | None = None, **how) -> DataFrame:
    """Nodes with their links: shard, node, id, level, is_deleted, is_entry, embedding, links (layer -> nodes). how: metric, m, m0, ef_build, seed, select, extend, refill."""
    kind = dict(vectors.dtypes)["id"]

    def run(key, rows):
        rows = rows.sort_values("id").reset_index(drop=True)
        g = _build(rows, how)
        rows["node"], rows["level"] = np.arange(len(rows)), g.levels
        rows["is_entry"] = rows["node"] == g.entry
        rows["links"] = [[sorted(g.links[y][n]) for y in range(g.levels[n] + 1)] for n in range(len(rows))]
        return rows[["shard", "node", "id", "level", "is_deleted", "is_entry", "embedding", "links"]]

    shards = shards or shard_count(vectors)
    # Each shard is a partition: adaptive execution, or a hash of its number, would put several, which are few bytes but long work, into one task.
    return _sharded(vectors, shards).repartitionById(shards, "shard").groupBy("shard").applyInPandas(run, NODES.format(id=kind) + ", links array<array<int>>")


def edges(graph: DataFrame) -> DataFrame:
    """shard, layer, src, dst."""
    per_layer = graph.select("shard", F.col("node").alias("src"), F.posexplode("links").alias("layer", "to"))
    return per_layer.select("shard", "layer", "src", F.explode("to").alias("dst"))


def _load(rows: pd.DataFrame, how: dict) -> Graph:
    g = Graph(dim=len(rows["embedding"].iloc[0]), **how)
    g.data = np.array([g.prepared(v) for v in rows["embedding"]])
    g.levels = rows["level"].astype(int).tolist()
    g.links = [{} for _ in range(max(g.levels) + 1)]
    for n, layers in enumerate(rows["links"]):
        for y, near in enumerate(layers):
            g.links[y][n] = {int(x) for x in near}
    g.entry = int(np.flatnonzero(rows["is_entry"])[0])
    return g


def search(graph: DataFrame, queries: DataFrame, k: int = 10, ef: int = 32, metric: str = "cosine", query_filter: dict | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """qid, id, rank, distance, score. Queries go in blocks to all shards.

    With a filter, vectors holds the columns it names; where at most 50 rows or less than 1 % match, the exact search takes over.
    """
    graph = graph.withColumn("accepted", ~F.col("is_deleted"))
    if query_filter:
        match = vectors.filter(compile_filter(query_filter, vectors.schema)).select("id")
        n, total = match.count(), vectors.count()
        if n <= 50 or n < 0.01 * total:
            return knn.batch_search(vectors, queries, k, metric, query_filter)
        graph = graph.join(match.withColumn("_m", F.lit(True)), "id", "left").withColumn("accepted", F.col("accepted") & F.coalesce("_m", F.lit(False))).drop("_m")
    kinds = {"id": dict(graph.dtypes)["id"], "qid": dict(queries.dtypes)["qid"]}
    local = None

    def walk(asked):
        def run(key, rows):
            rows = rows.sort_values("node").reset_index(drop=True)
            g = _load(rows, {"metric": metric})
            fine = rows["accepted"].to_numpy(bool)
            active = int((~rows["is_deleted"].to_numpy(bool)).sum())
            ids = rows["id"].tolist()
            out = [(qid, ids[n], d) for qid, v in zip(*asked.value, strict=True) for d, n in g.search(v, k, ef, lambda n: fine[n], active)]
            return pd.DataFrame(out, columns=["qid", "id", "distance"])

        return run

    # A shard's task walks for all queries it is given; where there are few shards the queries are dealt to as many tasks as there are cores.
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    each = max(LEAST_QUERIES, -(-n // graph.sparkSession.sparkContext.defaultParallelism))
    for block in knn.passes(queries, min(knn.PASS_BYTES, each * 8 * (dim or 1))):
        asked = graph.sparkSession.sparkContext.broadcast(block)
        part = graph.groupBy("shard").applyInPandas(walk(asked), f"qid {kinds['qid']}, id {kinds['id']}, distance double")
        local = part if local is None else local.unionByName(part)
    if local is None:
        return knn.batch_search(graph.select("id", "embedding").limit(0), queries, k, metric)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("distance", 12), "id")).cast("bigint")
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "id", "rank", "distance", V.score(F.col("distance"), metric).alias("score"))


def trace(graph: DataFrame, query: list[float], k: int = 5, ef: int = 32, metric: str = "cosine") -> DataFrame:
    """shard, step, layer, type (entry, hop, descend, beam_candidate), from_id, to_id, distance: how one query walks each shard."""
    kind = dict(graph.dtypes)["id"]

    def run(key, rows):
        rows = rows.sort_values("node").reset_index(drop=True)
        g, steps = _load(rows, {"metric": metric}), []
        q = g.prepared(query)
        start = g.descend(q, 0, steps)
        gone = rows["is_deleted"].to_numpy(bool)
        for d, n in g.beam(q, [start], max(ef, k), 0, lambda n: not gone[n]):
            steps.append((0, "beam_candidate", start, n, d))
        ids = rows["id"].tolist()
        name = lambda n: None if n is None else ids[n]
        return pd.DataFrame([(key[0], i, layer, what, name(a), name(b), d) for i, (layer, what, a, b, d) in enumerate(steps)], columns=["shard", "step", "layer", "type", "from_id", "to_id", "distance"])

    return graph.groupBy("shard").applyInPandas(run, STEPS.format(id=kind))


def topology(graph: DataFrame, max_nodes: int = 40) -> DataFrame:
    """shard, layer, a, b: links (each once) between the nodes shown, which are all active ones above the lowest layer, and from the entry
    on, nearest layers of neighbours first, others until there are max_nodes."""

    def run(key, rows):
        rows = rows.sort_values("node").reset_index(drop=True)
        g, gone = _load(rows, {}), rows["is_deleted"].to_numpy(bool)
        shown = {n for n, y in enumerate(g.levels) if y >= 1 and not gone[n]}
        todo, seen = [g.entry], {g.entry}
        while todo and len(shown) < max_nodes:
            n = todo.pop(0)
            if not gone[n]:
                shown.add(n)
            new = [x for x in sorted(g.links[0].get(n, ())) if x not in seen]
            seen.update(new)
            todo += new
        found = sorted({(y, min(a, b), max(a, b)) for y, layer in enumerate(g.links) for a in layer if a in shown for b in layer[a] if b in shown})
        return pd.DataFrame([(key[0], *x) for x in found], columns=["shard", "layer", "a", "b"])

    return graph.groupBy("shard").applyInPandas(run, "shard int, layer int, a int, b int")
