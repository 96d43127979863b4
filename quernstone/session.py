"""The engine as one object: what an application calls."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import chunk, embed, fusion, hnsw, ivf, knn, metrics, postings, project, quantize, rag, rerank, sweep
from .plans.filters import compile_filter
from .sources import corpus, files, synthetic
from .sources.store import Store, collection_stats
from .streaming.ingest import chunk_rows

#: From this share (or number) of matching rows down, an exact scan of the matches beats an index.
FEW_ROWS, FEW_SHARE = 50, 0.01
#: The first range of documents that are indexed beside the stored lexical index.
LATER = 1 << 40


class Engine:
    """Search over one store. Queries come and go as DataFrames; qid names a query.

    model: texts to a matrix; a deterministic stand-in if not given. embeddings: a cache of what the model has made of texts, so that texts
    that are ingested again are not embedded again.
    """

    def __init__(self, store: Store, model: Callable[[list[str]], np.ndarray] | None = None, embeddings: embed.Cache | None = None):
        self.store, self.model, self.embeddings = store, model, embeddings
        self.spark: SparkSession = store.spark
        self.cache = rag.QueryCache()
        self._derived: dict = {}

    # What is derived from the rows for this session only; a write forgets it. Trained tables are kept in the store.
    def _once(self, name: str, make):
        if name not in self._derived:
            self._derived[name] = make()
        return self._derived[name]

    def _changed(self) -> None:
        for x in self._derived.values():
            for df in x if isinstance(x, tuple) else [x]:
                if isinstance(df, DataFrame):
                    df.unpersist()
        self._derived.clear()
        self.cache.clear()

    def rows(self) -> DataFrame:
        rows = self.store.read()
        if rows is None:
            raise LookupError("the collection is empty")
        return rows

    def ingest(self, docs: DataFrame, strategy: str = "semantic", size: int = 600, overlap: int = 1) -> int:
        """docs: doc_id, text, and metadata. Writing the same text again changes nothing. How many rows were written."""
        if strategy == "fixed" and overlap >= size:
            raise ValueError("overlap must be less than size")
        n = self.store.upsert(chunk_rows(docs, self.model, strategy, size, overlap, self.embeddings))
        self._changed()
        return n

    def ingest_files(self, path: str, strategy: str = "semantic", size: int = 600, overlap: int = 1) -> int:
        """Files of the known kinds under a path or glob, at most 10 MB each; PDFs page by page."""
        if not 50 <= size <= 10_000:
            raise ValueError("size must be between 50 and 10,000")
        docs = files.load_uploads(self.spark, path)
        named = docs.select(F.col("source").alias("doc_id"), "text", "title", "file_path", "file_type", "page")
        return self.ingest(named, strategy, size, overlap)

    def seed(self) -> int:
        """Ingests the bundled corpus."""
        return self.ingest(corpus.documents(self.spark), "sentence", 300, 1)

    def upsert(self, rows: DataFrame) -> None:
        self.store.upsert(rows)
        self._changed()

    def delete(self, ids: DataFrame) -> int:
        n = self.store.delete(ids)
        self._changed()
        return n

    def compact(self) -> None:
        self.store.compact()
        self._changed()

    def switch_index(self, index: str, **params) -> None:
        """Another access path; what was trained for one of other parameters is trained anew when it is next used."""
        self.store.switch_index(index, **params)
        for name in ("ivf", "hnsw"):
            self.store.forget(name)
        self._changed()

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        return embed.embed(queries, model=self.model)

    def dense(self, queries: DataFrame, k: int = 10, query_filter: dict | None = None, **params) -> DataFrame:
        """queries: qid, and embedding or text. The access path is the store's, or exact where a filter leaves few rows."""
        if "embedding" not in queries.columns:
            queries = self.embed_queries(queries)
        c, rows = self.store.config(), self.rows()
        index, metric, params = c["index"], c["metric"], c["params"] | params
        if query_filter and index != "flat":
            f = compile_filter(query_filter, rows.schema)
            n, total = rows.agg(F.count_if(f), F.count(F.lit(1))).first()
            index = "flat" if n <= FEW_ROWS or n < FEW_SHARE * total else index
        if index == "ivf":
            cells, assigned = self.cells(metric, params.get("nlist", 16))
            return ivf.search(assigned, queries, cells, k, params.get("nprobe", 4), metric, query_filter).drop("cluster")
        if index == "hnsw":
            return self._walk(queries, k, params.get("ef_search", 32), metric, query_filter, rows)
        return knn.batch_search(rows, queries, k, metric, query_filter)

    def dense_with_trace(self, query: list[float], k: int = 5, **params) -> tuple[DataFrame, DataFrame]:
        """The rows nearest to one vector, and how the search went: the steps in the graph, none for other access paths."""
        asked = self.spark.createDataFrame([(0, query)], "qid int, embedding array<double>")
        steps = self.hnsw_trace(query, k, params.get("ef_search", 32)) if self.store.config()["index"] == "hnsw" else self.spark.createDataFrame([], hnsw.STEPS.format(id="string"))
        return self.dense(asked, k, **params), steps

    def cells(self, metric: str, nlist: int) -> tuple[DataFrame, DataFrame]:
        """Cells, and the active rows with theirs. Cells are trained once and kept in the store, with the rows in folders by cell; rows
        written later are assigned to them, and the cells never move."""
        if self.store.kept("ivf") is None:
            c = self.store.config()
            rows = self.rows()
            trained = ivf.train(rows, nlist, metric)
            self.store.keep("ivf", c, {"rows": "cluster"}, cells=trained, rows=ivf.assign(rows, trained, metric))
        kept = self.store.kept("ivf")
        return kept["cells"], self.store.on_top(kept["rows"], "ivf", lambda later: ivf.assign(later, kept["cells"], metric))

    def graph(self) -> DataFrame:
        """The nodes of the graph, kept in the store. Rows written later are no part of it."""
        if self.store.kept("hnsw") is None:
            c = self.store.config()
            how = {x: c["params"][x] for x in ("m", "m0", "ef_build", "seed", "select", "extend", "refill") if x in c["params"]}
            self.store.keep("hnsw", c, nodes=hnsw.build(self.rows(), metric=c["metric"], **how))
        return self.store.kept("hnsw")["nodes"]

    def _walk(self, queries: DataFrame, k: int, ef: int, metric: str, query_filter: dict | None, rows: DataFrame) -> DataFrame:
        """The graph's nearest rows and, exactly, those of later writes; nodes that these have replaced are walked over, not returned."""
        graph = self.graph()
        ids, later = self.store.later("hnsw")
        if ids is not None:
            graph = graph.join(ids.withColumn("_gone", F.lit(True)), "id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")
        found = hnsw.search(graph, queries, k, ef, metric, query_filter, rows)
        if ids is None:
            return found
        both = found.drop("rank").unionByName(knn.batch_search(later, queries, k, metric, query_filter).drop("rank"))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("distance", 12), "id")).cast("bigint")
        return both.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "id", "rank", "distance", "score")

    def lexical(self) -> tuple[postings.Postings, DataFrame | None]:
        """The lexical index, and which of its documents are no longer there. It is built once and kept in the store; rows written later are
        indexed beside it, for this session."""
        if self.store.kept("lexical") is None:
            c, rows, names = self.store.config(), self.rows(), {}

            def write(name: str, df: DataFrame, by: str | None) -> DataFrame:
                names[name], written = self.store.write_table(df, by)
                return written

            made = postings.stored(rows, [x for x in rows.columns if x not in ("id", "text", "embedding")], write)
            about = self.spark.createDataFrame([(made.k1, made.b, made.reference)], "k1 double, b double, reference double")
            self.store.keep("lexical", c, about=about, **names)

        def make():
            kept = self.store.kept("lexical")
            about = kept["about"].first()
            index = postings.Postings(kept["docs"], kept["blocks"], about.k1, about.b, about.reference)
            ids, later = self.store.later("lexical")
            if ids is None:
                return index, None
            gone = index.docs.join(ids, "id", "left_semi").select("_range", "_slot").persist()
            docs = postings.documents(later, [x for x in later.columns if x not in ("id", "text", "embedding")]).persist()
            return index.union(postings.Postings(docs, postings.blocks(docs, about.reference, about.k1, about.b)), LATER), gone

        return self._once("lexical", make)

    def bm25(self, queries: DataFrame, k: int = 10, query_filter: dict | None = None, prune: bool = False) -> DataFrame:
        """prune: for few queries over many documents; see postings."""
        index, gone = self.lexical()
        return postings.search(index, queries, k, query_filter=query_filter, gone=gone, prune=prune)

    def hybrid(self, queries: DataFrame, k: int = 10, method: str = "rrf", alpha: float = fusion.ALPHA, rrf_k: int = fusion.RRF_K, multiplier: int = 2, query_filter: dict | None = None) -> DataFrame:
        pool = fusion.pool_size(k, multiplier)
        fused = fusion.fuse(self.dense(queries, pool, query_filter), self.bm25(queries, pool, query_filter), k, method, alpha, rrf_k)
        return fused.join(self.rows().drop("embedding"), "id")

    def rerank(self, queries: DataFrame, top_k: int = 5, initial_k: int = 20, min_score: float | None = None, model=None, query_filter: dict | None = None) -> DataFrame:
        found = self.hybrid(queries, initial_k, query_filter=query_filter).join(queries.select("qid", F.col("text").alias("query")), "qid")
        return rerank.rerank(found, top_k, min_score, model)

    def context(self, queries: DataFrame, top_k: int = 5, min_score: float | None = None, use_rerank: bool = True, query_filter: dict | None = None) -> DataFrame:
        initial = max(2 * top_k, 10)
        if use_rerank:
            found = self.rerank(queries, top_k, initial, min_score, query_filter=query_filter)
        else:
            found = self.hybrid(queries, top_k, query_filter=query_filter).join(queries.select("qid", F.col("text").alias("query")), "qid")
            found = found if min_score is None else found.filter(F.col("score") >= min_score)
        return found.withColumn("pos", F.col("rank"))

    def ask(self, queries: DataFrame, providers: list[rag.Provider] | None = None, **how) -> dict[str, DataFrame]:
        """answers, citations and grounding of a batch of questions.

        providers: (name, function from a prompt to text) of generators, tried in turn on the executors; questions that none of
        them answers get sentences of the sources. The answer's provider is named, ``extractive`` for the latter.
        """
        context = self.context(queries, **how).persist()
        found = queries.select("qid", F.col("text").alias("query")).join(rag.answers(context), "qid", "left")
        gate = F.concat(F.lit("Nothing relevant was found on '"), F.col("query"), F.lit("'."))
        answered = found.select("qid", F.coalesce("answer", gate).alias("answer"), F.lit("extractive").alias("provider"))
        if providers:
            made = rag.generated(rag.prompts(context), providers).withColumnRenamed("provider", "_by").persist()
            answered = answered.join(made, "qid", "left").select("qid", F.coalesce("generated", "answer").alias("answer"), F.coalesce("_by", "provider").alias("provider"))
        return {"answers": answered, "citations": rag.citations(context, answered), "grounding": rag.grounding(context, answered)}

    def ask_one(self, question: str, **how) -> dict:
        """One question, from the cache if it was asked before."""
        request = {"question": question, **how}
        known = self.cache.get(request)
        if known is None:
            out = self.ask(self.spark.createDataFrame([(0, question)], "qid int, text string"), **how)
            known = {"answer": out["answers"].first().answer, "citations": [r.asDict() for r in out["citations"].orderBy("pos").collect()]}  # at most top_k rows
            self.cache.put(request, known)
        return known

    def evaluate(self, questions: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
        """questions: qid, text; truth: qid, id, where id is the source of a right row."""
        found = self.hybrid(questions, k).select("qid", "rank", F.col("source").alias("id"))
        return metrics.summary(metrics.judged(found, truth, questions))

    def quantize(self, kind: str = "scalar", parts: int = 8, clusters: int = 256) -> DataFrame:
        rows = self.rows().select("id", "embedding")
        dim = self.store.config()["dim"]
        if kind == "scalar":
            p = quantize.scalar_params(rows)
            return quantize.error_stats(quantize.scalar_decode(quantize.scalar_encode(rows, p), p), float(dim))
        if kind != "product":
            raise ValueError(f"unknown quantizer {kind!r}")
        if dim % parts:
            raise ValueError(f"{parts} parts do not divide {dim} dimensions")
        name = f"codebook-{parts}-{clusters}"
        if self.store.kept(name) is None:
            self.store.keep(name, self.store.config(), book=quantize.product_train(rows, parts, clusters))
        book = self.store.kept(name)["book"]
        return quantize.error_stats(quantize.product_decode(quantize.product_encode(rows, book), book), float(parts))

    def compare_chunking(self, docs: DataFrame) -> DataFrame:
        return chunk.compare(docs, self.model or embed.stand_in)

    def project(self) -> tuple[DataFrame, project.Projection | None]:
        model = self._once("projection", lambda: project.fit(self.rows()))
        return (project.points(self.rows(), model) if model else self.rows()), model

    def project_query(self, query: list[float], k: int = 5) -> dict:
        """x and y of a vector on the map, and its k nearest rows with their places."""
        placed, model = self.project()
        near = self.dense(self.spark.createDataFrame([(0, query)], "qid int, embedding array<double>"), k).drop("qid")
        if model is None:
            return {"x": 0.0, "y": 0.0, "neighbours": near}
        q = [sum((x - m) * a for x, m, a in zip(query, model.mean, axis, strict=True)) for axis in model.axes]
        x, y = (round((v - mid) * model.scale, 2) for v, mid in zip(q, model.middle, strict=True))
        return {"x": x, "y": y, "neighbours": near.join(placed, "id")}

    def benchmark(self, n: int = 1000, queries: int = 50, k: int = 10, nlist: int = 16, probes: tuple[int, ...] = (1, 4, 8, 16), efs: tuple[int, ...] = (16, 32, 64), m: int = 16, seed: int = 42) -> list[dict]:
        """Recall, time and queries per second of exact, cell and graph search, over nprobe and ef, on made-up vectors of the store's
        dimension and metric. The store is not touched."""
        c = self.store.config()
        dim, metric = c["dim"], c["metric"]
        rows = synthetic.clustered(self.spark, n, dim, seed=seed).persist()
        asked = synthetic.clustered(self.spark, queries, dim, seed=seed, first=n).select(F.col("id").alias("qid"), "embedding").persist()
        exact = knn.batch_search(rows, asked, k, metric).persist()
        exact.count()
        cells = ivf.train(rows, nlist, metric)
        assigned = ivf.assign(rows, cells, metric).persist()
        graph = hnsw.build(rows, metric=metric, m=m, seed=seed).persist()
        ways = {"exact": lambda: knn.batch_search(rows, asked, k, metric)}
        ways |= {f"ivf nprobe={p}": lambda p=p: ivf.search(assigned, asked, cells, k, p, metric) for p in probes}
        ways |= {f"hnsw ef={e}": lambda e=e: hnsw.search(graph, asked, k, e, metric) for e in efs}
        assigned.count(), graph.count()
        out = sweep.measure(ways, exact, queries, k)
        for x in (rows, asked, exact, assigned, graph):
            x.unpersist()
        return out

    def hnsw_topology(self, max_nodes: int = 40) -> DataFrame:
        return hnsw.topology(self.graph(), max_nodes)

    def hnsw_trace(self, query: list[float], k: int = 5, ef: int = 32) -> DataFrame:
        return hnsw.trace(self.graph(), query, k, ef, self.store.config()["metric"])

    def stats(self) -> dict:
        c = self.store.config()
        return {"index": c["index"], "metric": c["metric"], **collection_stats(self.rows()).first().asDict(), "cache": self.cache.stats()}

    def cache_stats(self) -> dict:
        return self.cache.stats()

    def clear_cache(self) -> None:
        self.cache.clear()
