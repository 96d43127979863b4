"""Extractive answers with citations over retrieved chunks, for batches of questions."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import rounded

#: Between sentences of an answer, whatever follows.
GAP = r"(?<=[.?!])\s+"
CONTEXT, PER_CHUNK, LEAST_CHARS = 5, 2, 20


def findings(context: DataFrame) -> DataFrame:
    """qid, pos, place, sentence: the sentences an answer is made of.

    context: qid, query, pos (1 is the best chunk), text, score, and rerank_score if there is one. Of the first five chunks, those with a rerank
    score below 0.05 are left out; of the others the two sentences that share most distinct words with the question, or else the first sentence if
    the chunk's score is 0.2 or more.
    """
    rescored = F.col("rerank_score") if "rerank_score" in context.columns else F.lit(None).cast("double")
    rows = context.withColumn("_re", rescored).filter((F.col("pos") <= CONTEXT) & (F.col("_re").isNull() | (F.col("_re") >= 0.05)))
    parts = rows.select("qid", "pos", X.terms(F.col("query"), 3).alias("q"), F.coalesce("_re", "score", F.lit(1.0)).alias("s"), F.posexplode(F.transform(F.split(F.coalesce("text", F.lit("")), GAP), X.strip)).alias("place", "sentence"))
    parts = parts.filter(F.length("sentence") >= LEAST_CHARS).withColumn("overlap", F.size(F.array_intersect("q", X.terms(F.col("sentence"), 3))))
    by = Window.partitionBy("qid", "pos")
    ranked = parts.withColumn("r", F.row_number().over(by.orderBy(F.desc("overlap"), "place"))).withColumn("best", F.max("overlap").over(by)).withColumn("f", F.min("place").over(by))
    good = (F.col("overlap") > 0) & (F.col("r") <= PER_CHUNK)
    lead = (F.col("best") == 0) & (F.col("place") == F.col("f")) & (F.col("s") >= 0.2)
    return ranked.filter(good | lead).select("qid", "pos", F.col("r").alias("place"), "sentence")


def answers(context: DataFrame) -> DataFrame:
    """qid, answer: the findings as a list with citations, each sentence once."""
    found = findings(context)
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("qid", "sentence").orderBy("pos", "place"))).filter("n = 1")
    lines = first.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "place", "sentence"))), lambda s: F.concat(F.lit("- "), s["sentence"], F.lit(" ["), s["pos"].cast("string"), F.lit("]"))).alias("lines"))
    chunks = found.groupBy("qid").agg(F.countDistinct("pos").alias("n"))
    questions = context.groupBy("qid").agg(F.first("query").alias("query"), F.min_by("text", "pos").alias("top"))
    lead = F.try_element_at(F.filter(F.transform(F.split(F.coalesce("top", F.lit("")), GAP), X.strip), lambda s: F.length(s) >= LEAST_CHARS), F.lit(1))
    full = F.concat(F.lit("From what was found on '"), F.col("query"), F.lit("':\n"), F.array_join("lines", "\n"), F.lit("\nSources used: "), F.col("n").cast("string"), F.lit("."))
    none = F.when(lead.isNotNull(), F.concat(F.lit("From the best source [1]:\n- "), lead, F.lit(" [1]"))).otherwise(F.concat(F.lit("Nothing relevant was found on '"), F.col("query"), F.lit("'.")))
    return questions.join(lines, "qid", "left").join(chunks, "qid", "left").select("qid", F.when(F.col("lines").isNotNull(), full).otherwise(none).alias("answer"))


def prompts(context: DataFrame) -> DataFrame:
    """qid, prompt: the numbered context and the question, for a generator of one's own."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "text")))
    numbered = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["pos"].cast("string"), F.lit("] "), F.coalesce(r["text"], F.lit("")))), "\n\n")
    grouped = context.groupBy("qid").agg(F.first("query").alias("query"), numbered.alias("context"))
    return grouped.select("qid", F.concat(F.lit("Answer from the numbered sources only and cite them as [n].\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query")).alias("prompt"))


def citations(context: DataFrame, answered: DataFrame) -> DataFrame:
    """qid, pos, id, source, page, relevance, is_cited, snippet of every chunk of the context.

    context: qid, pos, id, text, score, and source, page, rerank_score as far as there are any.
    """
    have = lambda c, kind: F.col(c) if c in context.columns else F.lit(None).cast(kind)
    cited = answered.select("qid", X.citations(F.col("answer")).alias("cited"))
    rows = context.join(cited, "qid", "left")
    score = F.coalesce(F.nullif(have("rerank_score", "double"), F.lit(0.0)), have("score", "double"), F.lit(0.0))
    return rows.select("qid", "pos", "id", F.coalesce(have("source", "string"), F.lit("Document")).alias("source"), have("page", "int").alias("page"), rounded(score, 4).alias("relevance"), F.coalesce(F.array_contains("cited", F.col("pos").cast("int")), F.lit(False)).alias("is_cited"), X.snippet(F.coalesce("text", F.lit(""))).alias("snippet"))


def grounding(context: DataFrame, answered: DataFrame) -> DataFrame:
    """qid, n_candidates, n_cited, grounding: the share of the answer's distinct words of four characters or more that stand in its context."""
    words = context.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(X.terms(F.col("text"), 4)))).alias("c"), F.count(F.lit(1)).alias("n_candidates"))
    rows = answered.join(words, "qid", "left").withColumn("a", X.terms(F.col("answer"), 4))
    share = F.size(F.array_intersect("a", F.coalesce("c", F.array().cast("array<string>")))) / F.greatest(F.size("a"), F.lit(1))
    return rows.select("qid", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.size(X.citations(F.col("answer"))).cast("bigint").alias("n_cited"), rounded(share, 3).alias("grounding"))


Provider = tuple[str, Callable[[str], object]]


def generate(prompt: str, providers: list[Provider]) -> tuple[str | None, str | None]:
    """(name, text) of the first provider that yields text; blanks, other types and errors pass on to the next. (None, None): use answers()."""
    for name, ask in providers:
        try:
            out = ask(prompt)
        except Exception:  # a provider that is down must not end the answer
            continue
        if isinstance(out, str) and out.strip():
            return name, out
    return None, None


def generated(asked: DataFrame, providers: list[Provider]) -> DataFrame:
    """qid, provider, generated of each prompt (qid, prompt) that some provider answers. Prompts go out from the executors."""

    def run(batches):
        for b in batches:
            got = [(q, *generate(p, providers)) for q, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            got = [x for x in got if x[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((b.schema.field(0).type, pa.string(), pa.string()))], names=["qid", "provider", "generated"])

    return asked.select("qid", "prompt").mapInArrow(run, f"qid {dict(asked.dtypes)['qid']}, provider string, generated string")


class QueryCache:
    """Results by the SHA-256 of their canonical request; the least recently used goes first, and all go after ``ttl`` seconds."""

    def __init__(self, capacity: int = 500, ttl: float = 3600, clock: Callable[[], float] = time.time):
        self.capacity, self.ttl, self.clock = capacity, ttl, clock
        self.rows: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(request: dict) -> str:
        return sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()

    def get(self, request: dict):
        k = self.key(request)
        if k in self.rows and self.clock() - self.rows[k][0] <= self.ttl:
            self.rows.move_to_end(k)
            self.hits += 1
            return self.rows[k][1]
        self.rows.pop(k, None)
        self.misses += 1
        return None

    def put(self, request: dict, value) -> None:
        k = self.key(request)
        self.rows[k] = (self.clock(), value)
        self.rows.move_to_end(k)
        while len(self.rows) > self.capacity:
            self.rows.popitem(last=False)

    def clear(self) -> None:
        self.rows.clear()
        self.hits = self.misses = 0

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"entries": len(self.rows), "capacity": self.capacity, "hits": self.hits, "misses": self.misses, "hit_percent": round(100 * self.hits / asked, 2) if asked else 0.0}
