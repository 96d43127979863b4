"""Quality classifier on supervised subword embeddings.

Each word and each character n-gram has a hashed vector, and so has the word pair of a word and its repetition (one vector
for all words); a document is the average of the vectors of all its features,
and a softmax over two classes reads it. Vectors and softmax are learnt together by stochastic gradient descent.

The average and the softmax's input are linear in the features, so once trained a word is two numbers: what its features add
to the difference of the logits, and how many they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, docs_of, pieces, raw, smallest
from .features import subwords, total
from .words import Rows, Split, WordTable, gather


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: what it adds to the logit of class 1 less that of class 0
    shift: float  # log-odds of the classes among all labelled rows
    sizes: tuple[int, ...]


def train(texts: list[bytes], labels: list[int], shift: float = 0.0, buckets: int = 1 << 17, dim: int = 8, epochs: int = 8, rate: float = 0.5, vector_rate: float = 50.0, sizes: tuple[int, ...] = (3, 4, 5), seed: int = 7) -> Model:
    """Plain SGD, one document a step; the rate falls to zero linearly. A feature has only its share of a document's average, so
    the vectors learn at ``vector_rate`` times the rate of the softmax. Without two classes the model says the prior."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (buckets + 1, dim))  # the last one is that of repetitions
    u = np.zeros((dim, 2))
    y = np.asarray(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(buckets + 1), shift, sizes)
    split = Split(texts)
    found: dict = {"ids": [], "n": []}

    def make(words):
        for name, x in zip(("ids", "n"), subwords(words, buckets, sizes), strict=True):
            found[name].append(x)

    rows = WordTable(make).rows(split)
    found = {k: np.concatenate([np.zeros(0, np.int64), *v]) for k, v in found.items()}
    ends = np.cumsum(found["n"])
    bags = []
    for f, n in zip(split.first, split.n, strict=True):
        r = rows[f : f + n]
        ids = gather(found["ids"], ends[r] - found["n"][r], found["n"][r])
        ids = np.concatenate((ids, np.full(int((r[1:] == r[:-1]).sum()), buckets)))
        some, count = np.unique(ids, return_counts=True)
        bags.append((some, count / max(1, len(ids))))
    steps, step = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)).tolist():
            ids, w = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            h = w @ e[ids]
            z = h @ u
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = u @ p
            u -= lr * np.outer(h, p)
            e[ids] -= lr * vector_rate * np.outer(w, back)
    return Model(e @ (u[:, 1] - u[:, 0]), shift, sizes)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 600, longest: int = 100_000, **how) -> Model:
    """A model from at most ``per_class`` labelled documents of each class, those of the smallest hashes of their ids.

    labels: doc_id, label (0 or 1). Labels without a document, null labels, ids with labels of both classes and null texts teach
    nothing and do not count for the shares of the classes; nor is a text of more than ``longest`` characters taken as a sample, so
    the sample is bounded in bytes. Of rows that repeat an id the smallest text counts.
    """
    named = docs_of(docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()))
    sized = named.groupBy("doc_id").agg((F.min(F.length("text")) <= longest).alias("fits"))
    agreed = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).filter("label = _other").drop("_other")
    taught = cut(agreed.join(sized, "doc_id"))
    counts = dict(taught.groupBy("label").count().collect())
    picked = smallest(taught.filter("fits").select("doc_id", "label", F.struct(F.xxhash64("doc_id"), "doc_id").alias("_order")), "label", "_order", per_class).select("doc_id", "label")
    # At most 2 * per_class ids: a bounded side.
    rows = named.filter(F.length("text") <= longest).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    shift = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    return train([r.text.encode() for r in rows], [int(r.label) for r in rows], shift, **how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1; how likely class 1 is) of every row; without words, as in a null or empty text, it is the share of
    class 1 among the labels. Repeated rows each get their row, a null doc_id stays null, an empty table gives an empty result; other
    columns are ignored whatever their names. A very long text is a slice of its own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs_of(docs)

    def run(batches):
        model = sent.value
        add, count = Rows(np.float64), Rows(np.int64)

        def make(words):
            ids, n = subwords(words, len(model.weight) - 1, model.sizes)
            add.extend(total(model.weight[ids], n))
            count.extend(n)

        table = WordTable(make)
        for b in pieces(batches):
            if table.tidy():
                add.clear()
                count.clear()
            split = Split(raw(b.column(1)))
            r = table.rows(split)
            again = np.zeros(len(r))
            again[1:] = (r[1:] == r[:-1]) & (np.diff(split.text()) == 0)
            add_, count_ = add.data[r] + again * model.weight[-1], count.data[r] + again
            z = total(add_, split.n) / np.maximum(total(count_, split.n), 1) + model.shift
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def fold(column: str, n: int):
    """crc32 of a column's text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
