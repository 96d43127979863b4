"""What the language model is taught by."""

import collections

from pyspark.sql import functions as F

from quernstone.llm import language


def sample(monkeypatch, docs, **how):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, langs, **_: seen.append((texts, langs)))
    language.learn(docs, **how)
    return seen[0]


def test_repeated_rows_are_one(spark, monkeypatch):
    """The id of the smallest hash comes 300 times; it takes one place in the sample."""
    ids = [r.id for r in spark.range(1000).orderBy(F.xxhash64("id")).limit(600).collect()]
    rows = [(ids[0], f"text {i}", "en") for i in range(300)] + [(i, "a text", "en") for i in ids[1:300]] + [(i, "un texte", "fr") for i in ids[300:]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    texts, langs = sample(monkeypatch, docs)
    assert collections.Counter(langs) == {"en": 150, "fr": 150} and texts.count(b"text 0") == 1


def test_languages_are_bounded(spark, monkeypatch):
    rows = [(100 * k + i, "x", f"l{k}") for k in range(6) for i in range(10 + 5 * (k in (2, 4)))]
    _, langs = sample(monkeypatch, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_lang=3, most_langs=3)
    assert collections.Counter(langs) == {"l0": 3, "l2": 3, "l4": 3}
