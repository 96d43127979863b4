"""Alignment of two tokenizers, against a token by token reading of both libraries."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernstone.llm import align
from quernstone.llm import queries as Q
from quernstone.llm.tokens import tokenizer_path

ODD = ["", " ", "  lead", "trail  ", "a  b\n\nc\td", "x\nfoo \n", "▁ bad", "ok ▁ bad word", "<|endoftext|> <s> a", "it's don't ﬁ Ünï 漢字 漢字漢字。カナ", "a b c  d 　e", "\n", "\nstart\nline"]
ODD += ["\x00 nul \x00", "a" * 3000, "word " * 500, "tab\t\n x", "foo \xa0 bar", "😀 😀😀 é́", "a\r\nb\r\n c {\r\n}"]


@pytest.fixture(scope="module")
def read():
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    table, names = align.byte_alphabet(), {i: t for t, i in tok.get_vocab().items()}

    def groups(text):
        """Lists of ids of both; None if a tokenizer does not give the text back."""
        if not text:
            return []
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        parts = [bytes(table[c] for c in names[i]) for i in a], [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return None
        ends = [list(itertools.accumulate(map(len, p))) for p in parts]
        out, low = [], 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            out.append([[i for i, x in zip(ids, own) if low < x <= e] for ids, own in zip((a, b), ends)])
            low = e
        return out

    return groups


def wanted(rows, read):
    every = [(i, read(t)) for i, t in rows]
    held = collections.Counter()
    for _, g in every:
        held.update({(x, y) for a, b in g or () for x in a for y in b})
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for i, g in every:
        links = [(x, y) for a, b in g or () for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or ())
        sums = [sum(len(x[k]) for x in g or ()) for k in (0, 1)]
        out.append((i, *sums, len(g or ()), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def random_texts(n):
    rng = random.Random(3)
    parts = ["a", "b", " ", " ", "\n", "  ", "é", "漢", "▁", " \n", "'s", "1", "23", ".", "…", " ", "\xa0", "\t", "hello", "World"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_op12(spark, texts, read, tmp_path):
    rows = [*texts.items(), *enumerate(ODD, 1000), *enumerate(random_texts(200), 2000), (3, texts[3]), (None, texts[5]), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "'x' as key", "0 as n_a").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op12_tokenizer_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(wanted(rows, read), key=key)


def test_forgetting_changes_nothing(spark, texts, read, monkeypatch):
    monkeypatch.setattr(align, "MEMO_UNITS", 5)
    monkeypatch.setattr(align, "TOGETHER", 3)
    know = align.Aligner(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), lambda pair: (pair * 0 + 1, pair * 0 == 0))
    for t in [x for x in texts.values() if x and len(x) < 5000] + ODD + random_texts(100):
        know.tidy()
        row, n = know.documents([t.encode()])
        text = b"".join(know.pool.data[know.place.data[r] : know.place.data[r] + know.size.data[r]].tobytes() for r in row)
        assert text.decode() == "".join(f"{','.join(map(str, a))}|{','.join(map(str, b))};" for a, b in read(t) or ()), t


def test_shards(spark, tmp_path):
    """Counts of pairs that come from many tasks, in more shards than a worker has open."""
    rng = np.random.default_rng(1)
    keys = (rng.integers(0, 40, 5000) << 32 | rng.integers(0, 30, 5000)).tolist()
    want = collections.Counter(keys)
    partial = spark.createDataFrame([(k, 1) for k in keys], "key bigint, n bigint").repartition(7)
    listed = align.write_shards(partial, f"file://{tmp_path}/pairs", 9).collect()
    assert sum(r.n for r in listed) == len(want) and len(listed) > 4
    counts = align.Counts((r.file, r.first) for r in listed)
    asked = np.array([*want, 77 << 32, 5])
    assert counts(asked).tolist() == [*want.values(), 0, want.get(5, 0)]
    best = collections.Counter()
    for r in listed:
        for i, n in zip(r.ids, r.best):
            best[i] = max(best[i], n)
    assert best == {a: max(n for k, n in want.items() if k >> 32 == a) for a in {k >> 32 for k in want}}


def test_repeats_within_a_group_make_no_product():
    unit = np.zeros(1, np.int64)
    a, b = np.full(3000, 7), np.full(2000, 9)
    pair, often, of = align.Aligner._pairs(a, b, np.zeros(3000, np.int64), np.zeros(2000, np.int64), unit)
    assert pair.tolist() == [7 << 32 | 9] and often.tolist() == [6_000_000] and of.tolist() == [0]


def test_no_token(spark, empty):
    assert align.align(empty).collect() == []
    none = empty.sparkSession.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sorted(map(tuple, align.align(none).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_partial_counts_hold_each_pair_once_a_task(spark, texts):
    docs = spark.createDataFrame([(i, texts[5]) for i in range(50)], "doc_id bigint, text string").coalesce(1)
    rows = align.partial_counts(docs).agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    assert rows.n == rows["keys"] > 10 and rows.least == rows.most == 50
