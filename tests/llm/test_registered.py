"""The registered queries, as they are registered, against second implementations; and the pipeline, stage by stage."""

import collections
import itertools
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import html, language, pii, quality_model, tokens
from quernstone.llm import queries as Q

from . import mirror
from .test_exact import PLAIN, classes, fingerprint, grams, lowered, words
from .test_minhash import grams as shingles
from .test_minhash import similar

KEY = "a key for tests"


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):
    """The tables of a driver's folder, small and odd: nulls in all columns, repeated rows, and columns whose names clash."""
    top = tmp_path_factory.mktemp("tables")
    langs = {i: ("en", "fr", None)[i % 3] for i in texts}
    rows = [(i, t, langs[i], None if i % 2 else f"s{i}", None if i % 5 == 0 else -1) for i, t in texts.items()]
    rows += [rows[3], (60, texts[9][:120].rsplit(" ", 1)[0], "en", None, -1), (None, texts[7] + " and more", None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("key", F.lit(1)).withColumn("slice", F.lit("x")).repartition(3).write.parquet(str(top / "documents.parquet"))
    items = [(i, texts[9][:120].rsplit(" ", 1)[0]) for i in (1, 2)] + [(3, "yes"), (4, None), (None, "never")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(top / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 2), 0) for i in texts], "doc_id bigint, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top), rows


@pytest.fixture
def key(spark):
    spark.conf.set(pii.KEY, KEY)
    yield KEY
    spark.conf.unset(pii.KEY)


def test_op1(spark, folder):
    path, rows = folder
    fp = {i: fingerprint(t, 3) for i, t, *_ in rows}
    want = classes(sorted(i for i in fp if i is not None), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = Q.op1_simhash(spark, path).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got if r.doc_id is not None) == sorted((i, f"{fp[i]:016x}") for i, *_ in rows if i is not None)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want and sum(r.doc_id is None for r in got) == 2


class Article(HTMLParser):
    """Blocks of the article of a page, without what is no part of its text."""

    OTHER = {"nav", "aside", "footer", "form", "script", "style", "button", "noscript", "iframe", "svg", "template"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "u", "small", "sub", "sup", "mark", "cite", "q", "abbr", "time", "label"}
    EMPTY = {"br", "img", "hr", "input", "meta", "link", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.off, self.stack, self.blocks, self.now = 0, 0, [], [], ""

    def flush(self):
        t = " ".join(self.now.split())
        self.blocks += [t] if t else []
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.EMPTY:
            self.now += " " if tag == "br" else ""
            return
        if tag not in self.INLINE:
            self.flush()
        self.depth += tag == "article"
        gone = tag in self.OTHER or any(x in (dict(attrs).get("class") or "") for x in ("comment", "advert", "share", "cookie", "notice", "related", "newsletter", "sidebar"))
        self.off += gone
        self.stack.append((tag, gone))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.flush()
        while self.stack:
            t, gone = self.stack.pop()
            self.off -= gone
            self.depth -= t == "article"
            if t == tag:
                break

    def handle_data(self, data):
        if self.depth and not self.off:
            self.now += data


def test_op2(spark, data):
    got = {r.page_id: r for r in Q.op2_main_text(spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        a = Article()
        a.feed(p.html or "")
        a.close()
        want = "\n\n".join(a.blocks)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def test_op3(spark, folder):
    path, rows = folder
    got = collections.Counter(tuple(r) for r in Q.op3_suffix_quality(spark, path).select("doc_id", "n_words", "n_repeat_words", "base_failed", "covered_words", "kept").collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        w = words(t)
        three, ten = ({p for v in grams(w, n).values() if len(v) > 1 for s in v for p in range(s, s + n)} for n in (3, 10))
        failed = len(w) < 50 or 100 * len(three) > 50 * len(w)
        much = any(len(v) > 1 for v in grams(w, 101).values())
        want[i, len(w), len(three), failed, len(ten), not failed and len(ten) <= 0.3 * len(w) and not much] += 1
    assert got == want


def test_op5_scores(spark, folder):
    """A word's two numbers give what the average over the vectors of all features gives."""
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    taught = labels.filter(quality_model.fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    m = quality_model.learn(docs, taught)
    assert m.weight.any()
    by_text = {t: r.score for r in Q.op5_quality_classifier(spark, path).collect() for i, t, *_ in rows if i == r.doc_id and i is not None}
    for t in {t for i, t, *_ in rows if i is not None}:
        w, total, n = words(t), 0.0, 0
        for k, x in enumerate(w):
            ids, size = quality_model.subwords([x], len(m.weight) - 1, m.sizes)
            assert size.tolist() == [len(ids)]
            total += sum(m.weight[j] for j in ids) + (m.weight[-1] if k and w[k - 1] == x else 0)
            n += len(ids) + (1 if k and w[k - 1] == x else 0)
        z = total / max(n, 1) + m.shift
        assert by_text[t] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    got = {r.doc_id: (r.held_out, r.predicted) for r in Q.op5_quality_classifier(spark, path).collect() if r.doc_id is not None}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (h, _) in got.items())


def test_op5_labels(spark, docs):
    """Labels of no document, of two minds or of neither class teach nothing and change no share."""
    fine = [(i, int(i < 4)) for i in range(12)]
    a = quality_model.learn(docs, spark.createDataFrame(fine, "doc_id bigint, label int"))
    b = quality_model.learn(docs, spark.createDataFrame(fine + fine[:3] + [(777, 1), (778, 1), (20, 0), (20, 1), (21, 5), (21, None), (40, 1)], "doc_id bigint, label int"))
    assert a.shift == b.shift == pytest.approx(np.log(4.5 / 8.5)) and (a.weight == b.weight).all()


def test_op6(spark, tmp_path, key):
    values = [(f"Écrit à: {v}, fin\n", f"Écrit à: {f(v, KEY)}, fin\n") for f, v in mirror.VALUES]
    values += [("; ".join(v for _, v in mirror.VALUES), "; ".join(f(v, KEY) for f, v in mirror.VALUES)), (None, None), ("", ""), ("nothing in it 12", "nothing in it 12")]
    spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(values)], "doc_id int, text string, pii_counts string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in Q.op6_pseudonyms(spark, str(tmp_path)).collect()}
    for i, (_, want) in enumerate(values):
        assert got[i].text == want
    n = len(mirror.VALUES)
    assert sum(got[n][f"n_{k}"] for k in pii.KINDS) == n and got[n].n_iban == 3 and got[n].n_ssn == 2 and got[n + 1].n_card == 0


def test_op6_needs_a_key(spark, docs):
    with pytest.raises(ValueError, match="secret key"):
        pii.pseudonymise(docs, "")
    assert pii.session_key(spark) != pii.session_key(spark)


def test_op7(spark, folder):
    path, rows = folder
    tok = tokens.encoder().tok
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in Q.op7_token_files(spark, path).collect() if r.doc_id is not None), key=lambda r: r[1])
    ids = {t: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows}
    assert [r[0] for r in got] == sorted(i for i, *_ in rows if i is not None)
    assert collections.Counter((r[0], *r[2:]) for r in got) == collections.Counter((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t, *_ in rows if i is not None)
    assert all(b[1] == a[1] + a[2] for a, b in itertools.pairwise(got))


def uncut(m, text):
    """Language and share of a text by a forward-backward over all of its words in turn, in logarithms."""
    split = words(text)
    if not split:
        return "und", 0.0
    own, letters = [], []
    for w in split:
        ids, _, letter = language.word_features([w], m.buckets, m.lexicon, len(m.langs))
        own.append(m.weight[ids].sum(0).astype(np.float32).astype(float) * letter[0])
        letters.append(letter[0])
    up = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    f, b = [m.start + own[0]], [np.zeros(len(m.langs))]
    for s in own[1:]:
        f.append(up(f[-1][:, None] + m.step, 0) + s)
    for s in own[:0:-1]:
        b.append(up(m.step + (s + b[-1])[None], 1))
    p = np.array(f) + np.array(b[::-1])
    p = np.exp(p - up(p, 1)[:, None]) * np.array(letters)[:, None]
    mass = p.sum(0)
    return (m.langs[int(mass.argmax())], float(mass.max() / mass.sum())) if mass.sum() > 0 else ("und", 0.0)


def test_op8(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    m = language.learn(docs.filter(quality_model.fold("doc_id", 3) != 1))
    assert m.langs == ["en", "fr"]
    by_text = {t: (r.lang_pred, r.score, r.held_out) for r in Q.op8_language(spark, path).collect() for i, t, *_ in rows if i == r.doc_id and i is not None}
    for i, t, *_ in rows:
        if i is not None and len(t or "") < 8000:
            lang, share = uncut(m, t)
            assert by_text[t][0] == lang and by_text[t][1] == pytest.approx(share, abs=1e-4), i


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 129, 500])
def test_chain_is_uncut(n):
    rng = np.random.default_rng(n)
    k = 3
    score, step, start = rng.normal(size=(n + 70, k)) * 2, rng.normal(size=(k, k)) + 2 * np.eye(k), rng.normal(size=k)
    got = np.zeros_like(score)
    for first, length, _, p in language.chain(score, np.array([n, 0, 70]), step, start, at_once=2):
        for f, z, x in zip(first, length, p, strict=True):
            got[f : f + z] = x[:z]
    for a, b in ((0, n), (n, n + 70)):
        want, _ = language.forward_backward(score[None, a:b], np.array([b - a]), step, start)
        assert np.allclose(got[a:b], want[0], atol=1e-9)


def packed(lengths, longest=2048, buckets=8, budget=16384):
    """Rows of packing.pack, by an exhaustive dynamic programme and a sorted list."""
    pieces = []
    for i, n in sorted(lengths, key=lambda x: (x[0] is not None, x[0] or 0)):
        pieces += [(i, k, min(longest, n - k * longest)) for k in range(-(-n // longest))]
    sizes = sorted({p[2] for p in pieces})
    count = collections.Counter(p[2] for p in pieces)
    best = {0: (0, ())}
    for _ in range(min(buckets, len(sizes))):
        new = {}
        for j in range(1, len(sizes) + 1):
            new[j] = min((best[i][0] + sum(count[s] * (sizes[j - 1] - s) for s in sizes[i:j]), best[i][1] + (sizes[j - 1],)) for i in range(j) if i in best)
        best = new | {0: (0, ())}
    return best.get(len(sizes), (0, ()))[0], pieces


def test_op10(spark, folder):
    path, rows = folder
    tok = tokens.encoder().tok
    lengths = [(i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows]
    got = Q.op10_packing(spark, path).collect()
    counted = collections.Counter((r.doc_id, r.n_tokens) for r in tokens.token_counts(spark.read.parquet(f"{path}/documents.parquet")).collect())
    assert {i: n for i, n in counted} == dict(lengths) or all((i, n) in counted or (i, n - 1) in counted for i, n in lengths)
    lengths = list(counted.elements())
    padding, pieces = packed(lengths)
    assert collections.Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == collections.Counter(pieces)
    assert sum(r.bucket - r.n_tokens for r in got) == padding
    batches = collections.defaultdict(list)
    for r in got:
        batches[r.bucket, int(r.batch_id.split("-")[1])].append(r)
    order = lambda r: (r.doc_id is not None, r.doc_id or 0, r.piece)
    for bucket in {b for b, _ in batches}:
        mine = [sorted(batches[bucket, k], key=lambda r: r.slot) for k in range(sum(b == bucket for b, _ in batches))]
        flat = [r for b in mine for r in b]
        assert [order(r) for r in flat] == sorted(order(r) for r in flat)
        assert all(len(b) == max(1, 16384 // bucket) for b in mine[:-1]) and all([r.slot for r in b] == list(range(len(b))) for b in mine)


def cut_out(text, benchmark, size=10):
    """The text without the stretches of runs of words in windows of the benchmark; None if nothing is left of its words."""
    low = lowered(text)
    spans = [m.span() for m in PLAIN.finditer(low)]
    w, hit = [low[a:b] for a, b in spans], set()
    for t in benchmark:
        item = PLAIN.findall(lowered(t))
        for k in range(max(1, len(item) - size + 1) if item else 0):
            window = item[k : k + size]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
    if w and len(hit) == len(w):
        return None
    raw, out, at = (text or "").encode(), b"", 0
    for i in range(len(w)):
        if i in hit and i - 1 not in hit:
            out += raw[at : spans[i][0]]
        if i in hit:
            at = spans[i][1]
    return (out + raw[at:]).decode() if text is not None else None


def test_pipeline_stages(spark, folder, key):
    """Each stage on what the one before has kept."""
    path, _ = folder
    items = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").filter("item_id is not null").collect()]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_dedup", "decontaminate", "pseudonymise", "pack"]
    model = language.learn(docs)

    def rows_of(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    before = rows_of(docs)
    kept = stages["language"](spark, docs, path).cache()
    assert kept.columns == docs.columns
    assert rows_of(kept) == [r for r in before if len(r[1] or "") > 8000 or uncut(model, r[1])[0] != "und" and uncut(model, r[1])[1] >= corpus_pipeline.MIN_SHARE]

    before = rows_of(kept)
    single = stages["near_dedup"](spark, kept, path).cache()
    sets = {r[0]: shingles(r[1]) for r in before if r[0] is not None}
    first = set(classes(sorted(sets), lambda a, b: similar(sets[a], sets[b])).values())
    assert rows_of(single) == sorted({r for r in before if r[0] in first} | {r for r in before if r[0] is None}, key=str)

    before = rows_of(single)
    clean = stages["decontaminate"](spark, single, path).cache()
    want = []
    for r in before:
        t = cut_out(r[1], items)
        if t is not None or r[1] is None:
            want.append((r[0], t, r[2], r[3], len(t) if t != r[1] else r[4], *r[5:]))
    assert rows_of(clean) == sorted(want, key=str) and len(want) < len(before)

    swapped = stages["pseudonymise"](spark, clean.unionByName(clean.limit(1).withColumn("text", F.lit("to a.b@mail.example.com on 2024-02-29")).withColumn("doc_id", F.lit(900).cast("bigint"))), path).cache()
    assert {r.text for r in swapped.filter("doc_id = 900").collect()} == {f"to {mirror.email('a.b@mail.example.com', KEY)} on {mirror.iso_date('2024-02-29', KEY)}"}
    plain = {r[0]: r[1] for r in rows_of(clean) if not re.search("[0-9]{3}|@", r[1] or "")}
    assert {i: t for i, t, *_ in rows_of(swapped) if i in plain} == plain

    pieces = collections.Counter(r.doc_id for r in stages["pack"](spark, swapped, path).collect())
    assert set(pieces) == {r[0] for r in rows_of(swapped)}


def test_pipeline_runs(spark, folder, key):
    path, rows = folder
    ids = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert 3 in ids and not ids & {20, 21, 40, 41, 42, 54}


def test_long_texts(spark, tmp_path):
    """A text over several slices is whole everywhere."""
    rng = np.random.default_rng(2)
    long = " ".join(f"w{x}" for x in rng.integers(0, 50_000, 400_000))
    spark.createDataFrame([(1, "short one"), (2, long), (3, long[:100] + " end")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, long[-200:])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    n = len(words(long))
    assert len(long) > 2 << 20
    assert {r.doc_id: r.fingerprint for r in Q.op1_simhash(spark, str(tmp_path)).collect()}[2] == f"{fingerprint(long, 3):016x}"
    assert {r.doc_id: r.n_words for r in Q.op3_suffix_quality(spark, str(tmp_path)).collect()}[2] == n
    got = {r.doc_id: r.n_removed for r in Q.op4_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[2] == 0 and got[3] >= 13
    hits = {r.doc_id: r.n_hit for r in Q.op9_decontamination(spark, str(tmp_path)).collect()}
    assert 10 < hits[2] <= len(PLAIN.findall(lowered(long[-200:])))


@pytest.mark.parametrize("page", ["<a" * 1_000_000, '<a x="y" ' * 200_000, "<div>a" * 100_000, "<div>" * 100_000 + "</section>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<!--" * 300_000, "<li>" * 200_000, "<td><table>" * 50_000, "&#" + "9" * 6000 + ";x", '<p class="' + "ab " * 300_000 + '">x'])
def test_pages_in_linear_time(page):
    import time

    start = time.perf_counter()
    html.extract(page, html.default_model())
    assert time.perf_counter() - start < 6


def test_notice_of_any_length():
    m = html.default_model()
    notice = "We and our partners use cookies to improve your experience. You can withdraw your consent at any time in the privacy settings of this page. "
    for n in (100, 290, 310, 800, 3000):
        page = f"<body><article><h1>A title here</h1><p>Some real text stands here, and it goes on for a while.</p></article><div class=x><p>{(notice * 30)[:n]}</p></div></body>"
        assert html.extract(page, m) == "A title here\n\nSome real text stands here, and it goes on for a while."


def test_blocks_of_random_trees():
    """A tree written out and cut again gives the texts between its block tags, with what stands above each."""
    import random

    for seed in range(150):
        r, want = random.Random(seed), []
        state = {"now": "", "features": None}

        def flush(path, state=state, want=want):
            if state["now"].strip():
                tags = [x for x in path if x[0] == "<"]
                inner = tags[len(tags) - tags[::-1].index("<article") :] if "<article" in tags else []
                features = set(path) | {f"article>{x[1:]}" for x in inner} | ({f"in{tags[-1]}"} if tags else set())
                want.append((" ".join(state["now"].split()), tuple(sorted(features))))
            state["now"] = ""

        def tree(depth, path, r=r, state=state, flush=flush):
            out = ""
            for _ in range(r.randint(1, 3)):
                k = r.random()
                if k < 0.4 or depth > 4:
                    t = r.choice(["a b", " c", "d ", "e\n f"])
                    out += t
                    state["now"] += t
                elif k < 0.6:
                    name = r.choice(["b", "span", "em"])
                    c = r.choice(["", "hot", "Big one"])
                    out += f"<{name} class='{c}'>" + tree(depth + 1, path + [f".{x}" for x in c.lower().split()]) + f"</{name}>"
                else:
                    name = r.choice(["div", "article", "section", "ul", "table"])
                    c = r.choice(["", "x", "side bar"])
                    flush(path)
                    inner = path + [f".{x}" for x in c.split()] + [f"<{name}"]
                    out += f'<{name} class="{c}">' + tree(depth + 1, inner)
                    flush(inner)
                    out += f"</{name}>"
            return out

        page = tree(0, [])
        flush([])
        got = [(b.text, b.path) for b in html.leaf_blocks(page)]
        assert [t for t, _ in got] == [t for t, _ in want]
        if "<b" not in page and "<span" not in page and "<em" not in page:
            assert got == want


def test_many_equal_items(spark, docs, texts):
    """They cost nothing for each word, and their ids all come out."""
    import time

    from quernstone.llm import decontam

    bench = spark.createDataFrame([(i, "Yes") for i in range(20_000)] + [(99_999, texts[9][:150])], "item_id int, text string").cache()
    start = time.perf_counter()
    got = {r.doc_id: r for r in decontam.benchmark_hits(docs.filter("doc_id in (5, 9)").unionByName(docs.filter("doc_id = 8").withColumn("text", F.repeat(F.lit("yes no "), 50_000))), bench).collect()}
    assert time.perf_counter() - start < 30
    assert len(got[8]["items"]) == 20_000 and got[8].n_hit == 50_000 and got[9]["items"] == ["99999"] and got[5].n_hit == 0
