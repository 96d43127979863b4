"""Language of words and of texts by a linear-chain conditional random field.

The words of a text are labelled with languages. A word's own score for a language comes from its affixes, its character
n-grams and a lexicon learnt from the training texts; learnt transitions tie neighbours, so a short foreign passage is told
from single odd words. Forward-backward gives the probability of each language at each word; a text's language is the one
with the largest expected number of words, and the score is its share. Words without a letter carry no score of their own.

The chain runs over the whole text. To do many texts at once they are cut into blocks of ``BLOCK`` words, and what each block
makes of the labels before it (a matrix) carries the forward and backward messages over the cuts, so that the result is that of
the uncut chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, docs_of, pieces, raw, small_batches, smallest
from .features import subwords, total
from .words import NEW_WORDS, Rows, Split, WordTable, gather

BLOCK = 64
#: Bytes of text that are labelled at once; a word takes some 200 bytes meanwhile.
SLICE = 1 << 19
SIZES = (2, 3, 4)
#: Words that a task remembers the scores of before it forgets all.
WORDS = 500_000


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # buckets and lexicon entries x languages
    step: np.ndarray  # languages x languages: log-potential of neighbours
    start: np.ndarray
    buckets: int
    lexicon: dict[bytes, int]


def word_features(words: list[bytes], buckets: int, lexicon: dict[bytes, int], langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, their number for each word, whether the word has a letter).

    The n-grams with < or > are the affixes. The lexicon's own features come after the buckets: one for each language whose
    training texts hold the word almost alone, and one for words that are common to all.
    """
    clean = [w.decode("utf-8", "replace").strip(_AROUND).casefold() for w in words]
    letter = np.fromiter((any(map(str.isalpha, c)) for c in clean), bool, len(clean))
    coded = [c.encode() for c in clean]
    ids, n = subwords(coded, buckets, SIZES)
    ends = np.cumsum(n)
    lex = np.fromiter((buckets + lexicon.get(c, langs + 1) for c in coded), np.int64, len(coded))
    ids = np.insert(ids, ends, lex)
    return ids, n + 1, letter


_AROUND = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡·|"


def forward_backward(score: np.ndarray, length: np.ndarray, step: np.ndarray, start: np.ndarray, pairs: bool = True, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of each label (blocks x words x labels), and of neighbouring pairs summed over words (labels x labels).

    score: log-potentials of words; words from length on are padding. start: log-potentials of the first label, for all blocks or
    for each; after: the message that comes back from behind each block, if anything follows.
    """
    n, t, k = score.shape
    e = np.exp(score - score.max(2, keepdims=True, initial=0))
    a, first = np.exp(step), np.exp(start)
    f = np.empty((n, t, k))
    f[:, 0] = e[:, 0] * first
    f[:, 0] /= f[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        f[:, i] = (f[:, i - 1] @ a) * e[:, i]
        f[:, i] /= f[:, i].sum(1, keepdims=True)
    b = np.ones((n, t, k))
    if after is not None:
        b[:] = after[:, None, :]
    sums = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        x = b[:, i + 1] * e[:, i + 1]
        inside = (i + 1 < length)[:, None]
        if pairs:
            joint = f[:, i][:, :, None] * a * x[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            sums += (joint * inside[:, :, None]).sum(0)
        y = x @ a.T
        b[:, i] = np.where(inside, y / y.sum(1, keepdims=True), b[:, i])
    p = f * b
    p /= p.sum(2, keepdims=True)
    p[np.arange(t) >= length[:, None]] = 0
    return p, sums


def _through(score: np.ndarray, length: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a block makes of each label of its first word: weights of the labels of its last word (blocks x labels x labels; each
    row sums to one) and the logarithm of each row's true sum."""
    n, t, k = score.shape
    top = score.max(2, initial=0)
    e, a = np.exp(score - top[:, :, None]), np.exp(step)
    scale = np.log(e[:, 0])
    m = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for i in range(1, t):
        inside = i < length
        x = (m @ a) * e[:, i][:, None, :]
        s = x.sum(2)
        m = np.where(inside[:, None, None], x / s[:, :, None], m)
        scale += np.where(inside[:, None], np.log(s), 0)
    return m, scale


def chain(score: np.ndarray, n: np.ndarray, step: np.ndarray, start: np.ndarray, at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Posteriors of the labels of all words: (first word, length, text, posteriors) of some blocks at a time.

    score: log-potentials of the words of all texts; n: words of each text.
    """
    first, length, text = blocks(n)
    total_, k = len(first), score.shape[1]
    if not total_:
        return
    a = np.exp(step)
    parts = [_through(_padded(score, first[i : i + at_once], length[i : i + at_once]), length[i : i + at_once], step) for i in range(0, total_, at_once)]
    m, scale = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    before, after = np.empty((total_, k)), np.ones((total_, k))
    count = -(-n // BLOCK)
    head = (np.cumsum(count) - count)[count > 0]  # first block of each text
    count = count[count > 0]
    before[head] = start
    order = np.argsort(-count, kind="stable")
    head, count = head[order], count[order]
    more = [int(np.searchsorted(-count, -j, "left")) for j in range(int(count[0]) + 1)]  # texts of more than j blocks
    for j in range(int(count[0]) - 1):
        at = head[: more[j + 1]] + j
        w = before[at] + scale[at]
        x = (np.exp(w - w.max(1, keepdims=True))[:, None, :] @ m[at])[:, 0] @ a
        before[at + 1] = np.log(x / x.sum(1, keepdims=True))
    for j in range(int(count[0]) - 2, -1, -1):
        at = head[: more[j + 1]] + j
        w = np.log((m[at + 1] @ after[at + 1][:, :, None])[:, :, 0]) + scale[at + 1]
        x = np.exp(w - w.max(1, keepdims=True)) @ a.T
        after[at] = x / x.sum(1, keepdims=True)
    for i in range(0, total_, at_once):
        f, z = first[i : i + at_once], length[i : i + at_once]
        p, _ = forward_backward(_padded(score, f, z), z, step, before[i : i + at_once], False, after[i : i + at_once])
        yield f, z, text[i : i + at_once], p


def blocks(n: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of n words each: first word, length and text of each block."""
    count = -(-n // size)
    text = np.repeat(np.arange(len(n)), count)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return (np.cumsum(n) - n)[text] + inner * size, np.minimum(size, n[text] - inner * size), text


def _padded(score: np.ndarray, first: np.ndarray, length: np.ndarray, size: int = BLOCK) -> np.ndarray:
    at = first[:, None] + np.minimum(np.arange(size), length[:, None] - 1)
    return score[at].astype(np.float64) if score.dtype != bool else score[at]


def train(texts: list[bytes], langs_of: list[str], buckets: int = 1 << 16, epochs: int = 3, rate: float = 0.3, l2: float = 1e-6, seed: int = 11) -> Model:
    """Maximum likelihood by Adagrad on blocks; half of the blocks are spliced from two texts, so that changes of language
    are seen at all."""
    langs = sorted(set(langs_of))
    k = len(langs)
    rng = np.random.default_rng(seed)
    y_text = np.array([langs.index(x) for x in langs_of], np.int64)
    split = Split(texts)
    y = np.repeat(y_text, split.n)
    words: list[bytes] = []
    rows = WordTable(words.extend).rows(split)
    seen = np.zeros((len(words), k))
    np.add.at(seen, (rows, y), 1)
    merged: dict[bytes, np.ndarray] = {}
    for w, c in zip(words, seen, strict=True):
        key = w.decode("utf-8", "replace").strip(_AROUND).casefold().encode()
        merged[key] = merged[key] + c if key in merged else c
    share = seen.sum(0) + 1
    lexicon = {}
    for w, c in merged.items():
        if c.sum() >= 5 and w:
            r = c / share
            best = int(r.argmax())
            lexicon[w] = best if r[best] > 0.9 * r.sum() else k
    parts = [word_features(words[at : at + NEW_WORDS], buckets, lexicon, k) for at in range(0, len(words), NEW_WORDS)] or [word_features([], buckets, lexicon, k)]
    ids, n, letter = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.cumsum(n)
    first, length, _ = blocks(split.n)
    m = len(first)
    weight, step, start = np.zeros((buckets + k + 2, k)), np.zeros((k, k)), np.zeros(k)
    g_weight, g_step, g_start = np.full(weight.shape, 1e-8), np.full(step.shape, 1e-8), np.full(k, 1e-8)
    use = np.flatnonzero(length >= 4)
    for _ in range(epochs if k > 1 and m else 0):
        order = rng.permutation(use)
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            pos = first[part][:, None] + np.minimum(np.arange(BLOCK), length[part][:, None] - 1)
            size = length[part].copy()
            other = rng.permutation(use)[: len(part)]
            cut = rng.integers(0, BLOCK, len(part))
            mix = rng.random(len(part)) < 0.5
            for i in np.flatnonzero(mix).tolist():
                c = min(int(cut[i]), int(size[i]))
                take = min(BLOCK - c, int(length[other[i]]))
                if c + take:
                    pos[i, c : c + take] = first[other[i]] + np.arange(take)
                    size[i] = c + take
            inside = np.arange(BLOCK) < size[:, None]
            r, gold = rows[pos], y[pos]
            flat = r[inside]
            f = gather(ids, ends[flat] - n[flat], n[flat])
            own = total(weight[f], n[flat]) * letter[flat][:, None]
            score = np.zeros((*pos.shape, k))
            score[inside] = own
            p, pairs = forward_backward(score, size, step, start)
            d = p[inside]
            d[np.arange(len(d)), gold[inside]] -= 1
            d *= letter[flat][:, None]
            times = np.repeat(np.arange(len(flat)), n[flat])
            g = np.stack([np.bincount(f, d[times, i], len(weight)) for i in range(k)], 1)
            both = inside[:, 1:]
            np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), -1)
            s = p[:, 0].sum(0)
            np.add.at(s, gold[:, 0], -1)
            g = g / len(part) + l2 * weight
            touched = np.unique(f)
            g_weight[touched] += g[touched] ** 2
            weight[touched] -= rate * g[touched] / np.sqrt(g_weight[touched])
            for value, total_, grad in ((step, g_step, pairs / len(part)), (start, g_start, s / len(part))):
                total_ += grad**2
                value -= 0.3 * rate * grad / np.sqrt(total_)
    return Model(langs, weight, step, start, buckets, lexicon)


def learn(docs: DataFrame, lang_col: str = "lang", per_lang: int = 150, longest: int = 100_000, most_langs: int = 256, **how) -> Model:
    """A model from at most ``per_lang`` whole texts of each language, those of the smallest hashes of their ids.

    Texts of more than ``longest`` characters are not taken as samples, so the sample is bounded in bytes, too. Of rows that repeat
    an id and a language the smallest text counts, and they are one of the ``per_lang``; rows without an id, a text or a language teach
    nothing. Of more than ``most_langs`` languages those with the most ids are learnt (ties: the first by name).
    """
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col(lang_col).alias("lang")).filter("doc_id is not null and lang is not null and text is not null").filter(F.length("text") <= longest)
    ids = cut(rows.select("doc_id", "lang").distinct())
    learnt = [r.lang for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()]
    picked = smallest(ids.filter(F.col("lang").isin(learnt)).select("doc_id", "lang", F.struct(F.xxhash64("doc_id"), "doc_id").alias("_order")), "lang", "_order", per_lang)
    # At most per_lang rows a language: a bounded side.
    some = rows.join(F.broadcast(picked.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    some = sorted(some.collect(), key=lambda r: (r.doc_id, r.lang))
    return train([r.text.encode() for r in some], [r.lang for r in some], **how)


class Labeller:
    """Languages of texts under a model; remembers the words it has scored."""

    def __init__(self, model: Model):
        self.m, self.k = model, len(model.langs)
        self.own, self.letters = Rows(np.float32, max(self.k, 1)), Rows(bool)
        self.table = WordTable(self._make, WORDS)

    def _make(self, words: list[bytes]) -> None:
        ids, n, letter = word_features(words, self.m.buckets, self.m.lexicon, self.k)
        self.own.extend((total(self.m.weight[ids], n) * letter[:, None]) if self.k else np.zeros((len(words), 1)))
        self.letters.extend(letter)

    def __call__(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        m, k = self.m, self.k
        if self.table.tidy():
            self.own.clear()
            self.letters.clear()
        split = Split(texts)
        mass = np.zeros((len(texts), max(k, 1)))
        r = self.table.rows(split)
        if len(r) and k:
            scores, counted = self.own.data[r], self.letters.data[r]
            for f, z, x, p in chain(scores, split.n, m.step, m.start):
                p *= _padded(counted, f, z)[:, :, None]
                np.add.at(mass, x, p.sum(1))
        words = mass.sum(1)
        best = mass.argmax(1)
        known = words > 0
        names = [m.langs[i] if ok else "und" for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.clip(np.where(known, mass[np.arange(len(mass)), best] / np.where(known, words, 1), 0.0), 0, 1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row; ``und`` and 0 for texts that are null or have no letter, or if no language was learnt.

    Repeated rows each get their row, a null doc_id stays null, an empty table gives an empty result; of equally likely languages the
    first by name is taken; other columns are ignored whatever their names. A text of any length is one chain.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs_of(docs)

    def run(batches):
        label = Labeller(sent.value)
        for b in pieces(batches, most=SLICE):
            names, share = label(raw(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is in a learnt language with a share of ``least`` or more; all columns as they are.

    Whole rows pass through, repeated ones and nulls in other columns too, so no join puts texts and predictions together again.
    """
    if docs.columns.count(text_col) != 1:
        raise ValueError(f"two columns are called {text_col}")
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        label = Labeller(sent.value)
        for part in pieces(batches, text_col, SLICE):
            names, share = label(raw(part.column(at)))
            good = np.array([x != "und" for x in names], bool) & (share >= least)
            yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
