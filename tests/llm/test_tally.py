"""The index of near_dedup: positional bytes are posted and tallied before sets are compared."""

import numpy as np

from quernstone.llm import minhash

from .test_exact import classes
from .test_minhash import by_component, grams, similar


def sketch(text):
    """125 bytes, of the minima one by one."""
    hashes = [int(x) for x in minhash.shingles(text.encode())]
    factors, shifts = (x.ravel().tolist() for x in (minhash._FACTOR, minhash._SHIFT))
    return [min((h * f + s) % 2**64 for h in hashes) >> 32 & 255 for f, s in zip(factors, shifts, strict=True)]


def corpus():
    """A text of 200 random words with copies on both sides of what is tallied: similarities of 0.9, and of 0.4 to 0.55."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    out = {0: " ".join(base)}
    for i in range(1, 60):
        w = list(base)
        for at in rng.choice(200, 2 if i % 3 == 0 else 12 + i % 5, replace=False):
            w[at] = f"new{rng.integers(0, 10**6)}"
        out[i] = " ".join(w)
    return out


def test_keys_are_positional_bytes():
    text = corpus()[7]
    keys = minhash.band_keys(minhash.shingles(text.encode())).tolist()
    assert [k >> 40 for k in keys] == list(range(25))
    assert [b for k in keys for b in k.to_bytes(8, "little")[:5]] == sketch(text)
    assert len(minhash.band_keys(minhash.shingles(b" "))) == 0


def test_pairs_are_tallied(spark, monkeypatch):
    """Only pairs that share enough positional bytes have their sets compared, and none that is similar is lost."""
    texts = corpus()
    sketches = {minhash.set_id(minhash.shingles(t.encode())): sketch(t) for t in texts.values()}
    shared = lambda a, b: sum(x == y for x, y in zip(sketches[a], sketches[b], strict=True))
    compared, held, checked = [], minhash._held, minhash._similar

    def near(members, sets):
        if "part" not in members.columns:
            compared.extend((r.hub, r.set_id) for r in members.collect())
        return held(members, sets)

    monkeypatch.setattr(minhash, "_held", near)
    monkeypatch.setattr(minhash, "_similar", lambda pairs, sets: compared.extend((r.a, r.b) for r in pairs.collect()) or checked(pairs, sets))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    found = by_component(minhash.near_duplicates(docs))
    sets = {i: grams(t) for i, t in texts.items()}
    assert found == classes(sorted(texts), lambda a, b: similar(sets[a], sets[b])) and sorted(np.bincount(list(found.values())))[-1] > 15
    assert len(compared) > 15 and min(shared(a, b) for a, b in compared) >= 70
    # Others have a key in common, too.
    in_one = [(a, b) for a in sketches for b in sketches if a < b and any(sketches[a][i : i + 5] == sketches[b][i : i + 5] for i in range(0, 125, 5))]
    assert sum(shared(a, b) < 70 for a, b in in_one) > 20
