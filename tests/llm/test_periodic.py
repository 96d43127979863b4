"""Periodic runs, against a scan of all distances."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest

from quernstone.llm import periodic
from quernstone.llm import queries as Q


def every_run(w):
    n, seen = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                seen.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, z, q) for (s, z), q in seen.items()), key=lambda r: (r[0], r[2]))


def planted(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def row(w, doc_id):
    found = every_run(w)
    gone = {i for s, z, q in found for i in range(s + q, s + z)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, sha("".join(f"{s},{z},{q}\n" for s, z, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(8))
def test_all_runs(seed):
    rng = np.random.default_rng(seed)
    for _ in range(150):
        n = int(rng.choice([0, 1, 11, 12, 13, 20, 40, 80, 200]))
        w = rng.integers(0, rng.integers(1, 6), n)
        for _ in range(rng.integers(0, 4)):
            if n > 4:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, max(2, n // 3)))
                e = int(rng.integers(a, n))
                for i in range(a, e):
                    w[i] = w[a + (i - a) % p]
        alive = periodic.repeated(w, np.zeros(n, np.int64))
        assert [tuple(r) for r in periodic.runs(w, alive).tolist()] == every_run(w.tolist())


def test_scales_hold_a_block():
    for n in (2, 12, 30, 1000):
        seen = [(q, b) for b, low, high in periodic.scales(n) for q in range(low, high + 1)]
        assert [q for q, _ in seen] == list(range(1, n // 2 + 1))
        assert all(2 * b - 1 <= max(q, 12 - q) < 4 * b - 1 for q, b in seen)


def test_windows_do_not_show(monkeypatch):
    monkeypatch.setattr(periodic, "WINDOW", 8)
    monkeypatch.setattr(periodic, "SEEDS", 5)
    w = np.array(([1, 2, 3] * 30 + [4] * 40 + list(range(50))) * 2)
    assert [tuple(r) for r in periodic.runs(w).tolist()] == every_run(w.tolist())


def test_long_runs_take_little_time():
    start = time.perf_counter()
    assert periodic.runs(np.zeros(30_000, np.int64)).tolist() == [[0, 30_000, 1]]
    assert len(periodic.runs(np.arange(30_000) % 500)) == 1
    assert time.perf_counter() - start < 30


def test_op11(spark, docs, texts, tmp_path):
    more = {300 + i: " ".join(f"w{(i * j) % 97}" for j in range(20 * i)) for i in range(40)}
    more |= {400 + i: texts[11] for i in range(30)}
    rows = [*texts.items(), *more.items(), (3, texts[3]), (None, texts[5]), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "'x' as words", "text as collapsed").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    want = [row(planted(split(t), i), i) for i, t in rows]
    assert sum(r[1] > 0 for r in want) > 12
    got = Q.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty(spark, empty):
    assert periodic.periodic_runs(empty).collect() == []
