"""The index of near_dedup loses no pair that its tally keeps."""

from itertools import combinations, product

import numpy as np
import pyarrow as pa

from quernstone.llm import minhash


def packed(rows):
    """Sketches as band_keys gives them."""
    out = np.zeros((len(rows), 25, 8), np.uint8)
    out[:, :, :5] = np.asarray(rows, np.uint8).reshape(-1, 25, 5)
    out[:, :, 5] = np.arange(25)
    return pa.array(out.view("<i8").reshape(len(rows), 25).tolist(), pa.list_(pa.int64()))


def test_a_group_with_two_differences_shares_a_key():
    base = np.arange(125, dtype=np.uint8)
    keys = set(minhash.posting_keys(base[None])[0].tolist())
    assert len(keys) == 63
    for group, gone in product(range(9), combinations(range(7), 2)):
        other = base ^ 255
        stay = [7 * group + p for p in range(7) if p not in gone]
        other[stay] = base[stay]
        shared = keys & set(minhash.posting_keys(other[None])[0].tolist())
        assert len(shared) == 1 and all(k >> 32 in range(7 * group, 7 * group + 7) for k in shared)


def test_the_least_that_the_tally_keeps_is_in_a_common_list(spark):
    """2,000 pairs that share just as many bytes as the tally asks for, and as many with one fewer, which it drops."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, 125).astype(np.uint8)
    rows = [base]
    for i in range(4000):
        x = base.copy()
        x[rng.choice(63, 26 + i % 2, replace=False)] ^= 255
        x[63 + rng.choice(62, 29 - i % 2, replace=False)] ^= 255
        rows.append(x)
    kept = minhash.enough(packed([base] * 4000), packed(rows[1:]))
    assert kept.tolist() == [i % 2 == 0 for i in range(4000)]
    groups = spark.createDataFrame([(i, 1, x) for i, x in enumerate(packed(rows).to_pylist())] + [(-1, 0, [])], "set_id bigint, size bigint, sketch array<bigint>")
    lists = {}
    for posts in minhash.postings(groups):
        for r in posts.collect():
            lists.setdefault(r.set_id, set()).add(r.key)
    assert -1 not in lists and all(len(x) == 63 for x in lists.values())
    assert all(lists[0] & lists[i + 1] for i in range(4000) if kept[i])
