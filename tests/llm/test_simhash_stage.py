"""The pipeline's near-duplicate stage: SimHash shards, BK-trees and the exact way of short texts."""

from itertools import combinations

import numpy as np
import pytest

from matquarry.llm import bkforest, shingles


def components(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"] for r in shingles.drop_near_duplicates(docs, **more).collect()}


def test_short_texts_with_four_fifths_of_their_shingles_in_common_always_meet(spark):
    """Of 10 shingles the shorter text has 8. Bands of min-hashes lost all of these pairs."""
    rows = []
    for i, seed in enumerate((12, 290, 359, 488, 1632, 1635, 2257, 2495)):
        words = [f"s{seed}w{k}" for k in range(14)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:12]))]
    assert components(spark, rows) == set(range(0, 16, 2))


def test_cut_shards_give_the_same_components(spark):
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(60):
        own = list(words)
        for at in range(0, 1 + i % 3):
            own[(17 * i + 61 * at) % 200] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(60), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    want = {root(i) for i in range(60)}
    assert components(spark, rows, shard_rows=4) == want == components(spark, rows)


@pytest.mark.parametrize("seed", range(20))
def test_trees_of_many_shards_equal_the_plain_loop(seed):
    rng = np.random.default_rng(seed)
    n, radius = int(rng.integers(1, 60)), int(rng.integers(0, 40))
    shard = np.sort(rng.integers(0, 1 + n // 15, n)).astype(np.int64)
    prints = rng.integers(0, 2**63, (3, 2)).astype(np.uint64)[rng.integers(0, 3, n)]
    for row in prints:
        for bit in rng.choice(128, int(rng.integers(0, 30)), replace=False).tolist():
            row[bit // 64] ^= np.uint64(1 << bit % 64)
    got = bkforest.components(shard, np.zeros(n, bool), (prints[:, 0].copy(), prints[:, 1].copy()), radius)
    want = list(range(n))
    for i, j in combinations(range(n), 2):
        if shard[i] == shard[j] and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= radius:
            a, b = want[i], want[j]
            want = [min(a, b) if x in (a, b) else x for x in want]
    assert got.tolist() == want
