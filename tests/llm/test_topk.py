import math

import numpy as np
import pytest

from tillroll.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def brute(rows, k, every):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = 1
    out = []
    for i, q in good:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_nulls_ties_lengths_and_repeats(spark, shard_rows):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 16).tolist(), 0, "x", 9) for i in range(300)]
    rows += [(300 + i, rows[7][1], 0, None, None) for i in range(60)]  # ties
    rows += rows[:20]  # repeats
    rows += [
        (400, None, None, None, None), (450, [], None, None, None), (500, [0.5, None], 1, None, None),
        (550, [float("nan")] * 16, 1, None, None), (600, [float("-inf")] * 16, 1, None, None), (None, [0.1] * 16, 1, None, None),
        (700, [0.25, -0.5], 1, None, None), (701, [0.001, -0.001], 1, None, None), (0, [0.0] * 16, 1, None, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(docs, 5, 50, shard_rows=shard_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 50)


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_index_proves_before_it_leaves_out(seed):
    rng = np.random.default_rng(seed)
    n, dims = 500, 8
    values = np.floor(256 * rng.normal(0, [0.3, 0.02][seed % 2], (n, dims)) ** [1, 3][seed // 3]).astype(np.int64)
    ids = rng.permutation(n) + 10
    index = topk.ImpactIndex(ids, values)
    asked = np.arange(0, n, 25)
    best = index.best(values[asked], ids[asked], 5)
    possible = index._possible_rows(values[asked], ids[asked], 5)
    for q, got, rows in zip(asked, best, possible):
        scores = values @ values[q]
        order = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != ids[q])[:5]
        assert got == [(i, -s) for s, i in order]
        assert {i for _, i in order} <= set(index.ids[rows].tolist())
    assert sum(map(len, possible)) < 0.2 * n * len(asked)


def test_large_components():
    values = np.array([[1 << 40, -5], [-(1 << 40), 7], [3, 4], [1 << 20, 1], [2, 2]] * 6, np.int64)
    ids = np.arange(len(values))
    index = topk.ImpactIndex(ids, values)
    queries = np.array([[1, 1], [1 << 20, 0], [0, 1 << 59]])
    for query, got in zip(queries, index.best(queries, np.array([0, 7, 100]), 3)):
        own = {0: 0, 1: 7, 2: 100}[[q.tolist() for q in queries].index(query.tolist())]
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(v, query)), i) for i, v in enumerate(values) if i != own)
        assert got == [(i, -s) for s, i in exact[:3]]
    with pytest.raises(OverflowError):
        index.best(np.array([[1 << 40, 0]]), np.array([100]), 3)


def test_components_beyond_a_long_take_no_part(spark):
    rows = [(0, [0.5, 0.5], 0, None, None), (1, [1e30, 0.0], 0, None, None), (2, [0.25, 0.0], 0, None, None)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 128 * 64)]
