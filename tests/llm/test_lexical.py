import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tillroll.llm import lexical


def cut(text):
    out, word = [], ""
    for c in text or "":
        if "A" <= c <= "Z":
            c = c.lower()
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127:
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out + ([word] if word else [])


def brute(docs, items, k):
    """(doc_id, text) and (item_id, text) to sorted (item_id, rank, doc_id, score)."""
    counted = [(i, Counter(cut(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, all_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(cut(text)), []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // all_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in asked.items()
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scores)[:k]):
            out.append((item, rank + 1, None if null else i, -score))
    return sorted(out, key=repr)


def found(docs, items, k=20, **more):
    got = lexical.search(docs, items, k, **more).select("item_id", "rank", "doc_id", "score")
    return sorted((tuple(r) for r in got.collect()), key=repr)


ITEMS = "item_id long, text string"


@pytest.mark.parametrize("query_bytes", [1 << 20, 200])
def test_odd_rows_ties_and_repeats(spark, query_bytes):
    odd = cases.odd_rows(["word two", "word two", "Word TWO zwei", "漢字 漢字 text", "long" * 100_000, "x1 " * 50_000 + "one"])
    items = [(1, "WORD two one, one"), (2, None), (3, ""), (None, "漢字 text"), (1, "WORD two one, one"), (5, "missing"), (6, "x1 " * 500)]
    docs = cases.frame(spark, odd).select("*", *[F.lit(0).alias(c) for c in ("id", "n", "ids", "rank", "score", "task", "__text")])
    got = found(docs, spark.createDataFrame(items, ITEMS), 4, query_bytes=query_bytes)
    assert got == brute([r[:2] for r in odd], items, 4)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], ITEMS)
    assert found(cases.empty(spark), items) == []
    assert found(cases.frame(spark, cases.odd_rows()), spark.createDataFrame([], ITEMS)) == []
    assert found(cases.frame(spark, [(1, None, None, None, None, None, None)]), items) == []


def test_small_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_ROWS", (16, 16))
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"w{int(v)}" for v in rng.zipf(1.3, rng.integers(1, 60)) % 400)) for i in rng.permutation(700)]
    items = [(q, " ".join(f"w{int(v)}" for v in rng.zipf(1.2, 12) % 400)) for q in range(30)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), 5)
    assert got == brute(rows, items, 5)


def test_search_stops_before_it_has_seen_all():
    rng = np.random.default_rng(5)
    size, vocabulary = 4000, 40
    tf = np.where(rng.random((size, vocabulary)) < 0.5, rng.geometric(0.3, (size, vocabulary)), 0)
    tf[[7, 9]] = np.where(np.arange(vocabulary) < 8, 60, 0)  # two documents that hold the asked terms often
    n = tf.sum(1)
    doc, term = np.nonzero(tf)
    bounds = np.searchsorted(doc, np.arange(size + 1))
    shard = lexical.Shard(n, bounds, term, tf[doc, term], size, int(n.sum()))
    asked, weight = np.arange(8), np.full(8, 1000)
    got, scores = shard.search(asked, weight, 2, np.zeros(0, np.int64))
    m = lexical.lengths(n, size, int(n.sum()))
    exact = (1000 * ((10**9 * tf[:, :8]) // (1000 * tf[:, :8] + 12 * m[:, None]))).sum(1)
    order = np.lexsort((np.arange(size), -exact))[:2]
    assert got.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()
    assert 0 < shard.looked_at < size / 2
    # a floor of k better scores leaves nothing to find
    assert len(shard.search(asked, weight, 2, np.array([10**12] * 2))[0]) == 0 and shard.looked_at == 0


def test_length_measure_beyond_64_bits():
    n = np.array([1, 1 << 40, 1 << 50])
    assert lexical.lengths(n, 1 << 35, 1 << 60).tolist() == [75 + 25 * int(v) * (1 << 35) // (1 << 60) for v in n]
