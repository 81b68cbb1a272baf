import re

import numpy as np
import pytest
import xxhash

from tests.llm import cases
from tillroll.llm import bktree, simhash
from tillroll.llm.components import components
from tillroll.llm.queries import QUERIES


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[find(i)] for i in range(len(prints))]


def check(rows, got):
    prints = [brute_fingerprint(t) for _, t in rows]
    want = brute_components(prints, [i for i, _ in rows])
    key = lambda r: tuple(map(str, r))
    expected = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want)), key=key)
    assert sorted((tuple(r) for r in got), key=key) == expected


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in cases.given()]
    check(rows, QUERIES["op9_simhash"](spark, cases.SF).collect())


@pytest.mark.parametrize("size", [4096, 3])
def test_odd_texts(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "TREE_SIZE", size)
    base = " ".join(f"w{i % 37}" for i in range(400))
    near = [base.replace("w5 ", f"z{i} ", i % 4) for i in range(30)]
    rows = cases.odd_rows([base, base.upper(), *near])
    got = simhash.simhash_components(cases.frame(spark, rows)).collect()
    check([(r[0], r[1]) for r in rows], got)


@pytest.mark.parametrize("agreeing", [1, 2, 3])
def test_every_link_is_found(spark, monkeypatch, agreeing):
    monkeypatch.setattr(simhash, "TREE_SIZE", 50)
    rng = np.random.default_rng(agreeing)
    centres = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.int64)] + [0]
    words = set(centres)
    for c in centres:
        w = c
        for _ in range(int(rng.integers(0, 12))):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                w ^= 1 << int(b)
            words.add(w)
    words |= {1 << b for b in range(0, 64, 2)} | {(1 << 64) - 1}
    words = sorted(words)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    frame = spark.createDataFrame([(w,) for w in signed], "fingerprint long")
    got = {r["node"]: r["root"] for r in simhash.linked(frame, 3, agreeing).collect()}
    want = brute_components(words, signed)
    assert [got.get(s, s) for s in signed] == want


def test_forest_search_is_exact():
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(0, 2**12, 300).astype(np.uint64))
    tree = np.sort(rng.integers(0, 4, len(words)))
    forest = bktree.Forest(words, tree)
    got = set()
    for q, node in forest.search(words, tree, 2, block=37):
        got |= set(zip(q.tolist(), node.tolist()))
    want = {
        (i, j)
        for i in range(len(words))
        for j in range(len(words))
        if tree[i] == tree[j] and (int(words[i]) ^ int(words[j])).bit_count() <= 2
    }
    assert got == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 999), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 999, 999: 999}


def test_one_of_each_group_stays(spark):
    rows = cases.odd_rows(["some longer text with words " * 9] * 3)
    docs = cases.frame(spark, rows)
    got = simhash.keep_one_of_each(docs)
    assert got.schema == docs.schema
    prints = [brute_fingerprint(r[1]) for r in rows]
    groups = set(brute_components(prints, list(range(len(rows)))))
    assert got.count() == len(groups)


def test_empty_table(spark):
    assert simhash.simhash_components(cases.empty(spark)).count() == 0
    assert simhash.keep_one_of_each(cases.empty(spark)).count() == 0
