import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tillroll.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    out = []
    for value in row:
        text = None if value is None else str(value)
        out.append("-" if text is None else f"{len(text.encode())}:{text}")
    return digest(*out)


def climb(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def path(levels, at):
    """(nodes of the run, place) from a leaf up."""
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append((level[first : first + 16], at - first))
        at //= 16
    return out


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """Rows of (doc_id, text, lang, source, n_chars)."""
    leaves = []
    for i, text, lang, source, n in rows:
        changed = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        leaves.append(
            (source, i, leaf((i, source, lang, n, text)), leaf((i, source, lang, n, lower(text))) if changed else None)
        )
    key = lambda s: (s is not None, (s or "").encode())
    leaves.sort(key=lambda v: (key(v[0]), v[1] is not None, v[1] or 0, v[2]))
    trees = [(s, list(g)) for s, g in groupby(leaves, key=lambda v: v[0])]
    sub = [climb([v[2] for v in g]) for _, g in trees]
    top = climb([levels[-1][0] for levels in sub])
    out = []
    for t, (_, g) in enumerate(trees):
        for at, (_, i, own, changed) in enumerate(g):
            steps = path(sub[t], at) + path(top, t)
            now, others = changed or own, []
            for run, place in steps:
                others += run[:place] + run[place + 1 :]
                now = digest(*run[:place], now, *run[place + 1 :])
            root = top[-1][0]
            out.append((i, own, sub[t][-1][0], root, digest(*others), now, now == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(docs, depth=merkle.DEPTH):
    return sorted((tuple(r) for r in merkle.manifest(docs, depth).select(*COLUMNS).collect()), key=repr)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in cases.given()]
    got = found(spark.read.parquet(f"{cases.SF}/documents.parquet"))
    assert got == brute(rows)
    assert {True, False} == {r[-1] for r in got}


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_blocks_of_any_depth_give_the_same_tree(spark, depth):
    sizes = {None: 16, "a": 1, "b": 17, "c": 256, "Hot": 4200, "é": 300}
    rows = [(100 * i + len(s or ""), f"Text {i} OF {s}", "en", s, i) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs, depth) == brute(rows)


def test_odd_rows_and_clashing_names(spark):
    odd = cases.odd_rows(["long" * 300_000, "x" * 1_000_000 + "Y"])
    docs = cases.frame(spark, odd).select("*", *[F.lit(1).alias(c) for c in ("k", "rank", "hash", "item", "block", "__at", "path")])
    assert found(docs) == brute([r[:5] for r in odd])


def test_empty_table_and_one_row(spark):
    assert found(cases.empty(spark)) == []
    one = [(5, "A", None, None, 1, None, None)]
    assert found(cases.frame(spark, one)) == brute([one[0][:5]])


def test_versions_copy_only_ancestors(spark):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    built = merkle.build(docs, depth=1)
    folded = {r[0]: r[5] for r in brute(rows)}
    versions = built.versions().collect()
    assert len(versions) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(700))
    for v in versions:
        assert len(v["copies"]) == 4 and v["copies"][0] == v["changed"] and v["copies"][-1] == folded[v["id"]]
    shared = "".join(r["nodes"] for r in built.runs().collect())
    assert len(shared) == 64 * (700 + 44 + 3)  # the nodes below the root, once each
