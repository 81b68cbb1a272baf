import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from tillroll.llm import blocks, repeats
from tillroll.llm.queries import QUERIES


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    n = Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if n[t[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), spans, kept))
    return out


def check(rows, got, window):
    want = Counter((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], window)))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in cases.given()]
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op3_repeats"](spark, cases.SF).collect()}
    want = brute([t for _, t in rows], 200)
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(rows, want)}


@pytest.mark.parametrize("crowd", [1 << 15, 1])
@pytest.mark.parametrize("positions", [1 << 20, 256])
def test_passages_and_odd_texts(spark, monkeypatch, crowd, positions):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(blocks, "POSITIONS", positions)
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefé"), 4)) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    passage = prose(60)
    base = prose(120)
    texts = [
        base, base, base[:300] + "X" + base[301:], base[5:250], prose(40) + passage + prose(40), passage,
        passage[:199], passage[:200], passage[3:203] + "!" + passage[10:215], "a" * 500, "a" * 150, "ab" * 200,
        prose(30) + "a" * 230 + prose(30), base[:250] + passage + base[100:400], prose(10),
    ]
    rows = [*cases.odd_rows(texts)]
    rows = [r if r[1] is None or len(r[1]) < 10000 else (r[0], r[1][:2500], *r[2:]) for r in rows]
    docs = cases.frame(spark, rows)
    check([(r[0], r[1]) for r in rows], repeats.remove_repeats(docs).collect(), 200)


def test_common_strings_below_the_window_stay(spark):
    rng = np.random.default_rng(10)
    common = "".join(rng.choice(list("abcdefgh "), 190))
    texts = ["".join(rng.choice(list("abcdefgh "), 300)) + common + "".join(rng.choice(list("xyz "), 300)) for _ in range(4)]
    docs = cases.frame(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)])
    got = repeats.remove_repeats(docs).collect()
    assert [r["n_removed"] for r in got] == [0] * 4
    check(list(enumerate(texts)), got, 200)


def test_other_window(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab"), 90)) + "the quick brown fox jumps over it" for _ in range(20)]
    docs = cases.frame(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)])
    check(list(enumerate(texts)), repeats.remove_repeats(docs, window=24).collect(), 24)


def test_empty_table(spark):
    assert repeats.remove_repeats(cases.empty(spark)).count() == 0


def test_each_window_start_has_one_anchor(monkeypatch):
    monkeypatch.setattr(blocks, "POSITIONS", 300)
    rng = np.random.default_rng(9)
    data = rng.integers(97, 100, 2000).astype(np.uint8)
    offsets = np.array([0, 0, 50, 700, 700, 2000])
    starts = []
    for _, at, low, high, begin in blocks.anchors(data, offsets, 40, 20):
        assert ((low <= at) & (at < high + 20) & (at - low < 256)).all()
        starts += [begin + s for a, b in zip(low, high) for s in range(a, b + 1)]
    want = [s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - 39)]
    assert sorted(starts) == want
