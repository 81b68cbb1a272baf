import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tillroll.llm import crf, pii
from tillroll.llm.queries import QUERIES

KINDS = ("email", "ip", "card", "phone")
HARD = [
    "é a.b@c.d x@y z@@w.de me@mail-2.example.org. 😀 no@dot a@b.c@d.e %+-@-.-",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1..2.3.4 10.0.0.1.",
    "4539 1488 0343 6467 4539-1488-0343-6467 4539148803436468 0000000000000 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
    "+1 (415) 555-0132, +49.30.1234567 +1+2345678901 + 123456789 +12 3456789 ) 1 +1234567890123456",
    "1234-5678-9012-3452 4539 1488 0343 6467 +4539 1488 0343 6467",
    "1" * 10_000 + ".1.1.1 " + "0" * 10_000 + "7.1.1.1",
    "x@" + "y" * 1_000_000 + ".z",
]


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (2 if i % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def same(text, row):
    want = brute(text)
    assert [row[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in want) for k in KINDS]
    assert row["base_sha256"] == hashlib.sha256(line(want).encode()).hexdigest()
    assert {line([s]) for s in want} <= set(row["spans"].split(",")) | {""}


def test_base_spans_of_odd_texts(spark):
    rows = cases.odd_rows(HARD)
    got = pii.find_pii(cases.frame(spark, rows), None, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        same(r["text"], r)
        assert r["spans"] == line(brute(r["text"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("0123456789.+-@() ab%é\n", max_size=60), min_size=1, max_size=4))
def test_base_spans_as_by_plain_search(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    base, _ = pii.all_spans(None, data, offsets)
    assert base == [brute(t) for t in texts]


def test_query_keeps_base_spans(spark):
    texts = {r["doc_id"]: r["text"] for r in cases.given()}
    got = QUERIES["op6_pii"](spark, cases.SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        same(texts[r["doc_id"]], r)


def test_special_words():
    text = b"plain dots. a-b (x) 7 x1 @ u@v +x x+y $$$ 1.2.3.4"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, code, line = pii.words(data, offsets)
    got = [text[a:b] for a, b, s in zip(starts, ends, pii.special(code)) if s]
    assert got == [b"7", b"x1", b"@", b"u@v", b"+x", b"1.2.3.4"]
    first, length = pii.sequences(code, line, near=1)
    assert [(a, a + n) for a, n in zip(first, length)] == [(3, 12)]


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    model = crf.LinearChain(*(rng.normal(size=(6, 3)) for _ in range(3)), rng.normal(size=(3, 3)))
    codes = np.array([[0, 3, 5, 1, 2], [4, 4, 1, -1, -1], [2, -1, -1, -1, -1]])
    got = model.viterbi(codes)
    for row, labels in zip(codes, got):
        n = int((row >= 0).sum())
        e = model.emissions(row[None, :])[0]
        best = max(
            itertools.product(range(3), repeat=n),
            key=lambda y: sum(e[t, y[t]] for t in range(n)) + sum(model.moves[y[t - 1], y[t]] for t in range(1, n)),
        )
        assert tuple(labels[:n]) == best and not labels[n:].any()


def test_field_learns_shapes_in_context():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 5, (200, 12))
    labels = np.zeros_like(codes)
    labels[:, 1:] = (codes[:, 1:] == 3) & (codes[:, :-1] == 1)
    model = crf.train(codes, labels, 5, 2)
    assert (model.viterbi(codes) == labels).mean() > 0.98


def test_added_spans_stand_beside_base_spans(spark):
    lines = [f"call +49 30 {n} now" for n in range(1000000, 1000060)] + [f"mail u{n}@mail.org ok" for n in range(60)]
    docs = cases.frame(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(lines)])
    model = pii.train(*pii.labelled_sequences(docs))
    assert model is not None
    for r in pii.find_pii(docs, model, keep=("doc_id", "text")).collect():
        same(r["text"], r)


def test_masking(spark):
    docs = cases.frame(spark, cases.odd_rows(["é a.b@c.d and 10.0.0.1!"]))
    got = pii.mask_pii(docs, None)
    assert got.columns == docs.columns and got.schema == docs.schema
    texts = {r["text"] for r in got.collect()}
    assert "é [EMAIL] and [IP]!" in texts and None in texts and "" in texts
    assert pii.mask_pii(cases.empty(spark), None).count() == 0


def test_empty_table(spark):
    codes, labels = pii.labelled_sequences(cases.empty(spark))
    assert pii.train(codes, labels) is None
    assert pii.find_pii(cases.empty(spark), None).count() == 0
