import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import cases
from tillroll.llm import packing
from tillroll.llm.encoder import MARKS, WordEncoder, _Cache
from tillroll.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, got, window=2048):
    """rows: (doc_id, text), ids unique or rows equal."""
    texts = dict(rows)
    seen = Counter(i for i, _ in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(seen)
    for i, pieces in by_doc.items():
        ids = ids_of(texts[i])
        spans = Counter()
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["doc_tokens"] == len(ids) and len(part) == r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            spans.update(range(r["start"], r["start"] + r["length"]))
        assert spans == Counter({k: seen[i] for k in range(len(ids))})
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding < window


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in cases.given()]
    check(rows, QUERIES["op7_packing"](spark, cases.SF).collect())


def test_odd_texts(spark):
    rows = cases.odd_rows(["it's <|endoftext|> x<|startoftext|>y İ. ×a÷ don't", "ÀÉ straße", "日本語 テキスト。", "a" * 5000])
    docs = cases.frame(spark, rows)
    check([(r[0], r[1]) for r in rows], packing.pack(docs, PATH).collect())


def test_small_window_and_empty_table(spark):
    rows = [(i, "one two three " * (i % 9)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, packing.pack(docs, PATH, window=16).collect(), window=16)
    assert packing.pack(cases.empty(spark), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZéÉßİıĀ ×÷'.,!?<|>0179\t\n_-$ĳ́日 …"), max_size=40))
def test_ids_as_by_the_tokenizer(text):
    got = np.frombuffer(ENCODER.encode([text.encode()])[0], "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(65, np.int64)
    histogram[1:] = rng.integers(0, [5, 100, 3, 400][seed], 64)
    histogram[17] += 1000 * seed
    plan = packing.make_plan(histogram)
    cells = Counter()
    for n in range(1, 65):
        rank = np.arange(histogram[n])
        sequence, offset = plan.place(np.full(len(rank), n), rank)
        for s, o in zip(sequence.tolist(), offset.tolist()):
            cells.update(s * 64 + o + k for k in range(n))
    assert max(cells.values()) == 1
    assert sum(cells.values()) == int((histogram * np.arange(65)).sum())


def test_repeat_counts_solve_an_exact_histogram():
    histogram = np.zeros(65)
    for combo, n in (((20, 44), 7), ((10, 54), 3), ((64,), 5)):
        for part in combo:
            histogram[part] += n
    combos = [(64,), (20, 44), (10, 54)]
    assert np.allclose(packing.repeat_counts(histogram, combos), [5, 7, 3], atol=1e-3)


def test_values_set_aside_are_taken_back():
    made = []
    cache = _Cache(lambda key: made.append(key) or key * 2, 3)
    for key in (b"a", b"b", b"c", b"d", b"x" * 100):
        assert cache[key] == key * 2
    cache.trim()
    assert not len(cache) and cache[b"a"] == b"aa" and made.count(b"a") == 1
    for _ in range(2):  # what did not come again is gone after the next time
        for key in (b"a", b"e", b"f", b"g"):
            assert cache[key] == key * 2
        cache.trim()
    assert cache[b"b"] == b"bb" and made.count(b"b") == 2 and made.count(b"a") == 1


def test_words_with_a_mark_behind():
    for word in ["Word", "ZEBRA", "it"]:
        for mark in ["", *MARKS.decode()]:
            for text in (word + mark, f"{word}{mark}{mark}", f"{mark}{word}", f"{word}'s{mark}", f"é{word}{mark}"):
                assert np.frombuffer(ENCODER.encode([text.encode()])[0], "<u4").tolist() == ids_of(text)[:-1], text
