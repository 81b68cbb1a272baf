import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm import cases
from tillroll.llm import unigram
from tillroll.llm.queries import QUERIES


def tokenizer(vocabulary):
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")]
    )
    return t


def length(t, text):
    return len(t.encode(text, add_special_tokens=False).ids)


FULL = unigram.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
FULL_TOKENIZER, FULL_COUNTER = tokenizer(FULL), unigram.PieceCounter(FULL)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("the andingé漢😀▁.,0\x1c　 \n"), max_size=40))
def test_counts_as_by_the_tokenizer(text):
    assert FULL_COUNTER.count(text)[0] == length(FULL_TOKENIZER, text)


@settings(max_examples=400, deadline=None)
@given(
    st.dictionaries(st.text("ab▁", min_size=1, max_size=4), st.integers(-4, -1), min_size=1, max_size=12),
    st.text("abc ", max_size=14),
)
def test_ties_as_by_the_tokenizer(pieces, text):
    vocabulary = [(p, float(s)) for p, s in pieces.items()]
    assert unigram.PieceCounter(vocabulary).count(text)[0] == length(tokenizer(vocabulary), text)


def test_query(spark):
    got = {r["doc_id"]: (r["n_tokens"], r["n_words"]) for r in QUERIES["op4_token_counts"](spark, cases.SF).collect()}
    want = {r["doc_id"]: (length(FULL_TOKENIZER, r["text"] or ""), len((r["text"] or "").split())) for r in cases.given()}
    assert got == want


def test_odd_texts_and_empty_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = cases.odd_rows()
    got = unigram.count_tokens(cases.frame(spark, rows), path, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == length(FULL_TOKENIZER, r["text"] or "")
    assert unigram.count_tokens(cases.empty(spark), path).count() == 0
