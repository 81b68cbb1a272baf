"""Columns of any name beside those an operator reads change nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tillroll.llm import language, mixing, packing, pii, quality, repeats, secrets, simhash, unigram

NAMES = (
    "__key", "__text", "__", "__masked", "key", "row", "c0", "c1", "fingerprint", "query", "shard", "masked", "k", "n", "size",
    "source_key", "draw", "__carry_0", "__rank", "__c0", "__copies", "tail", "checks", "id", "found", "kept", "window", "h",
)
LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"{LONG} {i} mail a{i}@b.org token: abcdef{i}99 call +49 30 12345{i}" for i in range(12)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)] + [(20, None, None, None, None), (21, "", "en", "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def crowded(docs):
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def rows(df, columns):
    return sorted((repr(tuple(r)) for r in df.select(*columns).collect()))


OPERATORS = {
    "secrets": lambda d: secrets.find_secrets(d, secrets.train(*secrets.labelled_candidates(d))),
    "pii": lambda d: pii.find_pii(d, pii.train(*pii.labelled_sequences(d))),
    "quality": lambda d: quality.judge(d),
    "simhash": lambda d: simhash.simhash_components(d),
    "mixing": lambda d: mixing.mix(d).select("doc_id", "size", "taken"),
    "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32"),
    "repeats": lambda d: repeats.remove_repeats(d, window=200).select("doc_id", "n_bytes", "n_removed"),
    "language": lambda d: language.predict(d, language.learn(d)),
    "unigram": lambda d: unigram.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(name, docs, crowded):
    plain = OPERATORS[name](docs)
    assert rows(OPERATORS[name](crowded), plain.columns) == rows(plain, plain.columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage(spark, name, docs, crowded):
    step = dict(corpus_pipeline.STAGES)[name]
    got = step(spark, crowded, cases.SF)
    assert got.columns == crowded.columns
    assert rows(got, docs.columns) == rows(step(spark, docs, cases.SF), docs.columns)
    assert {tuple(r) for r in got.select(*NAMES).collect()} == {tuple(range(len(NAMES)))}
