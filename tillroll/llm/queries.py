"""One query per operator of this subpackage, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_secrets(spark, sf_dir):
    from tillroll.llm import secrets

    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.trained(docs))


@query
def op6_pii(spark, sf_dir):
    from tillroll.llm import pii

    docs = table(spark, sf_dir, "documents")
    model = pii.train(*pii.labelled_sequences(docs))
    return pii.find_pii(docs, model)


@query
def op8_quality(spark, sf_dir):
    from tillroll.llm import quality

    return quality.judge(table(spark, sf_dir, "documents"))


@query
def op9_simhash(spark, sf_dir):
    from tillroll.llm import simhash

    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)


@query
def op5_mixing(spark, sf_dir):
    from tillroll.llm import mixing

    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_packing(spark, sf_dir):
    import public_tokenizers

    from tillroll.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_repeats(spark, sf_dir):
    from tillroll.llm import repeats

    done = repeats.remove_repeats(table(spark, sf_dir, "documents"), window=200)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_topk(spark, sf_dir):
    from tillroll.llm import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


@query
def op10_language(spark, sf_dir):
    from tillroll.llm import language

    docs = table(spark, sf_dir, "documents")
    held_out = language.is_held_out("doc_id")
    profiles = language.learn(docs.where(~held_out))
    said = language.predict(docs, profiles)
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    from tillroll.llm import unigram

    return unigram.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_manifest(spark, sf_dir):
    from tillroll.llm import merkle

    return merkle.manifest(table(spark, sf_dir, "documents"))


@query
def op12_search(spark, sf_dir):
    from tillroll.llm import lexical

    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query
def op11_classifier(spark, sf_dir):
    from tillroll.llm import classifier

    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
