"""Text features of labels, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.text import let, words
from tillroll.plans.skew import join_weighted
from tillroll.session import stage


def _slices(length: Column, n: int, cut) -> Column:
    """`cut(i)` for each place i where a run of n fits, an empty array where none does."""
    places = F.sequence(F.lit(1), F.greatest(length - (n - 1), F.lit(1)))
    return F.when(length >= n, F.transform(places, cut)).otherwise(F.array().cast("array<string>"))


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of `low` to `high` neighbouring tokens, joined by a blank."""

    def runs(toks: Column, n: int) -> Column:
        return _slices(F.size(toks), n, lambda i: F.array_join(F.slice(toks, i, n), " "))

    return let(tokens, lambda toks: F.concat(*[runs(toks, n) for n in range(low, high + 1)]))


def char_ngrams(word: Column, low: int, high: int) -> Column:
    """All substrings of `low` to `high` characters."""

    def runs(n: int) -> Column:
        return _slices(F.length(word), n, lambda i: F.substring(word, i, F.lit(n)))

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def words_and_ngrams(label: Column, word_n: int = 3) -> Column:
    """Words and runs of up to `word_n` words."""
    return word_ngrams(words(label), 1, word_n)


def words_and_char_ngrams(label: Column, word_n: int = 3, low: int = 3, high: int = 6) -> Column:
    """Words, runs of up to `word_n` words, and after "#" the substrings of each word between "<" and ">"."""

    def pieces(w: Column) -> Column:
        return F.transform(char_ngrams(F.concat(F.lit("<"), w, F.lit(">")), low, high), lambda g: F.concat(F.lit("#"), g))

    return let(words(label), lambda ws: F.concat(word_ngrams(ws, 1, word_n), F.flatten(F.transform(ws, pieces))))


def bucket_of(ngram: Column, buckets: int) -> Column:
    """Feature number of an n-gram: its md5 folded to `buckets`."""
    return F.pmod(F.conv(F.substring(F.md5(ngram), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def _count_labels(df: DataFrame, label: str) -> DataFrame:
    """(label, n), written out: the one pass over the rows."""
    labels = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"))
    return stage(labels.agg(F.count(F.lit(1)).alias("n")), "labels")


def text_features(
    df: DataFrame,
    label: str = "DESCRIPTION_EAN_FINAL",
    word_n: int = 3,
    char_low: int = 3,
    char_high: int = 6,
    min_count: int = 3,
    buckets: int = 1_000_000,
) -> DataFrame:
    """(kind, ngram, n, bucket): word n-grams and character n-grams with their number of occurrences.

    Words rarer than `min_count` are left out before n-grams are formed.
    Character n-grams are taken from words between "<" and ">". Labels are
    counted first, so each distinct label is cut up once.
    """
    counted = _count_labels(df, label)
    pieces = counted.select("label", "n", F.posexplode(words(F.col("label"))).alias("pos", "word"))
    vocabulary = pieces.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    known = vocabulary.select("word", F.col("n").alias("__n"), F.lit(True).alias("kept"))
    kept = join_weighted(pieces, known, ["word"], ["label", "pos"], "__n").where("kept")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
    tokens = kept.groupBy("label", "n").agg(F.transform(ordered, lambda s: s["word"]).alias("tokens"))
    word_grams = tokens.select(
        F.lit("word").alias("kind"), F.explode(word_ngrams(F.col("tokens"), 1, word_n)).alias("ngram"), "n"
    )
    char_grams = vocabulary.select(
        F.lit("char").alias("kind"),
        F.explode(char_ngrams(F.concat(F.lit("<"), "word", F.lit(">")), char_low, char_high)).alias("ngram"),
        "n",
    )
    grams = word_grams.unionByName(char_grams)
    return (
        grams.groupBy("kind", "ngram")
        .agg(F.sum("n").alias("n"))
        .withColumn("bucket", bucket_of(F.col("ngram"), buckets))
    )


def terms_of(label: Column, low: int, high: int) -> Column:
    """Lower-case words of two or more letters and their n-grams."""
    tokens = F.regexp_extract_all(F.lower(label), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return word_ngrams(tokens, low, high)


def tfidf_features(
    df: DataFrame,
    label: str = "DESCRIPTION_EAN_FINAL",
    max_df: float = 1.0,
    ngram: tuple[int, int] = (1, 2),
) -> DataFrame:
    """(label, term, tfidf) for every distinct label, L2-normalised.

    idf = ln((1 + rows) / (1 + rows with the term)) + 1. Terms in more than
    `max_df` of the rows are left out. Rows are counted per label first.
    """
    counted = _count_labels(df, label)
    tf = (
        counted.select("label", "n", F.explode(terms_of(F.col("label"), *ngram)).alias("term"))
        .groupBy("label", "n", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    rows = counted.agg(F.sum("n").alias("rows")).scalar()
    terms = tf.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("labels"))
    idf = (
        terms.withColumn("rows", rows)
        .where(F.col("df") <= F.lit(max_df) * F.col("rows"))
        .select("term", "labels", (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    weighted = join_weighted(tf, idf, ["term"], ["label"], "labels")
    weighted = weighted.where(F.col("idf").isNotNull()).select(
        "label", "term", (F.col("tf") * F.col("idf")).alias("w")
    )
    # a window over the terms of one label
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("label")))
    return weighted.select("label", "term", F.round(F.col("w") / norm, 6).alias("tfidf"))
