"""Embedding classifier: tree, gradient, and labels with words that training has never seen whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import classify, embed, evaluate, linear

STEMS = {"01.1.1.1.1": "froma", "01.1.2.1.1": "lait", "01.2.1.1.1": "pomm", "02.1.1.1.1": "bier", "02.2.1.1.1": "viniq"}
ENDS = ["ge", "ges", "gerie", "ine", "ette", "ade", "on", "ier", "iste", "al"]


def rows(seed, n, ends):
    """Labels whose code follows from the beginning of one word, among words that say nothing."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        code = list(STEMS)[int(rng.integers(5))]
        words = [STEMS[code] + str(rng.choice(ends)), *rng.choice(["le", "grand", "petit", "rouge", "frais"], 2)]
        out.append((i, " ".join(rng.permutation(words)), code))
    return out


def test_huffman_puts_frequent_codes_on_top():
    tree = embed.huffman([("c", 1), ("a", 10), ("b", 2), ("d", 1)])
    depth = dict(zip(tree.codes, (tree.right + tree.left).sum(0)))
    assert depth == {"a": 1, "b": 2, "c": 3, "d": 3}
    p = embed.probabilities(np.random.default_rng(0).normal(size=(6, 4)), np.random.default_rng(1).normal(size=(3, 4)), tree)
    assert np.allclose(p.sum(1), 1) and (p > 0).all()
    assert embed.huffman([("a", 3)]).right.shape == (0, 1)


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    tree = embed.huffman([("a", 3), ("b", 2), ("c", 1)])
    table, inner = rng.normal(size=(6, 4)), rng.normal(size=(2, 4))
    texts, code = [np.array([0, 2, 2, 5])], np.array([1])

    def loss(table, inner):
        return -np.log(embed.probabilities(embed._means(table, texts), inner, tree)[0, 1])

    by_node, used, by_row = embed.gradients(table, inner, tree, texts, code, np.ones(1))
    assert used.tolist() == [0, 2, 5]
    whole = np.zeros_like(table)
    whole[used] = by_row
    for old, slope, first in ((table, whole, True), (inner, by_node, False)):
        for cell in np.ndindex(old.shape):
            moved = old.copy()
            moved[cell] += 1e-6
            change = (loss(*((moved, inner) if first else (table, moved))) - loss(table, inner)) / 1e-6
            assert slope[cell] == pytest.approx(change, abs=1e-4)


def test_unseen_words_beat_naive_bayes_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(embed, "PART_TEXTS", 120)
    schema = "row_id long, label string, code string"
    train = spark.createDataFrame(rows(1, 300, ENDS[:6]), schema)
    test = spark.createDataFrame(rows(2, 120, ENDS[6:]) + [(900, None, list(STEMS)[0]), (901, "zzz", list(STEMS)[0])], schema)
    settings = dict(dim=16, passes=2, epochs=8, buckets=20_000)
    got = embed.embedding_classifier(train, test, "code", "label", "row_id", **settings).collect()
    again = embed.embedding_classifier(train, test, "code", "label", "row_id", **settings).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 121
    plain = classify.flat_classifier(train, test, "code", "label", "row_id")
    f1 = [
        evaluate.classification_metrics(df, "code", "FLAT_PRED").first()["f1"]
        for df in (spark.createDataFrame(got), plain)
    ]
    assert f1[0] > 0.9 > f1[1] + 0.2, f1


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "row_id long, label string, code string")
    test = spark.createDataFrame([(1, "lait")], "row_id long, label string")
    got = embed.embedding_classifier(empty, test, "code", "label", "row_id", dim=4, passes=1, epochs=1).collect()
    assert [(r["FLAT_PRED"], r["CONFIDENCE"]) for r in got] == [(None, None)]
    one = spark.createDataFrame([(1, "lait", "c"), (2, "", "c")], "row_id long, label string, code string")
    got = embed.embedding_classifier(one, test, "code", "label", "row_id", dim=4, passes=1, epochs=1).collect()
    assert [(r["FLAT_PRED"], r["CONFIDENCE"]) for r in got] == [("c", 1.0)]
    assert embed.predict(classify.distinct_labels(test.where(F.lit(False)), "label"), embed.fit(linear.count_texts(one, "code", "label"), dim=4, passes=1, epochs=1)).collect() == []


def test_vectors_too_large_to_broadcast(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(embed, "PART_TEXTS", 60)
    schema = "row_id long, label string, code string"
    train = spark.createDataFrame(rows(1, 100, ENDS[:6]), schema)
    test = spark.createDataFrame(rows(2, 20, ENDS[6:]), schema)
    settings = dict(dim=4, passes=2, epochs=1, buckets=500)
    large = embed.embedding_classifier(train, test, "code", "label", "row_id", **settings).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    small = embed.embedding_classifier(train, test, "code", "label", "row_id", **settings).collect()
    assert len(large) == 20 and sorted(map(str, large)) == sorted(map(str, small))
