import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tillroll.llm import classifier, gam
from tillroll.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int, text string"


def area(score, y):
    """Area under the curve of hits over false alarms, by ranks."""
    order = np.argsort(score, kind="stable")
    _, first, count = np.unique(np.asarray(score)[order], return_index=True, return_counts=True)
    rank = np.empty(len(score))
    rank[order] = np.repeat(first + (count + 1) / 2, count)
    ones = np.asarray(y) == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def brute_score(model, row):
    """Look-ups one by one, bins by counting the cuts below."""
    total = model.intercept
    for x, edges, table in zip(row, model.edges, model.tables):
        total += table[sum(x > e for e in edges)]
    for (a, b), table in zip(model.pairs, model.pair_tables):
        total += table[sum(row[a] > e for e in model.pair_edges[a]), sum(row[b] > e for e in model.pair_edges[b])]
    return 1 / (1 + np.exp(-total))


def test_scores_are_sums_of_look_ups_and_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    logit = 6 * (x[:, 0] - 0.5) + 8 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 4
    y = (rng.random(4000) < 1 / (1 + np.exp(-logit))).astype(int)
    model = gam.train(x[:3000], y[:3000], n_pairs=2)
    assert (1, 2) in model.pairs
    got = model.score(x[3000:])
    assert np.allclose(got[:50], [brute_score(model, r) for r in x[3000:3050]])
    no_pairs = gam.train(x[:3000], y[:3000], n_pairs=0)
    assert area(got, y[3000:]) > 0.9 > area(no_pairs.score(x[3000:]), y[3000:]) + 0.05
    assert (gam.train(x[:3000], y[:3000], n_pairs=2).score(x) == model.score(x)).all()


def test_shallow_tree_takes_the_best_splits():
    g, h = np.array([4.0, 4, 4, -9, -9, 1, 1]), np.ones(7)
    assert gam.shallow_tree(g, h, 3, 0.0, 1.0).tolist() == [4, 4, 4, -9, -9, 1, 1]
    assert gam.shallow_tree(g, h, 1, 0.0, 1.0).tolist() == [g.mean()] * 7
    assert gam.shallow_tree(g, h, 9, 0.0, 8.0).tolist() == [g.mean()] * 7


@pytest.mark.parametrize("y", [[], [1], [0] * 30, [1] * 30])
def test_little_to_learn_from(y):
    x = np.ones((len(y), 3))
    got = gam.train(x, np.array(y, int)).score(np.zeros((2, 3)))
    assert np.allclose(got, (sum(y) + 1) / (len(y) + 2))


def plain_features(text):
    """Some features, character by character."""
    words = text.split()
    letters = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    lines = [t for t in text.split("\n") if t.strip()]
    return {
        "log_words": np.log1p(len(words)),
        "upper": sum("A" <= c <= "Z" for c in text) / letters,
        "shout": text.count("!") / len(text),
        "bar": text.count("|") / len(text),
        "distinct": len(set(words)) / len(words),
        "most_frequent": max(words.count(w) for w in set(words)) / len(words),
        "repeated_triples": 1 - len(set(triples)) / len(triples),
        "words_a_line": len(words) / len(lines),
        "repeated_lines": 1 - len(set(lines)) / len(lines),
    }


def test_features_against_plain_counts():
    texts = ["", "A b! C d | é é\nsame line here\nsame line here\n\nB", "x " * 500 + "END", " \n "]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = classifier.text_features(data, offsets)
    assert got.shape == (4, len(classifier.FEATURES)) and not got[0].any() and not got[3].any()
    for i in (1, 2):
        row = dict(zip(classifier.FEATURES, got[i]))
        for name, value in plain_features(texts[i]).items():
            assert row[name] == pytest.approx(value), name


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op11_classifier"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.3)
    held = [(got[r["doc_id"]], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    y = np.array([q for _, q in held])
    assert len(y) > 500 and area([r["score"] for r, _ in held], y) > 0.9
    assert np.mean([r["predicted"] for r, q in held if q == 1]) > 0.97


def test_labels_of_held_out_ids_change_nothing(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    labels = spark.read.parquet(f"{cases.SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(classifier.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (sorted(classifier.classify(docs, t).collect()) for t in (labels, turned))
    assert one == other


def test_odd_rows(spark):
    odd = cases.odd_rows(["W" * 300_000, "123 " * 5])
    docs = cases.frame(spark, odd).select("*", *[F.lit(1).alias(c) for c in ("score", "x", "y", "id", "quality", "__text")])
    labels = spark.createDataFrame([(i, i % 2, None, "t") for i in range(12)] + [(1, 1, 0, "t"), (None, 1, 1, None), (4, None, 0, "")], LABELS)
    got = classifier.classify(docs, labels).collect()
    assert len(got) == len(odd)
    by_text = {}
    for r, (i, text, *_) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(odd, key=lambda r: (r[0] is None, r[0] or 0))):
        assert r["doc_id"] == i and 0 <= r["score"] <= 1
        assert by_text.setdefault((text or "").strip(), r["score"]) == r["score"]


def test_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0, "t")], LABELS)
    assert classifier.classify(cases.empty(spark), labels).collect() == []
    no_labels = spark.createDataFrame([], LABELS)
    got = classifier.classify(cases.frame(spark, cases.odd_rows()), no_labels).collect()
    assert {r["score"] for r in got} == {0.5}
