"""The linear learner against plain fits."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import linear
from tillroll.operators.classify import flat_edges, tree_edges

CODES = ["01.1.1.1.1", "01.1.2.1.1", "01.2.1.1.1", "02.1.1.1.1"]
WORDS = {"01.1.1.1.1": "milk cream fresh", "01.1.2.1.1": "cheese cream old", "01.2.1.1.1": "apple fresh red", "02.1.1.1.1": "beer red old"}


def receipts(seed=1, n=160):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        code = CODES[int(rng.integers(4))]
        words = list(rng.choice(WORDS[code].split(), 2)) + list(rng.choice(["the", "of", "big"], 1))
        rows.append((i, " ".join(words), code))
    return rows + [(n, None, CODES[0]), (n + 1, "no code", None), (n + 2, "x", CODES[3]), (n + 3, "milk cream the", CODES[1])]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(receipts(), "row_id long, label string, code string")


def plain_vectors(rows, low, high, max_df):
    """text -> {term: x}, from (text, n)."""
    def terms(text):
        words = re.findall(r"\b\w\w+\b", text.lower())
        return Counter(" ".join(words[i : i + k]) for k in range(low, high + 1) for i in range(len(words) - k + 1))

    total, df = sum(n for _, n in rows), Counter()
    for text, n in rows:
        df.update({t: n for t in terms(text)})
    out = {}
    for text, _ in rows:
        x = {t: c * (math.log((1 + total) / (1 + df[t])) + 1) for t, c in terms(text).items() if df[t] <= max_df * total}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out[text] = {t: v / norm for t, v in x.items()} | {"": 1.0}
    return out


def plain_slope(s, right, wrong, loss):
    if loss == "squared_hinge":
        short, over = np.maximum(1 - s, 0), np.maximum(1 + s, 0)
        return 2 * (wrong * over - right * short), (right * short**2 + wrong * over**2).sum()
    p = 1 / (1 + np.exp(-s))
    return wrong * p - right * (1 - p), (right * np.logaddexp(0, -s) + wrong * np.logaddexp(0, s)).sum()


def plain_fit(x, right, wrong, c, loss, rounds):
    """Weights after each round, moved by slope over curvature."""
    w = np.zeros(x.shape[1])
    weight = (right + wrong) * np.abs(x).sum(1)
    curvature = 1 + c * linear.CURVATURE[loss] * (weight[:, None] * np.abs(x)).sum(0)
    for _ in range(rounds):
        w = w - (w + c * x.T @ plain_slope(x @ w, right, wrong, loss)[0]) / curvature
    return w, 0.5 * w @ w + c * plain_slope(x @ w, right, wrong, loss)[1]


def counted(rows, keep=lambda i: True):
    return Counter((t, c) for i, t, c in rows if t is not None and c is not None and keep(i))


@pytest.mark.parametrize("loss", ["squared_hinge", "logistic"])
def test_weights_are_those_of_a_plain_fit(rows, loss):
    rounds = 5
    docs = linear.count_texts(rows, "code", "label")
    trainer = linear.Trainer(docs, [linear.Spec(0, 0, 1, 1, 0.9, 0.5, loss)], flat_edges)
    values = []
    for _ in range(rounds):
        trainer.step()
        values.append(trainer.objective().first()["objective"])
    n = counted(receipts())
    by_text = Counter()
    for (text, _), k in n.items():
        by_text[text] += k
    vectors = plain_vectors(list(by_text.items()), 1, 1, 0.9)
    texts, terms = list(by_text), sorted({t for v in vectors.values() for t in v})
    x = np.array([[vectors[t].get(w, 0.0) for w in terms] for t in texts])
    got = defaultdict(dict)
    for r in linear.weight_table(trainer.fitted()).collect():
        got[r["child"]][r["term"]] = r["weight"]
    at_end = at_best = at_start = 0.0
    for code in CODES:
        right = np.array([n[t, code] for t in texts], float)
        wrong = np.array([by_text[t] for t in texts]) - right
        want, value = plain_fit(x, right, wrong, 0.5, loss, rounds)
        assert np.allclose([got[code].get(t, 0.0) for t in terms], want, atol=1e-5), code
        at_end += value
        at_start += plain_fit(x, right, wrong, 0.5, loss, 0)[1]
        at_best += plain_fit(x, right, wrong, 0.5, loss, 5000)[1]
    assert values[-1] == pytest.approx(at_end)
    assert all(b < a for a, b in zip([at_start, *values], values))
    assert at_end - at_best < 0.2 * (at_start - at_best)  # most of the way to the minimum


def test_splits_learn_without_what_they_hold_back(rows):
    """Two splits in one fit give the weights of two fits on the rows that each keeps."""
    held = [F.col("row_id") % 3 == 0, F.col("row_id") % 3 == 1]
    docs = linear.count_texts(rows, "code", "label", held)
    both = linear.fit(docs, [linear.Spec(i, i, 1, 2, 0.8) for i in range(2)], tree_edges, 2)
    together = linear.weight_table(both)
    for i in range(2):
        alone = linear.fit(
            linear.count_texts(rows.where(~held[i]), "code", "label"), [linear.Spec(0, 0, 1, 2, 0.8)], tree_edges, 2
        )
        a = sorted(tuple(r)[1:] for r in together.where(F.col("model") == i).collect())
        b = sorted(tuple(r)[1:] for r in linear.weight_table(alone).collect())
        assert [r[:3] for r in a] == [r[:3] for r in b] and len(a) > 20
        assert np.allclose([r[3] for r in a], [r[3] for r in b], atol=1e-5)


def test_flat_and_tree_predictions(rows, spark):
    test = spark.createDataFrame(
        [(1, "fresh milk"), (2, "red beer"), (3, "old cheese"), (4, "big apple"), (5, None), (6, "unknown words"), (7, "red beer")],
        "row_id long, label string",
    )
    flat = {r["row_id"]: r for r in linear.linear_classifier(rows, test, "code", "label", "row_id", rounds=4).collect()}
    tree = {r["row_id"]: r for r in linear.linear_tree_classifier(rows, test, "code", "label", "row_id", rounds=4).collect()}
    assert set(flat) == set(tree) == {1, 2, 3, 4, 6, 7}
    for i, code in ((1, CODES[0]), (2, CODES[3]), (3, CODES[1]), (4, CODES[2]), (7, CODES[3])):
        assert flat[i]["FLAT_PRED"] == code and 0 < flat[i]["CONFIDENCE"] < 1
        assert tree[i]["TREE_PRED"] == code
    assert flat[6]["FLAT_PRED"] in CODES and tree[6]["TREE_PRED"] in CODES


def test_ways_of_large_tables(rows, no_broadcast):
    docs = linear.count_texts(rows, "code", "label")
    model = linear.fit(docs, [linear.Spec(0, 0, 1, 1, 1.0)], tree_edges, 2)
    got = {tuple(r)[:4]: r["weight"] for r in linear.weight_table(model).collect()}
    rows.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    model = linear.fit(docs, [linear.Spec(0, 0, 1, 1, 1.0)], tree_edges, 2)
    want = {tuple(r)[:4]: r["weight"] for r in linear.weight_table(model).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "row_id long, label string, code string")
    test = spark.createDataFrame([(1, "milk")], "row_id long, label string")
    assert [r["FLAT_PRED"] for r in linear.linear_classifier(empty, test, "code", "label", "row_id", rounds=2).collect()] == [None]
    with pytest.raises(ValueError):
        linear.fit(linear.count_texts(empty, "code", "label"), [linear.Spec(0, 0, 1, 1, 1.0, 1.0, "cubic")], flat_edges)


def broadcast_parts(df):
    """Text of the plan below each broadcast."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            deep = line.index("BroadcastExchange")
            more = [x for x in lines[at + 1 :]]
            stop = next((i for i, x in enumerate(more) if len(x) - len(x.lstrip(" :+-")) <= deep), len(more))
            out.append("\n".join(more[:stop]))
    return out


def test_weights_of_frequent_terms_are_not_broadcast(spark, monkeypatch):
    """The files of weights are small, the weights are not: 90 codes, all weights zero before the first round."""
    rows = [(i, f"word{i % 90} common w{i}", f"c{i % 90}") for i in range(360)]
    train = spark.createDataFrame(rows, "row_id long, label string, code string")
    docs = linear.count_texts(train, "code", "label")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "200000")
    try:
        trainer = linear.Trainer(docs, [linear.Spec(0, 0, 1, 1, 1.0)], flat_edges)
        trainer.step()
        below = broadcast_parts(trainer._scored())
        large = {(r["parent"], r["block"], r["term"]): r["ws"] for r in trainer.weights.collect()}
    finally:
        spark.conf.set(key, before)
    assert below and not any("ws#" in b for b in below)
    trainer = linear.Trainer(docs, [linear.Spec(0, 0, 1, 1, 1.0)], flat_edges)
    trainer.step()
    small = {(r["parent"], r["block"], r["term"]): r["ws"] for r in trainer.weights.collect()}
    assert large.keys() == small.keys()
    assert all(large[k] == pytest.approx(small[k], abs=1e-9) for k in large)
