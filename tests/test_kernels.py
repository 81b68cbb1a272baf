"""Feature maps against exact kernels, and the learner over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_linear import CODES, receipts
from tillroll.operators import kernels, linear, tune
from tillroll.operators.classify import flat_edges, tree_edges

TERMS = "array<struct<term:string,x:double>>"


def random_texts(seed, n, words=12):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = rng.random(words) * (rng.random(words) < 0.4)
        x[int(rng.integers(words))] += 0.5
        x /= np.linalg.norm(x)
        out.append([(f"w{i}", float(v)) for i, v in enumerate(x) if v > 0] + [("", 1.0)])
    return out


def dense(texts, words=12):
    x = np.zeros((len(texts), words))
    for row, text in zip(x, texts):
        for term, v in text:
            if term:
                row[int(term[1:])] = v
    return x


@pytest.mark.parametrize("gamma", [0.3, 1.0, 3.0])
def test_fourier_features_come_close_to_the_kernel(spark, gamma):
    texts = random_texts(1, 30)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, terms {TERMS}")
    got = df.select("i", kernels.fourier_features(F.col("terms"), gamma, 4096).alias("phi")).orderBy("i").collect()
    phi = np.array([r["phi"] for r in got])
    x = dense(texts)
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(phi @ phi.T - exact).max() < 0.09 and np.abs(phi @ phi.T - exact).mean() < 0.02


def test_fourier_features_follow_from_the_words_alone(spark):
    one = spark.createDataFrame([([("a", 0.6), ("b", 0.8)],)], f"terms {TERMS}")
    other = spark.createDataFrame([([("x", 1.0)],), ([("a", 0.6), ("b", 0.8), ("", 1.0)],)], f"terms {TERMS}")
    feature = kernels.fourier_features(F.col("terms"), 1.0, 16).alias("phi")
    assert one.select(feature).first()["phi"] == other.select(feature).collect()[1]["phi"]


@pytest.mark.parametrize(("gamma", "most", "mean"), [(0.5, 0.1, 0.01), (1.0, 0.3, 0.03)])
def test_nystroem_features_come_close_to_the_kernel(gamma, most, mean):
    sample, texts = random_texts(2, 80), random_texts(3, 25)
    marks = kernels.landmarks(sample, gamma)
    phi, x = marks.features(texts, 80), dense(texts)
    exact = np.tanh(gamma * x @ x.T)
    error = np.abs(phi @ phi.T - exact)
    assert phi.shape == (25, 80) and error.max() < most and error.mean() < mean
    none = kernels.landmarks([], gamma).features(texts, 4)
    assert none.shape == (25, 4) and not none.any()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(receipts(), "row_id long, label string, code string")
    return linear.count_texts(rows, "code", "label", [F.col("row_id") % 4 == 0, F.col("row_id") % 4 == 1])


@pytest.mark.parametrize("loss", ["squared_hinge", "logistic"])
def test_weights_are_those_of_a_plain_fit(docs, loss):
    spec = kernels.KernelSpec(0, 0, 1, 1, 1.0, 0.5, loss, "rbf", 1.0)
    model = kernels.fit(docs, [spec], flat_edges, width=24, rounds=25)
    assert all(b <= a + 1e-9 for a, b in zip(model.losses[0], model.losses[0][1:]))
    nodes, weights = model.blocks[0]
    phi = {r["id"]: np.r_[r["phi"], 1.0] for r in model.maps.collect()}
    counted = [(r["id"], r["code"], r["n"] - r["held"][0]) for r in docs.collect()]
    ids = sorted({i for i, _, n in counted if n})
    x = np.array([phi[i] for i in ids])
    for child, got in zip(nodes[0].children, weights[0]):
        right = np.array([sum(n for j, c, n in counted if j == i and c == child) for i in ids], float)
        wrong = np.array([sum(n for j, c, n in counted if j == i and c != child) for i in ids], float)
        w = np.zeros(25)
        for _ in range(4000):
            d, _ = kernels._slopes(loss, x @ w, right, wrong)
            w -= (w + 0.5 * x.T @ d) / (1 + 0.5 * 2 * 2.2 * (right + wrong).sum())
        assert np.abs(x @ got - x @ w).max() < 0.05


def test_blocks_change_nothing(docs, monkeypatch):
    specs = [kernels.KernelSpec(i, i, 1, 1, 1.0, 1.0, kernel="rbf") for i in range(2)]
    whole = kernels.fit(docs, specs, tree_edges, width=8, rounds=3)
    monkeypatch.setattr(kernels, "BLOCK_BYTES", 200)
    parts = kernels.fit(docs, specs, tree_edges, width=8, rounds=3)
    assert len(whole.blocks) == 1 and len(parts.blocks) > 2
    items = docs.select(F.lit(1).alias("model"), F.lit("").alias("parent"), "id").distinct()
    one, other = (sorted(kernels.predict(items, m).select("id", "pred").collect()) for m in (whole, parts))
    assert one == other and all(r["pred"] in ("01", "02") for r in one)


def test_grid_scores_every_kernel(spark):
    rows = spark.createDataFrame(receipts(7), "row_id long, label string, code string")
    choices = tune.settings([1.0], [(1, 1), (1, 2)], [1.0], ["linear", "rbf", "sigmoid", "poly"], [0.5])
    got = tune.grid_search(rows, choices, "code", "label", "row_id", k=2, max_iter=4, width=64).collect()
    assert len(got) == 8
    by_kernel = {}
    for r in got:
        by_kernel.setdefault(r["kernel"], []).append(r)
    assert all(r["f1"] is None and "poly" in r["reason"] for r in by_kernel["poly"])
    for kernel in ("linear", "rbf", "sigmoid"):
        assert all(r["reason"] is None and r["f1"] > 0.7 for r in by_kernel[kernel]), by_kernel
    best = tune.best_setting(spark.createDataFrame(got, tune.RESULT)).first()
    assert best["f1"] == max(r["f1"] for r in got if r["f1"] is not None)


def test_grid_without_rows(spark):
    empty = spark.createDataFrame([], "row_id long, label string, code string")
    choices = tune.settings([1.0], [(1, 1)], [1.0], ["linear", "rbf", "sigmoid"], [0.5])
    got = tune.grid_search(empty, choices, "code", "label", "row_id", k=2, max_iter=2, width=4).collect()
    assert [r["reason"] for r in got] == ["no rows"] * 3
    assert len(CODES) == 4
