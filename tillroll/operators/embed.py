"""Text classifier with averaged vectors of hashed n-grams and a softmax over a Huffman tree of the codes.

The score of a text is the mean of its n-grams' vectors; a code's probability is the product of the turns on its
way down the tree. Training goes in passes. In a pass the texts are dealt to parts of bounded size; each part gets
the vectors of the n-grams it has, takes steps of gradient descent over its texts in a seeded order, and hands back
what it changed; a vector's next value is the mean over the parts that used it, by how often they did. Vectors
are a table in the shared folder and meet texts by joins; only the tree's vectors, one per code, reach the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.bayes import Cut, count_texts
from tillroll.operators.classify import copy_to_rows, distinct_labels
from tillroll.operators.features import words_and_char_ngrams
from tillroll.plans.skew import join_weighted
from tillroll.session import stage

PART_TEXTS = 2048
BATCH = 16
VECTORS = "kind int, bucket long, v array<double>, n double"


@dataclass(frozen=True)
class Tree:
    """Codes in order; `right` and `left` tell per code (column) which inner nodes (row) its way takes which turn."""

    codes: tuple[str, ...]
    right: np.ndarray
    left: np.ndarray


def huffman(counts: Iterable[tuple[str, int]]) -> Tree:
    """The tree in which frequent codes are near the top; ties by code, then by age."""
    counts = sorted(counts)
    k = len(counts)
    heap = [(n, i, [i]) for i, (_, n) in enumerate(counts)]
    heapq.heapify(heap)
    right, left = np.zeros((max(k - 1, 0), k)), np.zeros((max(k - 1, 0), k))
    for node in range(k - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        left[node, a[2]], right[node, b[2]] = 1, 1
        heapq.heappush(heap, (a[0] + b[0], k + node, a[2] + b[2]))
    return Tree(tuple(c for c, _ in counts), right, left)


@dataclass(frozen=True)
class Embedding:
    """`vectors`: (bucket, v, n) of the n-grams seen; `inner`: a vector per inner node of the tree."""

    tree: Tree
    vectors: DataFrame
    inner: np.ndarray
    cut: Cut
    buckets: int


def grams(text: Column, cut: Cut, buckets: int) -> Column:
    """Buckets of a text's features."""
    return F.transform(cut(text), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets).cast("long")))


def _means(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Mean of the table's rows that each entry lists; zero for none."""
    size = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), table.shape[1]))
    full = np.flatnonzero(size)
    if len(full):
        flat = np.concatenate([rows[i] for i in full])
        starts = np.r_[0, np.cumsum(size[full])[:-1]]
        out[full] = np.add.reduceat(table[flat], starts) / size[full][:, None]
    return out


def gradients(
    table: np.ndarray, inner: np.ndarray, tree: Tree, rows: list[np.ndarray], codes: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the loss of some texts: by inner node, and by row of the table, with those rows."""
    h = _means(table, rows)
    right, on_way = tree.right[:, codes].T, (tree.right + tree.left)[:, codes].T
    turn = 1 / (1 + np.exp(-np.clip(h @ inner.T, -30, 30)))
    d = (turn - right) * on_way * weights[:, None]
    size = np.array([len(r) for r in rows])
    each = np.repeat(d @ inner / np.maximum(size, 1)[:, None], size, axis=0)
    used, place = np.unique(np.concatenate(rows), return_inverse=True)
    by_row = np.zeros((len(used), table.shape[1]))
    np.add.at(by_row, place, each)
    return d.T @ h, used, by_row


class Descent:
    """Steps over texts in batches. A vector's step shrinks with the slopes it has met, so that frequent nodes
    and n-grams do not swing and rare ones still move."""

    def __init__(self, table: np.ndarray, inner: np.ndarray, tree: Tree):
        self.table, self.inner, self.tree = table, inner, tree
        self.met_table, self.met_inner = np.full(len(table), 1e-8), np.full(len(inner), 1e-8)

    def run(self, rows: list[np.ndarray], codes: np.ndarray, weights: np.ndarray, rates: np.ndarray) -> None:
        for at in range(0, len(rows), BATCH):
            part = slice(at, at + BATCH)
            by_node, used, by_row = gradients(self.table, self.inner, self.tree, rows[part], codes[part], weights[part])
            self.met_inner += (by_node**2).mean(1)
            self.met_table[used] += (by_row**2).mean(1)
            self.inner -= rates[at] * by_node / np.sqrt(self.met_inner)[:, None]
            self.table[used] -= rates[at] * by_row / np.sqrt(self.met_table[used])[:, None]


def probabilities(h: np.ndarray, inner: np.ndarray, tree: Tree) -> np.ndarray:
    """Probability of each code (column) for each mean vector."""
    z = h @ inner.T
    yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
    return np.exp(yes @ tree.right + no @ tree.left)


def _needed(texts: DataFrame) -> DataFrame:
    """(part, bucket, uses) of the n-grams of each part."""
    each = texts.select("part", F.explode("grams").alias("bucket"))
    return stage(each.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("uses")), "needed")


def _with_vectors(needed: DataFrame, vectors: DataFrame) -> DataFrame:
    """(part, bucket, uses, v); `v` is null for an n-gram without a vector."""
    return join_weighted(needed, vectors, ["bucket"], ["part", "bucket"], "n")


def _average(changed: DataFrame, dim: int) -> DataFrame:
    """(kind, bucket, v, n): means over parts, weighted by `n`. One sum per place, added up before the shuffle."""
    sums = [F.sum(F.get("v", F.lit(i)) * F.col("n")).alias(f"__{i}") for i in range(dim)]
    total = changed.groupBy("kind", "bucket").agg(F.sum("n").alias("n"), *sums)
    # rounded, so that the order in which parts are added does not show
    mean = F.array(*[F.round(F.col(f"__{i}") / F.col("n"), 7) for i in range(dim)])
    return total.select("kind", "bucket", mean.alias("v"), "n")


def _train_part(tree: Tree, inner: np.ndarray, dim: int, number: int, passes: int, epochs: int, rate: float, seed: int):
    position = {c: i for i, c in enumerate(tree.codes)}

    def train(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"kind": [], "bucket": [], "v": [], "n": []})
        texts, known = texts.sort_values(["id", "code"]), known.sort_values("bucket")
        buckets = known["bucket"].to_numpy(np.int64)
        table = np.stack(known["v"].to_numpy()).astype(float) if len(known) else np.zeros((0, dim))
        nodes = inner.copy()
        rows = [np.searchsorted(buckets, np.asarray(g, np.int64)) for g in texts["grams"]]
        codes = texts["code"].map(position).to_numpy(int)
        weights = np.clip(texts["weight"].to_numpy(float), 0.25, 4.0)
        rng = np.random.default_rng([seed, number, int(texts["part"].iloc[0])])
        descent = Descent(table, nodes, tree)
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            done = number * epochs + epoch + np.arange(len(rows)) / len(rows)
            rates = rate * np.maximum(1 - done / (passes * epochs), 0.01)
            descent.run([rows[i] for i in order], codes[order], weights[order], rates)
        return pd.DataFrame(
            {
                "kind": [0] * len(buckets) + [1] * len(nodes),
                "bucket": [*buckets.tolist(), *range(len(nodes))],
                "v": [*table.tolist(), *nodes.tolist()],
                "n": [*known["uses"].astype(float), *[float(len(rows))] * len(nodes)],
            }
        )

    return train


def fit(
    docs: DataFrame,
    dim: int = 32,
    passes: int = 3,
    epochs: int = 4,
    rate: float = 0.3,
    buckets: int = 1_000_000,
    cut: Cut = words_and_char_ngrams,
    seed: int = 42,
) -> Embedding:
    """Vectors and tree from `docs`, as made by `bayes.count_texts`.

    A code and text that occur more often than others step further, up to four times. Reruns agree.
    """
    total = docs.agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("texts")).first()
    parts = max(1, -(-(total["texts"] or 0) // PART_TEXTS))
    texts = docs.where(F.col("code").isNotNull()).select(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).alias("part"),
        "id",
        "code",
        (F.col("n") / F.lit(total["mean"] or 1.0)).alias("weight"),
        grams(F.col("text"), cut, buckets).alias("grams"),
    )
    texts = stage(texts.repartition("part"), "texts")
    # as many rows as the code list
    tree = huffman((r["code"], r["n"]) for r in docs.groupBy("code").agg(F.sum("n").alias("n")).collect() if r["code"])
    needed = _needed(texts)
    start = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (F.shiftrightunsigned(F.xxhash64("bucket", i, F.lit(seed)), 11) / float(1 << 52) - 1) / dim,
    )
    uses = needed.groupBy("bucket").agg(F.sum("uses").alias("n"))
    vectors, inner = stage(uses.select("bucket", start.alias("v"), "n"), "vectors"), np.zeros((len(tree.right), dim))
    for number in range(passes):
        train = _train_part(tree, inner, dim, number, passes, epochs, rate, seed)
        known = _with_vectors(needed, vectors).groupBy("part")
        changed = texts.groupBy("part").cogroup(known).applyInPandas(train, VECTORS)
        changed = stage(_average(changed, dim), "changed")
        nodes = changed.where("kind = 1").orderBy("bucket").collect()
        inner = np.array([r["v"] for r in nodes]).reshape(-1, dim)
        vectors = changed.where("kind = 0").select("bucket", "v", F.col("n").cast("long").alias("n"))
    return Embedding(tree, vectors, inner, cut, buckets)


def predict(items: DataFrame, model: Embedding) -> DataFrame:
    """(id, n, pred, confidence, margin) for items (id, text, n).

    Ties go to the first code. N-grams that were not seen in training count for nothing; a text without any known
    one gets the code that the tree prefers. Without training rows predictions are null.
    """
    tree, inner = model.tree, model.inner
    if not tree.codes:
        none = F.lit(None)
        return items.select("id", "n", none.cast("string").alias("pred"), none.cast("double").alias("confidence"), none.cast("double").alias("margin"))
    count = items.count()
    parts = max(1, -(-count // PART_TEXTS))
    texts = items.select(
        F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "id", "n", grams(F.col("text"), model.cut, model.buckets).alias("grams")
    )
    texts = stage(texts, "asked")
    known = _with_vectors(_needed(texts), model.vectors).where(F.col("v").isNotNull())
    dim = inner.shape[1]

    def answer(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"id": [], "n": [], "pred": [], "confidence": [], "margin": []})
        known = known.sort_values("bucket")
        buckets = known["bucket"].to_numpy(np.int64)
        table = np.stack(known["v"].to_numpy()).astype(float) if len(known) else np.zeros((0, dim))
        rows = []
        for g in texts["grams"]:
            g = np.asarray(g, np.int64)
            at = np.searchsorted(buckets, g)
            here = at < len(buckets)
            here[here] = buckets[at[here]] == g[here]
            rows.append(at[here])
        p = np.round(probabilities(_means(table, rows), inner, tree), 6)
        ordered = np.sort(np.column_stack([np.zeros(len(p)), p]), axis=1)
        return pd.DataFrame(
            {
                "id": texts["id"],
                "n": texts["n"],
                "pred": np.array(tree.codes, object)[p.argmax(1)],
                "confidence": ordered[:, -1],
                "margin": np.round(ordered[:, -1] - ordered[:, -2], 6),
            }
        )

    groups = texts.groupBy("part").cogroup(known.groupBy("part"))
    return groups.applyInPandas(answer, "id string, n long, pred string, confidence double, margin double")


def embedding_classifier(
    train: DataFrame, test: DataFrame, code: str, label: str, order_col: str = "ROW_ID", **options
) -> DataFrame:
    """Test rows with FLAT_PRED, CONFIDENCE and MARGIN; each distinct label is predicted once."""
    model = fit(count_texts(train, code, label), **options)
    answers = predict(distinct_labels(test, label), model)
    named = answers.select(
        "id", "n", F.col("pred").alias("FLAT_PRED"), F.col("confidence").alias("CONFIDENCE"), F.col("margin").alias("MARGIN")
    )
    return copy_to_rows(test, named, label, order_col)
