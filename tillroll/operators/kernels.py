"""Classifiers with a kernel, for all nodes of many models at once, through explicit feature maps.

A map gives each text a vector of `width` numbers whose products come close to the kernel of two texts:
random Fourier features for `rbf`, exp(-gamma |a - b|^2), and Nystroem features over a seeded sample of training
texts for `sigmoid`, tanh(gamma a.b). Over these the learner minimises the same loss as `linear`. Each round is one
pass: tasks add up the slopes of their rows per node, one task per node solves for the step with the matrix of
a parabola above the loss, so the loss falls in each round. Weights are codes x width numbers a model; models
are trained in blocks, so that those in the driver and sent to the tasks stay below `BLOCK_BYTES`.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.bayes import Edges
from tillroll.operators.linear import CONSTANT, CURVATURE, Spec, feature_sets, tfidf_vectors, training_rows
from tillroll.plans.skew import join_staged
from tillroll.session import stage

WIDTH = 256
BLOCK_BYTES = 32 << 20
SEED = 42
KERNELS = ("rbf", "sigmoid")
LEAST_SHARE = 1e-6  # of the largest eigenvalue, for those that count


@dataclass(frozen=True)
class KernelSpec(Spec):
    kernel: str = "rbf"
    gamma: float = 1.0


def _uniform(*values: Column) -> Column:
    """A number in [0, 1) that follows from the values."""
    return F.shiftrightunsigned(F.xxhash64(*values), 11) / F.lit(float(1 << 53))


def fourier_features(terms: Column, gamma: float, width: int = WIDTH, seed: int = SEED) -> Column:
    """Random Fourier features of `terms`, an array of (term, x), for the kernel exp(-gamma |a - b|^2).

    The random direction of a term follows from its hash, so there is no table of terms.
    """
    known = F.filter(terms, lambda t: t["term"] != CONSTANT)

    def normal(term: Column, j: Column) -> Column:
        radius = F.sqrt(-2 * F.log(1 - _uniform(term, j, F.lit(seed))))
        return radius * F.cos(2 * math.pi * _uniform(term, j, F.lit(seed + 1)))

    def feature(j: Column) -> Column:
        along = F.aggregate(known, F.lit(0.0), lambda a, t: a + t["x"] * normal(t["term"], j))
        phase = 2 * math.pi * _uniform(j, F.lit(seed + 2))
        return math.sqrt(2 / width) * F.cos(math.sqrt(2 * gamma) * along + phase)

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), feature)


@dataclass(frozen=True)
class Landmarks:
    """Sampled texts: per term the texts with it and their x; `scale` makes features of kernel values."""

    terms: dict[str, tuple[np.ndarray, np.ndarray]]
    scale: np.ndarray
    gamma: float

    def features(self, rows: Iterable[Sequence[tuple[str, float]]], width: int) -> np.ndarray:
        rows = list(rows)
        dots = np.zeros((len(rows), len(self.scale)))
        for dot, row in zip(dots, rows):
            for term, x in row:
                if term != CONSTANT and term in self.terms:
                    at, values = self.terms[term]
                    dot[at] += x * values
        out = np.zeros((len(rows), width))
        out[:, : self.scale.shape[1]] = np.tanh(self.gamma * dots) @ self.scale
        return out


def landmarks(sample: Sequence[Sequence[tuple[str, float]]], gamma: float) -> Landmarks:
    """Nystroem features of the kernel tanh(gamma a.b) over a sample of texts.

    The kernel has negative eigenvalues; those, and positive ones no larger than the most negative, are left out.
    """
    terms: dict[str, list] = {}
    for i, row in enumerate(sample):
        for term, x in row:
            if term != CONSTANT:
                terms.setdefault(term, []).append((i, x))
    index = {t: (np.array([i for i, _ in v]), np.array([x for _, x in v])) for t, v in terms.items()}
    raw = Landmarks(index, np.eye(len(sample)), gamma)
    values, vectors = np.linalg.eigh(raw.features(sample, len(sample)))
    good = values > max(LEAST_SHARE * values.max(initial=0.0), -values.min(initial=0.0), 1e-300)
    return Landmarks(index, vectors[:, good] / np.sqrt(values[good]), gamma)


def _sample(vectors: DataFrame, docs: DataFrame, specs: Sequence[KernelSpec], width: int, seed: int) -> dict[int, list]:
    """Per feature set up to `width` training texts of its split, chosen by a hash."""
    sets = feature_sets(specs)
    kept = [
        F.struct(F.lit(f).alias("f"), (F.sum("n") - F.sum(F.get("held", F.lit(split)))).alias("n")) for (split, *_), f in sets.items()
    ]
    trained = docs.groupBy("id").agg(F.array(*kept).alias("m")).select("id", F.inline("m")).where("n > 0").select("f", "id")
    place = F.row_number().over(Window.partitionBy("f").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    chosen = trained.withColumn("place", place).where(F.col("place") <= width)
    got = chosen.join(vectors, ["f", "id"]).select("f", "place", "terms").orderBy("f", "place").collect()
    out: dict[int, list] = {f: [] for f in sets.values()}
    for f, _, terms in got:
        out[f].append([(t["term"], t["x"]) for t in terms])
    return out


def feature_maps(vectors: DataFrame, docs: DataFrame, specs: Sequence[KernelSpec], width: int, seed: int) -> tuple[DataFrame, dict]:
    """(map, id, phi) for each feature set, kernel and gamma of `specs`, and their numbers. Written out."""
    sets = feature_sets(specs)
    wanted = sorted({(sets[s.key], s.kernel, s.gamma) for s in specs})
    number = {key: i for i, key in enumerate(wanted)}
    out = None
    for (f, kernel, gamma), i in number.items():
        if kernel == "rbf":
            part = vectors.where(F.col("f") == f).select(
                F.lit(i).alias("map"), "id", fourier_features(F.col("terms"), gamma, width, seed).alias("phi")
            )
            out = part if out is None else out.unionByName(part)
    if any(kernel == "sigmoid" for _, kernel, _ in wanted):
        samples = _sample(vectors, docs, specs, width, seed)
        made = {(f, i): landmarks(samples[f], gamma) for (f, kernel, gamma), i in number.items() if kernel == "sigmoid"}
        sets_used = sorted({f for f, _ in made})

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f = batch.column("f").to_numpy(zero_copy_only=False)
                for (of, i), marks in made.items():
                    part = batch.filter(pa.array(f == of))
                    if part.num_rows:
                        rows = [[(t["term"], t["x"]) for t in terms] for terms in part.column("terms").to_pylist()]
                        phi = marks.features(rows, width)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), i, np.int32)), part.column("id"), pa.array(list(phi))], names=["map", "id", "phi"]
                        )

        part = vectors.where(F.col("f").isin(sets_used)).mapInArrow(run, "map int, id string, phi array<double>")
        out = part if out is None else out.unionByName(part)
    return stage(out, "maps"), number


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of features with the constant one behind them."""
    values = np.asarray(column.flatten()).reshape(-1, width)
    return np.column_stack([values, np.ones(len(values))])


def _slopes(loss: str, score: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, float]:
    if loss == "squared_hinge":
        short, over = np.maximum(1 - score, 0), np.maximum(1 + score, 0)
        return 2 * (wrong * over - right * short), float((right * short**2 + wrong * over**2).sum())
    p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    return wrong * p - right * (1 - p), float((right * np.logaddexp(0, -score) + wrong * np.logaddexp(0, score)).sum())


@dataclass(frozen=True)
class Node:
    model: int
    parent: str
    children: tuple[str, ...]
    c: float
    loss: str


@dataclass
class KernelModel:
    """`maps`: (map, id, phi); `nodes`: (model, parent, children, rows); `open`: nodes with two children or more, in
    blocks, with their weights; `map_of` a model's map."""

    maps: DataFrame
    nodes: DataFrame
    map_of: dict[int, int]
    blocks: list[tuple[list[Node], list[np.ndarray]]]
    width: int
    losses: list[list[float]]


def _examples(labelled: DataFrame, maps: DataFrame, map_of: dict[int, int], nodes: list[Node]) -> DataFrame:
    """(phi, at): features of each text, once per map, with the nodes it is an example of: number of the node and
    rows per child."""
    spark = labelled.sparkSession
    numbered = [(i, n.model, n.parent, map_of[n.model]) for i, n in enumerate(nodes)]
    table = spark.createDataFrame(numbered, "node int, model int, parent string, map int")
    rows = labelled.join(F.broadcast(table), ["model", "parent"])
    right = F.transform("children", lambda c: F.coalesce(F.try_element_at("labels", c), F.lit(0)).cast("double"))
    at = rows.groupBy("map", "id").agg(F.collect_list(F.struct("node", right.alias("right"))).alias("at"))
    cores = spark.sparkContext.defaultParallelism
    return stage(at.join(maps, ["map", "id"]).select("phi", "at"), "kernel_rows").coalesce(cores)


def _per_node(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(node, features, rows per child) of the examples in a batch."""
    phi = _matrix(batch.column("phi"), width)
    lists = batch.column("at")
    row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
    entries = lists.flatten()
    node, right = np.asarray(entries.field("node")), entries.field("right")
    starts = np.r_[0, np.cumsum(np.asarray(right.value_lengths()))]
    values = np.asarray(right.flatten())
    for number in np.unique(node).tolist():
        at = np.flatnonzero(node == number)
        k = starts[at[0] + 1] - starts[at[0]]
        yield number, phi[row[at]], values[starts[at][:, None] + np.arange(k)[None, :]]


SUMS = "node int, value binary, loss double"


def _summed(examples: DataFrame, make, width: int) -> DataFrame:
    """What `make(node, features, right)` gives, as (array, loss), added up over the rows of each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for number, x, right in _per_node(batch, width):
                value, loss = make(number, x, right)
                held = found.setdefault(number, [0.0, 0.0])
                held[0], held[1] = held[0] + value, held[1] + loss
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.int32()),
                    pa.array([np.ascontiguousarray(v).tobytes() for v, _ in found.values()], pa.binary()),
                    pa.array([loss for _, loss in found.values()], pa.float64()),
                ],
                names=["node", "value", "loss"],
            )

    return examples.mapInArrow(run, SUMS)


def _round(nodes: list[Node], weights: list[np.ndarray], full: int):
    """What a round computes: slopes and losses of rows at `weights`, and a node's step from their sums."""

    def slope(number: int, x: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float]:
        n = nodes[number]
        d, loss = _slopes(n.loss, x @ weights[number].T, right, right.sum(1)[:, None] - right)
        return n.c * d.T @ x, n.c * loss

    def step(key, found: pd.DataFrame, inverse: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        g = np.sum([np.frombuffer(v) for v in found["value"]], axis=0).reshape(-1, full) + weights[number]
        move = g @ np.frombuffer(inverse["inverse"].iloc[0]).reshape(full, full)
        return pd.DataFrame({"node": [number], "value": [move.tobytes()], "loss": [found["loss"].sum()]})

    return slope, step


def _fit_block(examples: DataFrame, nodes: list[Node], width: int, rounds: int) -> tuple[list[np.ndarray], list[float]]:
    """Weights of all nodes of a block, and the objective before each round."""
    full = width + 1

    def square(_, x, right):
        return x.T @ (x * right.sum(1)[:, None]), 0.0

    def curvature(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in frame["value"]], axis=0).reshape(full, full)
        n = nodes[int(frame["node"].iloc[0])]
        inverse = np.linalg.inv(np.eye(full) + n.c * CURVATURE[n.loss] * total)
        return pd.DataFrame({"node": frame["node"].iloc[:1], "inverse": [inverse.tobytes()]})

    squares = _summed(examples, square, width)
    inverses = stage(squares.groupBy("node").applyInPandas(curvature, "node int, inverse binary"), "curvature")
    weights = [np.zeros((len(n.children), full)) for n in nodes]
    objective = []
    for _ in range(rounds):
        slope, step = _round(nodes, [w.copy() for w in weights], full)
        found = _summed(examples, slope, width).groupBy("node")
        moves = found.cogroup(inverses.groupBy("node")).applyInPandas(step, SUMS).toPandas()
        objective.append(float(moves["loss"].sum() + sum((w * w).sum() for w in weights) / 2))
        for number, move in zip(moves["node"].tolist(), moves["value"]):
            weights[number] = weights[number] - np.frombuffer(move).reshape(-1, full)
    return weights, objective


def fit(
    docs: DataFrame, specs: Sequence[KernelSpec], edges: Edges, width: int = WIDTH, rounds: int = 10, seed: int = SEED
) -> KernelModel:
    """All models of `specs` on `docs`, as made by `bayes.count_texts`. The maps hold every text of `docs`."""
    unknown = {s.kernel for s in specs} - set(KERNELS)
    if unknown:
        raise ValueError(f"no kernel {sorted(unknown)}")
    vectors = tfidf_vectors(docs, specs)
    maps, number = feature_maps(vectors, docs, specs, width, seed)
    sets = feature_sets(specs)
    map_of = {s.model: number[sets[s.key], s.kernel, s.gamma] for s in specs}
    labelled, nodes = training_rows(docs, specs, edges)
    spec_of = {s.model: s for s in specs}
    # as many rows as the code lists of all models have inner nodes
    found = nodes.where(F.size("children") > 1).select("model", "parent", "children").orderBy("model", "parent").collect()
    blocks: list[list[Node]] = []
    size = BLOCK_BYTES
    for model, parent, children in found:
        spec = spec_of[model]
        bytes_of = len(children) * (width + 1) * 8
        if size + bytes_of > BLOCK_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append(Node(model, parent, tuple(children), spec.c, spec.loss))
        size += bytes_of
    fitted = [_fit_block(_examples(labelled, maps, map_of, block), block, width, rounds) for block in blocks]
    return KernelModel(maps, nodes, map_of, [(b, w) for b, (w, _) in zip(blocks, fitted)], width, [o for _, o in fitted])


def predict(items: DataFrame, model: KernelModel) -> DataFrame:
    """(model, parent, id, pred, margin) for items (model, parent, id).

    The child of the highest score, rounded to six decimals; ties go to the smallest child. An only child needs no
    score. A parent without a node gives null. The margin to the second is null where there is none.
    """
    spark = items.sparkSession
    at_node = join_staged(items, model.nodes, ["model", "parent"], ["id"], "rows")
    scored = None
    for nodes, weights in model.blocks:
        numbered = [(i, n.model, n.parent, model.map_of[n.model]) for i, n in enumerate(nodes)]
        table = spark.createDataFrame(numbered, "node int, model int, parent string, map int")
        asked = items.join(F.broadcast(table), ["model", "parent"]).join(model.maps, ["map", "id"])

        def run(batches, nodes=nodes, weights=weights, width=model.width):
            for batch in batches:
                x, node = _matrix(batch.column("phi"), width), np.asarray(batch.column("node"))
                best, margin = np.zeros(len(x), object), np.zeros(len(x))
                for number in np.unique(node).tolist():
                    at = np.flatnonzero(node == number)
                    score = np.round(x[at] @ weights[number].T, 6)
                    first = score.argmax(1)
                    ordered = np.sort(score, axis=1)
                    best[at] = np.array(nodes[number].children, object)[first]
                    margin[at] = np.round(ordered[:, -1] - ordered[:, -2], 6)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("model"), batch.column("parent"), batch.column("id"), pa.array(best, pa.string()), pa.array(margin)],
                    names=["model", "parent", "id", "best", "margin"],
                )

        part = asked.select("model", "parent", "id", "node", "phi").mapInArrow(
            run, "model int, parent string, id string, best string, margin double"
        )
        scored = part if scored is None else scored.unionByName(part)
    only = F.when(F.size("children") == 1, F.get("children", F.lit(0)))
    if scored is None:
        return at_node.select("model", "parent", "id", only.alias("pred"), F.lit(None).cast("double").alias("margin"))
    met = at_node.join(scored, ["model", "parent", "id"], "left")
    return met.select("model", "parent", "id", F.coalesce(only, "best").alias("pred"), "margin")
