"""Linear classifiers of texts, for all nodes of many models at once, as joins and aggregates.

A model is a training split, a way to make TF-IDF terms, a strength C and a loss. Under each node of its code tree
every child is told from its siblings by a weight per term: the weights minimise
    1/2 |w|^2 + C * sum over rows of loss(y * score),    score = sum over terms of w * x
Every term of a node has a row with the weights of its children, in blocks of up to `WIDE` children, so the number of
rows is set by the vocabulary; nothing of it is collected. A round joins terms to weights, sums scores
per text, joins them back, sums slopes per term and moves every weight by slope / curvature, with the curvature of
a parabola that lies above the loss everywhere. So the loss falls in each round, and there is no step size to choose.
All models, nodes and children take their rounds together; sums are formed before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.codes import LEVELS
from tillroll.operators.bayes import Edges, count_texts, text_id
from tillroll.operators.classify import ROOT, copy_to_rows, distinct_labels, flat_edges, tree_edges
from tillroll.operators.features import terms_of
from tillroll.plans.skew import heavy_parts, join_dealt, join_staged, join_weighted, key_counts
from tillroll.session import stage

# The term of the constant feature; no word is empty.
CONSTANT = ""
# Children in one row of weights.
WIDE = 64
BLOCK = ["model", "parent", "block"]
# Most that the slope of a loss changes per unit of the score.
CURVATURE = {"squared_hinge": 2.0, "logistic": 0.25}


@dataclass(frozen=True)
class Spec:
    """`split` is the place in `held`; terms are runs of `low` to `high` words in at most `max_df` of the rows."""

    model: int
    split: int
    low: int
    high: int
    max_df: float
    c: float = 1.0
    loss: str = "squared_hinge"

    @property
    def key(self) -> tuple[int, int, int, float]:
        """What its features follow from."""
        return self.split, self.low, self.high, self.max_df


@dataclass(frozen=True)
class Linear:
    """`models`: (model, split, f, c, loss); `vectors`: (f, id, terms) of every text; `nodes`: (model, parent,
    children, rows), children in order; `weights`: (model, parent, block, term, ws, n), ws in the order of the
    block's children; `width`: children of the largest block; `large`: whether the weights are too many to broadcast."""

    models: DataFrame
    vectors: DataFrame
    nodes: DataFrame
    weights: DataFrame
    width: int
    large: bool


def add_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` and the texts of `labels` (text), as rows that no model learns from."""
    more = labels.where(F.col("text").isNotNull()).select("text").distinct()
    nothing = [F.lit(None).cast("string").alias("code"), "text", F.lit(0).cast("long").alias("n")]
    rows = more.select(*nothing, F.array().cast("array<bigint>").alias("held"), text_id(F.col("text")).alias("id"))
    return docs.unionByName(rows)


def feature_sets(specs: Sequence[Spec]) -> dict[tuple, int]:
    """Number of each way to make features."""
    return {key: i for i, key in enumerate(sorted({s.key for s in specs}))}


def _model_table(specs: Sequence[Spec], spark) -> DataFrame:
    sets = feature_sets(specs)
    rows = [(s.model, s.split, sets[s.key], float(s.c), s.loss) for s in specs]
    return spark.createDataFrame(rows, "model int, split int, f int, c double, loss string")


def tfidf_vectors(docs: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """(f, id, terms) for each feature set of `specs` and each text of `docs`; written out.

    idf = ln((1 + rows) / (1 + rows with the term)) + 1 over the rows that the split trains on: all rows minus those
    held back, so terms are counted once for all splits. `terms` are (term, x), x scaled to length 1, and the
    constant feature. A text with no known term has that alone.
    """
    splits = sorted({s.split for s in specs})
    counts = {"n": F.sum("n"), **{f"h{i}": F.coalesce(F.sum(F.get("held", F.lit(i))), F.lit(0)) for i in splits}}
    texts = docs.groupBy("id").agg(F.first("text").alias("text"), *[c.alias(k) for k, c in counts.items()])
    texts = stage(texts, "texts")
    total = [F.sum("n").alias("n"), *[F.sum(f"h{i}").alias(f"h{i}") for i in splits]]
    all_rows = texts.agg(F.struct(*total)).scalar()
    parts = []
    for low, high in sorted({(s.low, s.high) for s in specs}):
        sets = {k: f for k, f in feature_sets(specs).items() if k[1:3] == (low, high)}
        terms = texts.select("id", *counts, F.explode(terms_of(F.col("text"), low, high)).alias("term"))
        tf = stage(terms.groupBy("id", "term", *counts).agg(F.count(F.lit(1)).alias("tf")), "terms")
        seen = tf.groupBy("term").agg(*total, F.count(F.lit(1)).alias("texts"))
        seen = seen.withColumn("all", all_rows)
        entries = []
        for (split, _, _, max_df), f in sets.items():
            with_term, rows = F.col("n") - F.col(f"h{split}"), F.col("all.n") - F.col(f"all.h{split}")
            idf = F.log((1 + rows) / (1 + with_term)) + 1
            entries.append(
                F.when(
                    (with_term > 0) & (with_term <= max_df * rows), F.struct(F.lit(f).alias("f"), idf.alias("idf"))
                )
            )
        seen = seen.select("term", F.filter(F.array(*entries), lambda e: e.isNotNull()).alias("sets"), "texts")
        met = join_weighted(tf.select("id", "term", "tf"), seen, ["term"], ["id", "term"], "texts")
        parts.append(
            met.select("id", "term", "tf", F.inline("sets"))
            .groupBy("f", "id")
            .agg(F.array_sort(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("x")))).alias("terms"))
        )
    vectors = parts[0]
    for part in parts[1:]:
        vectors = vectors.unionByName(part)
    every = texts.select("id", F.explode(F.sequence(F.lit(0), F.lit(len(feature_sets(specs)) - 1))).alias("f"))
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["x"] * t["x"]))
    scaled = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), (t["x"] / F.col("norm")).alias("x")))
    constant = F.array(F.struct(F.lit(CONSTANT).alias("term"), F.lit(1.0).alias("x")))
    vectors = vectors.withColumn("norm", norm).select("f", "id", scaled.alias("terms"))
    vectors = every.join(vectors, ["f", "id"], "left")
    return stage(vectors.select("f", "id", F.concat(F.coalesce("terms", F.array().cast("array<struct<term:string,x:double>>")), constant).alias("terms")), "vectors")


def training_rows(docs: DataFrame, specs: Sequence[Spec], edges: Edges) -> tuple[DataFrame, DataFrame]:
    """((model, parent, id, labels), nodes): per node and text the rows of each child, for nodes with two children
    or more, and all nodes. Both written out."""
    left = [
        F.struct(F.lit(s.model).alias("model"), (F.col("n") - F.get("held", F.lit(s.split))).alias("n")) for s in specs
    ]
    rows = docs.where(F.col("code").isNotNull()).select("code", "id", F.inline(F.array(*left))).where("n > 0")
    rows = rows.select("model", "id", F.inline(edges(F.col("code"))), "n")
    rows = stage(rows.groupBy("model", "parent", "id", "child").agg(F.sum("n").alias("n")), "examples")
    children = rows.groupBy("model", "parent", "child").agg(F.sum("n").alias("n")).groupBy("model", "parent")
    nodes = stage(
        children.agg(F.array_sort(F.collect_list("child")).alias("children"), F.sum("n").alias("rows")), "nodes"
    )
    labelled = rows.groupBy("model", "parent", "id").agg(F.map_from_entries(F.collect_list(F.struct("child", "n"))).alias("labels"))
    open_nodes = nodes.where(F.size("children") > 1).drop("rows")
    return stage(labelled.join(open_nodes, ["model", "parent"]), "labelled"), nodes


def slope_and_loss(loss: Column, score: Column, right: Column, wrong: Column) -> tuple[Column, Column]:
    """Slope and value of a loss at a score, over `right` rows of the child and `wrong` rows of others."""
    short, over = F.greatest(1 - score, F.lit(0.0)), F.greatest(1 + score, F.lit(0.0))
    hinge = (2 * (wrong * over - right * short), right * short * short + wrong * over * over)
    sigmoid = 1 / (1 + F.exp(-score))
    # ln(1 + e^s) without overflow
    soft = F.greatest(score, F.lit(0.0)) + F.log1p(F.exp(-F.abs(score)))
    logistic = (wrong * sigmoid - right * (1 - sigmoid), right * (soft - score) + wrong * soft)
    is_hinge = loss == "squared_hinge"
    return F.when(is_hinge, hinge[0]).otherwise(logistic[0]), F.when(is_hinge, hinge[1]).otherwise(logistic[1])


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each block of up to `WIDE` of the row's `children`."""
    last = F.floor((F.size("children") - 1) / WIDE).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda b: F.struct(b.alias("block"), F.slice("children", (b * WIDE + 1).cast("int"), F.lit(WIDE)).alias("some")),
    )
    rest = [c for c in rows.columns if c != "children"]
    return rows.select(*rest, F.inline(cut)).withColumnRenamed("some", "children")


def _sums(rows: DataFrame, keys: Sequence[str], factor: str, values: str, width: int, out: str) -> DataFrame:
    """(*keys, out): the arrays `values` times `factor`, added up place by place. One sum per place, so that rows
    are added up before the shuffle."""
    each = [F.sum(F.col(factor) * F.get(values, F.lit(i))).alias(f"__{i}") for i in range(width)]
    places = F.array(*[F.coalesce(F.col(f"__{i}"), F.lit(0.0)) for i in range(width)])
    return rows.groupBy(*keys).agg(*each).select(*keys, places.alias(out))


def _scores(rows: DataFrame, weights: DataFrame, width: int, large: bool, heavy: DataFrame | None = None) -> DataFrame:
    """(model, parent, block, id, scores): a score per child, for rows (model, parent, block, id, terms) that have
    a term with weights. `heavy`: frequent terms, where they have been counted already."""
    keys = [*BLOCK, "term"]
    pieces = rows.select(*BLOCK, "id", F.inline("terms"))
    if not large:
        met = join_staged(pieces, weights, keys, ["id", "term"], "n")
    else:
        if heavy is None:
            heavy = stage(heavy_parts(stage(key_counts(pieces, keys), "counts"), "__n"), "frequent")
        met = join_dealt(pieces, weights.drop("n"), keys, ["id", "term"], heavy)
    return _sums(met.where(F.col("ws").isNotNull()), [*BLOCK, "id"], "x", "ws", width, "scores")


def _too_large(terms: DataFrame) -> bool:
    """Whether the weights of `terms` (term, k, ...) are beyond what Catalyst may broadcast. Their files say little:
    weights that are zero take next to no room in them."""
    spark = terms.sparkSession
    held = terms.agg(F.sum(8 * F.col("k") + F.octet_length("term") + 64)).first()[0] or 0
    return held > spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _spread(rows: DataFrame) -> DataFrame:
    """A written table in as many parts as there are cores at least: its rows are unfolded in every round."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return stage(rows.repartition(cores), "spread") if rows.rdd.getNumPartitions() < cores else rows


class Trainer:
    """The rounds of a fit; `weights` is the table of the last one."""

    def __init__(self, docs: DataFrame, specs: Sequence[Spec], edges: Edges):
        unknown = {s.loss for s in specs} - set(CURVATURE)
        if unknown:
            raise ValueError(f"no loss {sorted(unknown)}")
        self.models = _model_table(specs, docs.sparkSession)
        self.vectors = tfidf_vectors(docs, specs)
        labelled, self.nodes = training_rows(docs, specs, edges)
        self.width = min(self.nodes.agg(F.coalesce(F.max(F.size("children")), F.lit(1))).first()[0], WIDE)
        keyed = _blocks(labelled).join(F.broadcast(self.models), "model")
        # many rows hold the same children, so files of rows with children are much smaller than what they hold
        self.examples = _spread(stage(keyed.join(self.vectors.hint("merge"), ["f", "id"]), "examples"))
        steep = F.col("c") * F.when(F.col("loss") == "squared_hinge", CURVATURE["squared_hinge"]).otherwise(CURVATURE["logistic"])
        rows = F.aggregate(F.map_values("labels"), F.lit(0).cast("long"), lambda a, n: a + n)
        reach = F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.abs(t["x"]))
        bound = self.examples.select(
            *BLOCK, (steep * rows * reach).alias("most"), F.size("children").alias("k"), F.inline("terms")
        )
        terms = bound.groupBy(*BLOCK, "term", "k").agg(
            (1 + F.sum(F.col("most") * F.abs("x"))).alias("curvature"), F.count(F.lit(1)).alias("n")
        )
        self.terms = stage(terms, "curvature")
        zeros = F.array_repeat(F.lit(0.0), F.col("k"))
        self.weights = stage(self.terms.select(*BLOCK, "term", zeros.alias("ws"), "n"), "weights")
        self.large = _too_large(self.terms)
        self._frequent = None
        if self.large:
            # which terms are frequent does not change from round to round; counted once
            counts = self.terms.select(*BLOCK, "term", F.col("n").alias("__n"))
            self._frequent = stage(heavy_parts(counts, "__n"), "frequent")

    def _scored(self) -> DataFrame:
        """Examples with `parts`, the slope and the loss of each child."""
        scores = _scores(self.examples, self.weights, self.width, self.large, self._frequent)
        rows = self.examples.join(scores, [*BLOCK, "id"], "left")
        everything = F.aggregate(F.map_values("labels"), F.lit(0).cast("long"), lambda a, n: a + n)

        def of_child(child: Column, place: Column) -> Column:
            score = F.coalesce(F.get("scores", place), F.lit(0.0))
            right = F.coalesce(F.try_element_at("labels", child), F.lit(0))
            slope, loss = slope_and_loss(F.col("loss"), score, right, F.col("everything") - right)
            return F.struct((F.col("c") * slope).alias("slope"), (F.col("c") * loss).alias("loss"))

        rows = rows.withColumn("everything", everything)
        return rows.withColumn("parts", F.transform("children", of_child))

    def step(self) -> None:
        """One round for all weights."""
        keys = [*BLOCK, "term"]
        slopes = self._scored().select(*BLOCK, "terms", F.col("parts.slope").alias("slopes"))
        pieces = slopes.where(F.exists("slopes", lambda d: d != 0)).select(*BLOCK, "slopes", F.inline("terms"))
        found = _sums(pieces, keys, "x", "slopes", self.width, "gs")
        terms = self.terms.drop("n", "k")
        moved = self.weights.join(terms.hint("merge") if self.large else terms, keys).join(found, keys, "left")
        ws = F.transform("ws", lambda w, i: w - (w + F.coalesce(F.get("gs", i), F.lit(0.0))) / F.col("curvature"))
        self.weights = stage(moved.select(*keys, ws.alias("ws"), "n"), "weights")

    def objective(self) -> DataFrame:
        """(model, objective) at the current weights."""
        losses = self._scored().select("model", F.inline("parts")).groupBy("model").agg(F.sum("loss").alias("losses"))
        size = F.aggregate("ws", F.lit(0.0), lambda a, w: a + w * w)
        sizes = self.weights.groupBy("model").agg(F.sum(size).alias("size"))
        return losses.join(sizes, "model").select("model", (F.col("losses") + F.col("size") / 2).alias("objective"))

    def fitted(self) -> Linear:
        return Linear(self.models, self.vectors, self.nodes, self.weights, self.width, self.large)


def fit(docs: DataFrame, specs: Sequence[Spec], edges: Edges, rounds: int = 10) -> Linear:
    """All models of `specs` on `docs`, as made by `bayes.count_texts`, with `rounds` rounds each.

    Rows that a model's split holds back do not count for it. A node with one child needs no weights.
    """
    trainer = Trainer(docs, specs, edges)
    for _ in range(rounds):
        trainer.step()
    return trainer.fitted()


def predict(items: DataFrame, model: Linear) -> DataFrame:
    """(model, parent, id, pred, score, margin, confidence) for items (model, parent, id).

    The child of the highest score, rounded to six decimals; ties go to the smallest child. The margin to the
    second is null where there is none; the confidence is the child's share of the children's probabilities, null
    for a loss without probabilities. An only child needs no score. A parent without a node gives null.
    """
    at_node = join_staged(items, model.nodes, ["model", "parent"], ["id"], "rows")
    at_node = at_node.join(F.broadcast(model.models.select("model", "f", "loss")), "model", "left")
    vectors = at_node.where(F.size("children") > 1).join(model.vectors.hint("merge"), ["f", "id"])
    open_rows = _blocks(vectors.select("model", "parent", "id", "children", "terms"))
    scores = _scores(open_rows, model.weights, model.width, model.large)
    # a row per text again, blocks in order
    whole = scores.groupBy("model", "parent", "id").agg(F.array_sort(F.collect_list(F.struct("block", "scores"))).alias("b"))
    whole = whole.select("model", "parent", "id", F.flatten(F.col("b.scores")).alias("scores"))
    met = at_node.join(whole, ["model", "parent", "id"], "left")
    ranked = F.array_sort(
        F.transform(
            "children",
            lambda c, i: F.struct((-F.round(F.coalesce(F.get("scores", i), F.lit(0.0)), 6)).alias("cost"), c.alias("child")),
        )
    )
    met = met.withColumn("__r", ranked)
    best, second = F.get("__r", F.lit(0)), F.get("__r", F.lit(1))
    shares = F.aggregate("__r", F.lit(0.0), lambda a, r: a + 1 / (1 + F.exp(r["cost"])))
    confidence = F.round(1 / (1 + F.exp(best["cost"])) / shares, 6)
    return met.select(
        "model",
        "parent",
        "id",
        best["child"].alias("pred"),
        (-best["cost"]).alias("score"),
        (second["cost"] - best["cost"]).alias("margin"),
        F.when(F.col("loss") == "logistic", confidence).alias("confidence"),
    )


def descend(items: DataFrame, levels: int, step, root: str = "") -> DataFrame:
    """(model, id, pred): from the root to the child that `step` predicts, level by level, until a node is missing.

    `step` takes (model, parent, id) and returns it with `pred`.
    """
    reached = items.withColumn("parent", F.lit(root))
    for level in range(levels):
        reached = step(reached).select("model", "id", F.coalesce("pred", "parent").alias("parent"))
        if level < levels - 1:
            reached = stage(reached, "reached")
    return reached.withColumnRenamed("parent", "pred")


def weight_table(model: Linear) -> DataFrame:
    """(model, parent, child, term, weight) of every weight that is not zero; the constant has an empty term."""
    rows = model.weights.join(_blocks(model.nodes.select("model", "parent", "children")), BLOCK)
    pairs = F.arrays_zip(F.col("children").alias("child"), F.col("ws").alias("weight"))
    rows = rows.select("model", "parent", "term", F.inline(pairs))
    return rows.where("weight != 0").select("model", "parent", "child", "term", F.round("weight", 6).alias("weight"))


def linear_classifier(
    train: DataFrame,
    test: DataFrame,
    code: str,
    label: str,
    order_col: str = "ROW_ID",
    ngram: tuple[int, int] = (1, 2),
    max_df: float = 1.0,
    c: float = 1.0,
    loss: str = "logistic",
    rounds: int = 10,
) -> DataFrame:
    """Test rows with FLAT_PRED and CONFIDENCE of one node that has every code as a child.

    Fitted on counted distinct rows; each distinct label is predicted once.
    """
    labels = stage(distinct_labels(test, label), "labels")
    docs = add_texts(count_texts(train, code, label), labels)
    model = fit(docs, [Spec(0, 0, *ngram, max_df, c, loss)], flat_edges, rounds)
    items = labels.select(F.lit(0).alias("model"), F.lit(ROOT).alias("parent"), "id")
    answers = labels.select("id", "n").join(predict(items, model).select("id", F.col("pred").alias("FLAT_PRED"), F.col("confidence").alias("CONFIDENCE")), "id")
    return copy_to_rows(test, answers, label, order_col)


def linear_tree_classifier(
    train: DataFrame,
    test: DataFrame,
    code: str,
    label: str,
    order_col: str = "ROW_ID",
    ngram: tuple[int, int] = (1, 2),
    max_df: float = 1.0,
    c: float = 1.0,
    loss: str = "squared_hinge",
    rounds: int = 10,
) -> DataFrame:
    """Test rows with TREE_PRED: from the root of the code tree to the child that its node's weights prefer."""
    labels = stage(distinct_labels(test, label), "labels")
    docs = add_texts(count_texts(train, code, label), labels)
    model = fit(docs, [Spec(0, 0, *ngram, max_df, c, loss)], tree_edges, rounds)
    items = labels.select(F.lit(0).alias("model"), "id")
    paths = descend(items, len(LEVELS), lambda at: predict(at, model))
    answers = labels.select("id", "n").join(paths.select("id", F.col("pred").alias("TREE_PRED")), "id")
    return copy_to_rows(test, answers, label, order_col)
