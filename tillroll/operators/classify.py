"""Flat and hierarchical text classification of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.codes import CODE_LENGTH, LEVELS, prefixes
from tillroll.functions.text import let, words
from tillroll.operators.bayes import (
    Cut,
    Model,
    count_docs,
    count_texts,
    fit,
    fit_splits,
    held_counts,
    predict,
    text_id,
    word_rows,
)
from tillroll.operators.evaluate import hierarchical_scores, weighted_scores
from tillroll.operators.lookup import descriptions
from tillroll.operators.split import is_test, with_fold
from tillroll.plans.skew import join_lookup, join_weighted
from tillroll.session import stage

ROOT = ""
# Fixed value: name of the top training set.
TOP_SET = "division"


def flat_edges(code: Column) -> Column:
    """One node that has every code as a child."""
    return F.array(F.struct(F.lit(ROOT).alias("parent"), code.alias("child")))


def tree_edges(code: Column) -> Column:
    """A node per prefix; its children are the prefixes one level finer."""

    def steps(path: Column) -> Column:
        return F.transform(
            path,
            lambda p, i: F.struct(F.coalesce(F.get(path, i - 1), F.lit(ROOT)).alias("parent"), p.alias("child")),
        )

    return let(prefixes(code), steps)


def level_edges(code: Column) -> Column:
    """A node per level; its children are the prefixes of that level."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("parent"), F.substring(code, 1, length).alias("child"))
            for name, (length, _) in LEVELS.items()
        ]
    )


def distinct_labels(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """(*by, id, text, n): what has to be predicted, and how many rows will receive it."""
    text = F.col(label)
    labels = df.where(text.isNotNull()).groupBy(*(by or []), text.alias("text"))
    return labels.agg(F.count(F.lit(1)).alias("n")).withColumn("id", text_id(F.col("text")))


def at_root(items: DataFrame, cut: Cut = words) -> DataFrame:
    return word_rows(items, cut).withColumn("parent", F.lit(ROOT))


def copy_to_rows(df: DataFrame, answers: DataFrame, label: str, order_col: str) -> DataFrame:
    """Give every row with a label the answer of its label; `answers` has (id, n, ...)."""
    rows = df.where(F.col(label).isNotNull()).withColumn("__id", text_id(F.col(label)))
    joined = join_weighted(rows, answers.withColumnRenamed("id", "__id"), ["__id"], [order_col], "n")
    return joined.drop("__id")


def fit_flat(train: DataFrame, code: str, label: str, cut: Cut = words) -> Model:
    return fit(count_docs(train, code, label), flat_edges, cut=cut)


def predict_distinct(
    df: DataFrame,
    model: Model,
    nomenclature: DataFrame,
    label: str = "DESCRIPTION_EAN_FINAL",
    out: str = "COICOP_PREDICTED",
    out_description: str = "DESC_COICOP_PRED",
    order_col: str = "ROW_ID",
) -> DataFrame:
    """Predict each distinct description once and copy code and description to its rows.

    Rows without a description are dropped.
    """
    answers = predict(at_root(distinct_labels(df, label), model.cut), model).select("id", "n", F.col("pred").alias(out))
    table = descriptions(nomenclature, "poste").toDF(out, out_description)
    described = join_lookup(answers, table, [out], ["id"])
    return copy_to_rows(df, described, label, order_col)


def predict_flat(test: DataFrame, model: Model, label: str, order_col: str = "ROW_ID") -> DataFrame:
    """Test rows with FLAT_PRED and CONFIDENCE of a model that `fit_flat` made."""
    answers = predict(at_root(distinct_labels(test, label), model.cut), model).select(
        "id", "n", F.col("pred").alias("FLAT_PRED"), F.col("confidence").alias("CONFIDENCE")
    )
    return copy_to_rows(test, answers, label, order_col)


def flat_classifier(
    train: DataFrame, test: DataFrame, code: str, label: str, order_col: str = "ROW_ID", cut: Cut = words
) -> DataFrame:
    """Test rows with FLAT_PRED and CONFIDENCE, from the features that `cut` makes of a label."""
    return predict_flat(test, fit_flat(train, code, label, cut), label, order_col)


def lcpn_training_sets(df: DataFrame, code: str, label: str) -> DataFrame:
    """(parent, child, text): per parent prefix its rows with their next digit; the top set has divisions."""
    pairs = df.where(F.col(code).isNotNull()).select(
        F.inline(tree_edges(F.col(code))), F.col(label).alias("text")
    )
    top = F.col("parent") == ROOT
    return pairs.select(
        F.when(top, TOP_SET).otherwise(F.col("parent")).alias("parent"),
        F.when(top, F.col("child")).otherwise(F.right("child", F.lit(1))).alias("child"),
        "text",
    )


def lcpn_model_count(df: DataFrame, code: str) -> DataFrame:
    """Number of parents below the root, which is the number of models to train there."""
    codes = df.where(F.col(code).isNotNull()).select(F.col(code).alias("code")).distinct()
    parents = codes.select(F.explode(tree_edges(F.col("code"))).alias("e")).select("e.parent")
    return parents.where(F.col("parent") != ROOT).agg(F.countDistinct("parent").alias("models"))


def descend(tokens: DataFrame, model: Model) -> DataFrame:
    """(*by, id, pred): at each level an item goes to the child its node predicts, until a node is missing.

    `tokens` are word rows without parent; they are read once per level.
    """
    keys = [*model.by, "id"]
    reached = tokens.withColumn("parent", F.lit(ROOT))
    for step in range(len(LEVELS)):
        paths = predict(reached, model).select(*keys, F.coalesce("pred", "parent").alias("parent"))
        if step < len(LEVELS) - 1:
            reached = tokens.join(paths, keys)
    return paths.withColumnRenamed("parent", "pred")


def lcpn_classifier(
    train: DataFrame, test: DataFrame, code: str, label: str, order_col: str = "ROW_ID", cut: Cut = words
) -> DataFrame:
    """Top-down prediction, one row per distinct description: its first test row with LCPN_PRED.

    At each level a description goes to the child its node predicts. Paths that
    stop before the finest level are dropped.
    """
    model = fit(count_docs(train, code, label), tree_edges, cut=cut)
    tokens = stage(word_rows(distinct_labels(test, label).drop("n"), cut), "words")
    complete = descend(tokens, model).where(F.length("pred") == CODE_LENGTH)
    first = test.groupBy(text_id(F.col(label)).alias("id")).agg(F.min(order_col).alias(order_col))
    found = complete.join(first, "id").select(order_col, F.col("pred").alias("LCPN_PRED"))
    return test.join(found, order_col).select(*test.columns, "LCPN_PRED")


def backoff_prediction(threshold: float) -> Column:
    """The finest prediction whose margin is above the threshold, "" if there is none."""
    choices = [
        F.when(F.col(f"DIFF_PROB_{name.upper()}") > threshold, F.col(f"{name.upper()}_PRED")) for name in LEVELS
    ]
    return F.coalesce(*choices, F.lit(""))


def lcpl_classifier(
    train: DataFrame,
    test: DataFrame,
    code: str,
    label: str,
    threshold: float = 0.5,
    order_col: str = "ROW_ID",
) -> DataFrame:
    """Test rows with an independent prediction and margin per level, and the back-off choice CONFIDENCE_PRED."""
    model = fit(count_docs(train, code, label), level_edges)
    items = distinct_labels(test, label)
    levels = F.explode(F.array(*[F.lit(n) for n in LEVELS])).alias("parent")
    scored = predict(word_rows(items).select("*", levels), model)
    columns = []
    for name in LEVELS:
        here = F.col("parent") == name
        columns.append(F.max(F.when(here, F.col("pred"))).alias(f"{name.upper()}_PRED"))
        columns.append(F.max(F.when(here, F.col("margin"))).alias(f"DIFF_PROB_{name.upper()}"))
    wide = scored.groupBy("id", "n").agg(*columns).withColumn("CONFIDENCE_PRED", backoff_prediction(threshold))
    return copy_to_rows(test, wide, label, order_col)


def _scored_pairs(docs: DataFrame, splits: int, by: str, first: int, kind: str, cut: Cut) -> DataFrame:
    """(by, true, pred, n) of the flat or the top-down classifier, one model per split of `docs`, all in one job.

    Texts are cut once for all splits; predictions never go back to single rows.
    """
    held = held_counts(docs, ["code", "id"], splits, by, first)
    asked = [F.max((F.get("held", F.lit(i)) > 0).cast("int")).alias(f"__a{i}") for i in range(splits)]
    texts = docs.groupBy("id").agg(F.first("text").alias("text"), *asked)
    marks = F.array(*[F.when(F.col(f"__a{i}") == 1, F.lit(first + i).cast("long")) for i in range(splits)])
    texts = texts.select("id", "text", F.filter(marks, lambda m: m.isNotNull()).alias("__in"))
    tokens = word_rows(texts, cut).select("id", "token", "times", F.explode("__in").alias(by))
    if kind == "flat":
        model = fit_splits(docs, flat_edges, splits, by, first, cut)
        predicted = predict(tokens.withColumn("parent", F.lit(ROOT)), model).select(by, "id", "pred")
    elif kind == "lcpn":
        predicted = descend(stage(tokens, "words"), fit_splits(docs, tree_edges, splits, by, first, cut))
    else:
        raise ValueError(f"no model of kind {kind}")
    pairs = held.join(predicted, [by, "id"]).groupBy(by, F.col("code").alias("true"), "pred")
    return pairs.agg(F.sum("n").alias("n"))


def repeated_holdout(
    df: DataFrame, code: str, label: str, key: str = "ROW_ID", n: int = 5, test: float = 0.2, seed: int = 42,
    model: str = "flat", cut: Cut = words,
) -> DataFrame:
    """Means over `n` random splits of flat and hierarchical precision, recall and F1 of a model, "flat" or "lcpn".

    Split i uses seed + i. Rows are read once and counted per code and text, with the number each split tests on.
    """
    held = [is_test(F.col(key), F.lit(seed + i), test) for i in range(n)]
    pairs = _scored_pairs(count_texts(df, code, label, held), n, "split", seed, model, cut)
    pairs = stage(pairs, "pairs")
    names = ("precision", "recall", "f1")
    flat = weighted_scores(pairs, ["split"]).select("split", *[F.col(c).alias(f"flat_{c}") for c in names])
    tree = hierarchical_scores(pairs, ["split"]).select("split", *[F.col(c).alias(f"hier_{c}") for c in names])
    columns = [f"{kind}_{c}" for kind in ("flat", "hier") for c in names]
    return flat.join(tree, "split").agg(
        F.count(F.lit(1)).alias("splits"), *[F.round(F.avg(c), 6).alias(c) for c in columns]
    )


def kfold_scores(
    df: DataFrame, code: str, label: str, k: int = 5, key: str = "ROW_ID", method: str = "hash",
    model: str = "flat", cut: Cut = words,
) -> DataFrame:
    """(fold, precision, recall, f1, support) of a model, "flat" or "lcpn", on each fold.

    Rows are counted per code and text once, with the number in each fold; a fold trains on the total minus its own.
    """
    rows = with_fold(df.where(F.col(code).isNotNull() & F.col(label).isNotNull()), k, key, method)
    docs = count_texts(rows, code, label, [F.col("fold") == f for f in range(1, k + 1)])
    return weighted_scores(_scored_pairs(docs, k, "fold", 1, model, cut), ["fold"])
