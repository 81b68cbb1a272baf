"""Naive Bayes for one or many classification nodes at once, as joins and aggregates.

A node is a parent with children. Under parent p, child c scores
    ln(rows_c / rows_p) + sum over known words t of ln((n_ct + 1) / (N_c + V_p))
where n_ct counts t in c, N_c all words of c and V_p the distinct words under p;
words unseen under p are ignored. Scores are rounded to six decimals and ties
go to the smallest child. All nodes are trained by one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import words
from tillroll.plans.skew import join_staged
from tillroll.session import stage

# code -> array of struct(parent, child)
Edges = Callable[[Column], Column]
# text -> array of its words or other features
Cut = Callable[[Column], Column]


@dataclass(frozen=True)
class Model:
    """`nodes`: (*by, parent, children, rows); `tokens`: (*by, parent, token, hits, n).

    Both arrays have at most one element per child of the node (plus one in
    `hits`), so their size is set by the code list, not by the data. `cut` makes the tokens of a text.
    """

    nodes: DataFrame
    tokens: DataFrame
    by: tuple[str, ...] = ()
    cut: Cut = words


def count_docs(df: DataFrame, code: str, text: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, code, text, n): equal training rows are counted once. Written out, since it is read more than once."""
    docs = (
        df.where(F.col(code).isNotNull() & F.col(text).isNotNull())
        .groupBy(*by, F.col(code).alias("code"), F.col(text).alias("text"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return stage(docs, "docs")


def count_texts(df: DataFrame, code: str, label: str, held: Sequence[Column] = ()) -> DataFrame:
    """(code, text, id, n, held): rows per code and text, and how many of them each split holds back.

    One pass over the rows, whatever the number of splits; without splits one that holds nothing back. Written out.
    """
    flags = [F.sum(h.cast("long")) for h in held] or [F.lit(0).cast("long")]
    docs = (
        df.where(F.col(code).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(code).alias("code"), F.col(label).alias("text"))
        .agg(F.count(F.lit(1)).alias("n"), F.array(*flags).alias("held"))
    )
    return stage(docs.withColumn("id", text_id(F.col("text"))), "docs")


def split_counts(rows: DataFrame, keys: Sequence[str], splits: int, by: str, first: int = 0) -> DataFrame:
    """(by, *keys, n): what each split trains on, the total minus what it holds back, for `rows` with n and held.

    Rows are added up per key for all splits at once; a key is unfolded only afterwards.
    """
    sums = rows.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(F.get("held", F.lit(i))).alias(f"__h{i}") for i in range(splits)])
    left = [F.struct(F.lit(first + i).cast("long").alias(by), (F.col("n") - F.col(f"__h{i}")).alias("n")) for i in range(splits)]
    return sums.select(*keys, F.inline(F.array(*left))).where("n > 0")


def held_counts(rows: DataFrame, keys: Sequence[str], splits: int, by: str, first: int = 0) -> DataFrame:
    """(by, *keys, n): what each split holds back, for `rows` with held."""
    held = [F.struct(F.lit(first + i).cast("long").alias(by), F.get("held", F.lit(i)).alias("n")) for i in range(splits)]
    return rows.select(*keys, F.inline(F.array(*held))).where("n > 0")


def fit(docs: DataFrame, edges: Edges, by: Sequence[str] = (), cut: Cut = words) -> Model:
    """Train all nodes; the model is two written tables."""
    rows = docs.groupBy(*by, "code").agg(F.sum("n").alias("n"))
    tokens = docs.select(*by, "code", F.explode(cut(F.col("text"))).alias("token"), "n")
    return _fit_counts(rows, tokens.groupBy(*by, "code", "token").agg(F.sum("n").alias("n")), edges, by, cut)


def fit_splits(docs: DataFrame, edges: Edges, splits: int, by: str, first: int = 0, cut: Cut = words) -> Model:
    """One model per split of `docs`, as made by `count_texts`, keyed by `by` from `first` on. Texts are cut
    once and their words counted once, whatever the number of splits."""
    tokens = docs.select("code", F.explode(cut(F.col("text"))).alias("token"), "n", "held")
    rows = split_counts(docs, ["code"], splits, by, first)
    return _fit_counts(rows, split_counts(tokens, ["code", "token"], splits, by, first), edges, [by], cut)


def _fit_counts(rows: DataFrame, words_of: DataFrame, edges: Edges, by: Sequence[str], cut: Cut) -> Model:
    """The model from rows per code and words per code."""
    by = list(by)
    rows = (
        rows.select(*by, F.inline(edges(F.col("code"))), "n").groupBy(*by, "parent", "child").agg(F.sum("n").alias("rows"))
    )
    # The levels are unfolded only after the words of a code are summed up.
    counts = (
        words_of.select(*by, F.inline(edges(F.col("code"))), "token", "n")
        .groupBy(*by, "parent", "child", "token")
        .agg(F.sum("n").alias("n"))
    )
    counts = stage(counts, "counts")
    hit = F.struct(F.col("child").alias("child"), F.log(F.col("n") + 1).alias("weight"))
    # The element without a child counts the known words of a text.
    known = F.array(F.struct(F.lit(None).cast("string").alias("child"), F.lit(1.0).alias("weight")))
    tokens = counts.groupBy(*by, "parent", "token").agg(
        F.concat(known, F.collect_list(hit)).alias("hits"), F.sum("n").alias("n")
    )
    vocabulary = counts.groupBy(*by, "parent").agg(F.countDistinct("token").alias("vocabulary"))
    totals = counts.groupBy(*by, "parent", "child").agg(F.sum("n").alias("total"))
    children = rows.join(totals, [*by, "parent", "child"], "left").groupBy(*by, "parent").agg(
        F.sum("rows").alias("rows"), F.collect_list(F.struct("child", "rows", "total")).alias("parts")
    )
    nodes = children.join(vocabulary, [*by, "parent"], "left").select(
        *by,
        "parent",
        F.transform(
            "parts",
            lambda c: F.struct(
                c["child"].alias("child"),
                F.log(c["rows"] / F.col("rows")).alias("prior"),
                (-F.log(F.coalesce(c["total"], F.lit(0)) + F.coalesce("vocabulary", F.lit(1)))).alias("default"),
            ),
        ).alias("children"),
        "rows",
    )
    return Model(stage(nodes, "nodes"), stage(tokens, "tokens"), tuple(by), cut)


def text_id(text: Column) -> Column:
    """Short key of a text, so that long texts do not travel with each of their words."""
    return F.md5(text)


def word_rows(items: DataFrame, cut: Cut = words, text: str = "text") -> DataFrame:
    """`items` without the text, one row per distinct word as `token` with the `times` it occurs.

    A text without words keeps one row, without token.
    """
    rest = [c for c in items.columns if c != text]
    rows = items.select(*rest, F.explode_outer(cut(F.col(text))).alias("token"))
    return rows.groupBy(*rest, "token").agg(F.count(F.lit(1)).alias("times"))


def predict(tokens: DataFrame, model: Model) -> DataFrame:
    """One row per item with pred, score, confidence and margin.

    `tokens` has one row per distinct word of an item: `id`, `parent`, `token`, `times`, the
    model's keys and whatever else is to be carried. The words meet the model
    by (parent, token), are summed per child and ranked inside one row per
    item. A parent without a node gives null.
    """
    by = list(model.by)
    carried = [c for c in tokens.columns if c not in ("token", "times")]
    met = join_staged(tokens, model.tokens, [*by, "parent", "token"], ["id", "token"], "n")
    pieces = met.select(*carried, "times", F.explode_outer("hits").alias("h"))
    weight = F.sum(F.col("times") * F.col("h.weight")).alias("weight")
    sums = pieces.groupBy(*carried, F.col("h.child").alias("child")).agg(weight)
    entry = F.when(F.col("child").isNotNull(), F.struct("child", "weight"))
    summed = sums.groupBy(*carried).agg(
        F.map_from_entries(F.collect_list(entry)).alias("__found"),
        F.coalesce(F.sum(F.when(F.col("child").isNull(), F.col("weight"))), F.lit(0.0)).alias("__known"),
    )
    at_node = join_staged(summed, model.nodes, [*by, "parent"], ["id"], "rows")
    ranked = at_node.withColumn(
        "__ranked",
        F.array_sort(
            F.transform(
                "children",
                lambda c: F.struct(
                    (
                        -F.round(
                            c["prior"]
                            + F.col("__known") * c["default"]
                            + F.coalesce(F.try_element_at("__found", c["child"]), F.lit(0.0)),
                            6,
                        )
                    ).alias("cost"),
                    c["child"].alias("child"),
                ),
            )
        ),
    )
    best = F.get("__ranked", F.lit(0))
    odds = ranked.withColumn(
        "__odds", F.transform("__ranked", lambda s: F.exp(F.get("__ranked", F.lit(0))["cost"] - s["cost"]))
    ).withColumn("__sum", F.aggregate("__odds", F.lit(0.0), lambda a, x: a + x))
    second = F.coalesce(F.get("__odds", F.lit(1)), F.lit(0.0))
    return odds.select(
        *carried,
        best["child"].alias("pred"),
        (-best["cost"]).alias("score"),
        F.round(1 / F.col("__sum"), 6).alias("confidence"),
        F.round((1 - second) / F.col("__sum"), 6).alias("margin"),
    )
