"""Scores of predicted codes.

Every score starts from one table: rows and revenue per (true, predicted)
pair. It is formed with map-side combining and is as small as the code list,
however many receipts there are and however often one code occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.codes import prefixes
from tillroll.operators.hierarchy import explode_levels
from tillroll.operators.stats import MONEY


def pair_counts(df: DataFrame, true: str, pred: str, sales: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(*by, true, pred, n, ca) over rows with a true code."""
    money = F.sum(F.col(sales).cast(MONEY)) if sales else F.lit(None).cast("decimal(28,2)")
    return (
        df.where(F.col(true).isNotNull())
        .groupBy(*(by or []), F.col(true).alias("true"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"), money.alias("ca"))
    )


def _f1(precision: Column, recall: Column) -> Column:
    return F.try_divide(2 * precision * recall, precision + recall)


def weighted_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, precision, recall, f1, support): class scores averaged by true class size, 0 where undefined."""
    by = by or []
    hit = F.col("true") == F.col("pred")
    # One row per pair and side: its true class and its predicted class.
    zero = F.lit(0).cast("long")

    def side(code: str, support: Column, tp: Column, predicted: Column) -> Column:
        return F.struct(
            F.col(code).alias("code"), support.alias("support"), tp.alias("tp"), predicted.alias("predicted")
        )

    n = F.col("n")
    sides = pairs.select(
        *by,
        F.inline(
            F.array(side("true", n, F.when(hit, n).otherwise(zero), zero), side("pred", zero, zero, n))
        ),
    )
    classes = sides.groupBy(*by, "code").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "predicted")])
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    scored = classes.where(F.col("support") > 0).select(
        *by, "support", precision.alias("p"), recall.alias("r"), F.coalesce(_f1(precision, recall), F.lit(0.0)).alias("f")
    )
    weight = F.sum("support")

    def mean(c: str) -> Column:
        return F.round(F.sum(F.col(c) * F.col("support")) / weight, 6)

    return scored.groupBy(*by).agg(
        mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"), weight.alias("support")
    )


def classification_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    return weighted_scores(pair_counts(df, true, pred))


def flat_metrics(df: DataFrame, true: str = "POSTE", pred: str = "POSTE_PRED") -> DataFrame:
    """Precision, recall and F1 of the finest level."""
    return classification_metrics(df, true, pred).drop("support")


def revenue_weighted_metrics(df: DataFrame, true: str, pred: str, sales: str) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) in revenue.

    A wrong prediction counts as a false positive only if the predicted code is a true code somewhere.
    """
    pairs = pair_counts(df, true, pred, sales)
    hit = F.coalesce(F.col("true") == F.col("pred"), F.lit(False))
    zero = F.lit(0).cast("decimal(28,2)")

    def side(code: str, seen: bool, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(
            F.col(code).alias("code"), F.lit(int(seen)).alias("seen"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
        )

    right, wrong = F.when(hit, F.col("ca")).otherwise(zero), F.when(~hit, F.col("ca")).otherwise(zero)
    classes = (
        pairs.select(F.inline(F.array(side("true", True, right, zero, wrong), side("pred", False, zero, wrong, zero))))
        .groupBy("code")
        .agg(F.max("seen").alias("seen"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    sums = classes.where(F.col("seen") == 1).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("tp", "fp", "fn")]
    )
    sums = sums.select(
        "*",
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("r"),
    )
    return sums.select(
        "tp", "fp", "fn",
        F.round("p", 6).alias("precision"),
        F.round("r", 6).alias("recall"),
        F.round(_f1(F.col("p"), F.col("r")), 6).alias("f1"),
    )


def accuracy_by_level(df: DataFrame, true: str, pred: str, sales: str | None = None) -> DataFrame:
    """(level, digits, row_share[, revenue_share]) of rows predicted right at each level."""
    levels = explode_levels(pair_counts(df, true, pred, sales), "true", "pred")
    hit = F.col("true") == F.col("pred")

    def share(c: str) -> Column:
        right = F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).cast("double")
        return F.round(F.try_divide(right, F.sum(c).cast("double")), 6)

    columns = [share("n").alias("row_share")]
    if sales:
        columns.append(share("ca").alias("revenue_share"))
    return levels.groupBy("level", (6 - F.col("level_no")).alias("digits")).agg(*columns)


def hierarchical_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, precision, recall, f1): shared ancestors over predicted and over true ancestors, codes included.

    A row without prediction has no predicted ancestors; its true ones count.
    """
    none = F.array().cast("array<string>")
    true = prefixes(F.col("true"))
    pred = F.when(F.col("pred").isNotNull(), prefixes(F.col("pred"))).otherwise(none)
    sums = pairs.groupBy(*(by or [])).agg(
        F.sum(F.size(F.array_intersect(true, pred)) * F.col("n")).alias("shared"),
        F.sum(F.size(pred) * F.col("n")).alias("predicted"),
        F.sum(F.size(true) * F.col("n")).alias("actual"),
    )
    p, r = F.try_divide("shared", "predicted"), F.try_divide("shared", "actual")
    return sums.select(
        *(by or []),
        F.round(p, 6).alias("precision"),
        F.round(r, 6).alias("recall"),
        F.round(_f1(p, r), 6).alias("f1"),
    )


def hierarchical_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    return hierarchical_scores(pair_counts(df, true, pred))
