"""Report tables and the questions asked of them.

Like the scores, the reports start from the small table of (true, predicted) pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.codes import CODE_LENGTH, NOT_ELSEWHERE, level_name
from tillroll.operators.evaluate import pair_counts
from tillroll.operators.hierarchy import explode_levels
from tillroll.operators.lookup import descriptions
from tillroll.session import stage

# Fixed value: what an unknown description is called in the flow report.
NOT_TRACKED = "Non suivi"


def _descriptions(nomenclature: DataFrame, code: str, out: str) -> DataFrame:
    """Descriptions of all levels, to be joined on (level, code)."""
    return nomenclature.select(
        "level",
        F.col("code").alias(code),
        F.replace("description", F.lit(NOT_ELSEWHERE), F.lit("")).alias(out),
    )


def accuracy_table(
    df: DataFrame, nomenclature: DataFrame, true: str = "TRUE_COICOP", pred: str = "COICOP_PREDICTED"
) -> DataFrame:
    """Right predictions and rows per code and level. Codes that were never right or have no description are left out."""
    levels = explode_levels(pair_counts(df, true, pred), "true", "pred")
    counts = levels.groupBy("level", F.col("true").alias("COICOP")).agg(
        F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("NB_CORRECT_PRED"),
        F.sum("n").alias("NB_OCCURENCE"),
    )
    described = counts.where(F.col("NB_CORRECT_PRED") > 0).join(
        _descriptions(nomenclature, "COICOP", "COICOP_DESC"), ["level", "COICOP"], "left"
    )
    return described.select(
        "COICOP",
        "NB_CORRECT_PRED",
        "NB_OCCURENCE",
        (F.col("NB_CORRECT_PRED") / F.col("NB_OCCURENCE")).alias("FREQ_CORRECT_PRED"),
        "COICOP_DESC",
        level_name(F.col("COICOP")).alias("CATEGORY"),
    ).dropna()


def sankey_table(
    df: DataFrame, nomenclature: DataFrame, true: str = "TRUE_COICOP", pred: str = "COICOP_PREDICTED"
) -> DataFrame:
    """Flows from true to predicted description per level, sorted by source inside a level."""
    complete = df.where((F.length(true) == CODE_LENGTH) & F.col(pred).isNotNull())
    levels = explode_levels(pair_counts(complete, true, pred), "true", "pred")
    flows = levels.groupBy("level", "level_no", "true", "pred").agg(F.sum("n").alias("value"))
    flows = flows.join(_descriptions(nomenclature, "true", "source"), ["level", "true"], "left")
    flows = flows.join(_descriptions(nomenclature, "pred", "target"), ["level", "pred"], "left")
    return flows.orderBy("level_no", F.asc_nulls_last("source"), "true", "pred").select(
        "source",
        F.concat("target", F.lit(" ")).alias("target"),
        "value",
        level_name(F.col("true")).alias("CATEGORY"),
    )


# Predicted codes in one slice of the dense matrix, and the most cells that it may have by default.
SLICE_CODES = 256
MOST_CELLS = 100_000_000


def _observed(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(true, pred, n) of rows with a whole true code and a prediction. Written out: it is as small as the code list."""
    complete = df.where((F.length(true) == CODE_LENGTH) & F.col(pred).isNotNull())
    return stage(pair_counts(complete, true, pred).select("true", "pred", "n"), "pairs")


def _described_cells(cells: DataFrame, nomenclature: DataFrame) -> DataFrame:
    cells = cells.withColumn("true_short", F.substring("true", 1, 4))
    for code, out, level in (
        ("true", "desc_true", "poste"),
        ("pred", "desc_pred", "poste"),
        ("true_short", "desc_groupe", "groupe"),
    ):
        table = descriptions(nomenclature, level).toDF(code, out)
        cells = cells.join(table, code, "left")
    return cells


def confusion_pairs(
    df: DataFrame, nomenclature: DataFrame, true: str = "TRUE_COICOP", pred: str = "COICOP_PREDICTED"
) -> DataFrame:
    """The cells of the confusion matrix that are not 0, with the share of the true code's rows and descriptions."""
    pairs = _observed(df, true, pred)
    rows = pairs.groupBy("true").agg(F.sum("n").alias("__rows"))
    cells = pairs.join(rows, "true").select(
        "true", "pred", F.col("n").cast("double").alias("nb"), F.round(F.col("n") / F.col("__rows"), 6).alias("share")
    )
    return _described_cells(cells, nomenclature).orderBy("true", "pred").select(
        "true", "pred", "nb", "share", "desc_true", "desc_pred", "true_short", "desc_groupe"
    )


def confusion_matrix(
    df: DataFrame,
    nomenclature: DataFrame,
    true: str = "TRUE_COICOP",
    pred: str = "COICOP_PREDICTED",
    most_cells: int | None = MOST_CELLS,
) -> DataFrame:
    """Rows per (true, predicted) for every combination of observed codes, 0 where none, with descriptions.

    The result has one row per combination, so the two code lists have to meet: each predicted code belongs to
    one slice of about `SLICE_CODES` codes, each true code is sent to all slices, and they meet in an equi-join
    on the slice. More than `most_cells` combinations are refused; `confusion_pairs` has no such bound.
    """
    pairs = _observed(df, true, pred)
    size = pairs.agg(F.countDistinct("true").alias("t"), F.countDistinct("pred").alias("p")).first()
    if most_cells is not None and size["t"] * size["p"] > most_cells:
        raise ValueError(f"{size['t']} x {size['p']} codes make more than {most_cells} cells")
    slices = max(1, -(-size["p"] // SLICE_CODES))
    trues = pairs.select("true").distinct()
    preds = pairs.select("pred").distinct()
    cells = trues.select("true", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("__slice")).join(
        preds.select("pred", F.pmod(F.hash("pred"), F.lit(slices)).alias("__slice")), "__slice"
    )
    full = cells.join(pairs, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).cast("double").alias("nb"))
    return _described_cells(full, nomenclature).orderBy("true", "pred").select(
        "true", "pred", "nb", "desc_true", "desc_pred", "true_short", "desc_groupe"
    )


def overall_accuracy(accuracy: DataFrame) -> DataFrame:
    """Right predictions over rows, all five levels together."""
    return accuracy.agg(
        F.round(F.try_divide(F.sum("NB_CORRECT_PRED"), F.sum("NB_OCCURENCE")), 6).alias("accuracy")
    )


def top_codes(
    accuracy: DataFrame, category: str = "Poste", n: int = 10, by: str = "size", ascending: bool = False
) -> DataFrame:
    """The first `n` descriptions of a level by class size or by rate of right predictions."""
    measure = F.col({"size": "NB_OCCURENCE", "rate": "FREQ_CORRECT_PRED"}[by])
    order = measure.asc() if ascending else measure.desc()
    return (
        accuracy.where(F.col("CATEGORY") == category)
        .orderBy(order, "COICOP")
        .limit(n)
        .select("COICOP", "COICOP_DESC", "NB_OCCURENCE", "FREQ_CORRECT_PRED")
    )


def sankey_flows(sankey: DataFrame, category: str = "Poste") -> DataFrame:
    return sankey.where(F.col("CATEGORY") == category).select(
        F.coalesce("source", F.lit(NOT_TRACKED)).alias("source"),
        F.coalesce("target", F.lit(NOT_TRACKED)).alias("target"),
        "value",
    )


def sankey_sources(flows: DataFrame) -> DataFrame:
    return flows.select("source").distinct()


def flows_of(flows: DataFrame, source: str) -> DataFrame:
    return flows.where(F.col("source") == source)


def column_range(accuracy: DataFrame, category: str = "Poste") -> DataFrame:
    """Smallest and largest class size and rate of a level."""
    return accuracy.where(F.col("CATEGORY") == category).agg(
        F.min("NB_OCCURENCE").alias("min_size"),
        F.max("NB_OCCURENCE").alias("max_size"),
        F.min("FREQ_CORRECT_PRED").alias("min_rate"),
        F.max("FREQ_CORRECT_PRED").alias("max_rate"),
    )
