"""Assigning consumption codes by look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.codes import OUT_OF_SCOPE
from tillroll.operators.lookup import describe_code, descriptions
from tillroll.plans.skew import join_lookup, join_weighted
from tillroll.sources.readers import upper_names

# Columns that exist only between the labelling steps.
HELPERS = ("COICOP_FIELD", "DESC_COICOP_FIELD", "LABEL_VARIETE", "FAMILY_COICOP")


def fill_family_from_ean(
    df: DataFrame,
    ean_family: DataFrame,
    family: str = "ID_FAMILLE",
    ean: str = "EAN_FINAL",
    order_col: str = "ROW_ID",
) -> DataFrame:
    """Fill missing families from (ean, id_famille). Rows without a barcode are dropped.

    Rows that have a family ask nothing of the table.
    """
    rows = df.where(F.col(ean).isNotNull()).withColumn(
        "__ask", F.when(F.col(family).isNull(), F.col(ean))
    )
    answers = ean_family.select(F.col("ean").alias("__ask"), F.col("id_famille").alias("__family"))
    joined = join_lookup(rows, answers, ["__ask"], [order_col])
    return joined.withColumn(family, F.coalesce(family, "__family")).select(*df.columns)


def propagate_family_by_label(
    df: DataFrame,
    family: str = "ID_FAMILLE",
    label: str = "DESCRIPTION_EAN_FINAL",
    order_col: str = "ROW_ID",
) -> DataFrame:
    """Fill missing families of a label whose known families agree. Rows without a label are dropped."""
    rows = df.where(F.col(label).isNotNull())
    # Pairs first: hash aggregation, and a frequent label is reduced in parts.
    pairs = rows.groupBy(F.col(label).alias("__ask"), family).agg(F.count(F.lit(1)).alias("__rows"))
    groups = pairs.groupBy("__ask").agg(
        F.min(family).alias("__family"),
        F.max(family).alias("__other"),
        F.sum(F.when(F.col(family).isNull(), F.col("__rows")).otherwise(0)).alias("__n"),
    )
    agreed = groups.where((F.col("__family") == F.col("__other")) & (F.col("__n") > 0)).drop("__other")
    asking = rows.withColumn("__ask", F.when(F.col(family).isNull(), F.col(label)))
    joined = join_weighted(asking, agreed, ["__ask"], [order_col], "__n")
    return joined.withColumn(family, F.coalesce(family, "__family")).select(*df.columns)


def code_from_family(
    df: DataFrame,
    family_code: DataFrame,
    nomenclature: DataFrame,
    family: str = "ID_FAMILLE",
    order_col: str = "ROW_ID",
) -> DataFrame:
    """Add TRUE_COICOP and DESC_COICOP_TRUE from the family; the text "nan" counts as missing.

    The descriptions join the family table first, so the rows are joined once.
    """
    table = family_code.select(
        F.col("id_famille").alias(family),
        F.nullif("code", F.lit("nan")).alias("TRUE_COICOP"),
    )
    table = table.join(
        descriptions(nomenclature, "poste").withColumnRenamed("description", "DESC_COICOP_TRUE"),
        F.col("TRUE_COICOP") == F.col("code"),
        "left",
    ).drop("code")
    return join_lookup(df, table, [family], [order_col])


def code_from_field_survey(
    df: DataFrame,
    survey: DataFrame,
    variety_code: DataFrame,
    nomenclature: DataFrame,
    ean: str = "EAN_FINAL",
    order_col: str = "ROW_ID",
) -> DataFrame:
    """Add LABEL_VARIETE, COICOP_FIELD and DESC_COICOP_FIELD by way of the surveyed variety of a barcode.

    The two small tables are joined to the survey, then the survey once to the rows.
    """
    table = survey.select(F.col("EAN_FINAL").alias(ean), "LABEL_VARIETE").join(
        variety_code, "LABEL_VARIETE", "left"
    )
    table = table.join(
        descriptions(nomenclature, "poste").withColumnRenamed("description", "DESC_COICOP_FIELD"),
        F.col("COICOP_FIELD") == F.col("code"),
        "left",
    ).select(ean, *("LABEL_VARIETE", "COICOP_FIELD", "DESC_COICOP_FIELD"))
    return upper_names(join_lookup(df, table, [ean], [order_col]))


def flag_code_conflicts(df: DataFrame) -> DataFrame:
    """Where both codes are present and differ, note the survey's code and description aside."""
    differ = F.col("TRUE_COICOP") != F.col("COICOP_FIELD")
    return df.withColumn("TRUE_COICOP_CONFLICT", F.when(differ, F.col("COICOP_FIELD"))).withColumn(
        "DESC_COICOP_TRUE_CONFLICT", F.when(differ, F.col("DESC_COICOP_FIELD"))
    )


def fill_code_from_survey(df: DataFrame) -> DataFrame:
    return df.withColumn("TRUE_COICOP", F.coalesce("TRUE_COICOP", "COICOP_FIELD")).withColumn(
        "DESC_COICOP_TRUE", F.coalesce("DESC_COICOP_TRUE", "DESC_COICOP_FIELD")
    )


def label_with_helpers(
    df: DataFrame,
    ean_family: DataFrame,
    family_code: DataFrame,
    survey: DataFrame,
    variety_code: DataFrame,
    nomenclature: DataFrame,
    family: str = "ID_FAMILLE",
    ean: str = "EAN_FINAL",
    label: str = "DESCRIPTION_EAN_FINAL",
    order_col: str = "ROW_ID",
) -> DataFrame:
    """All labelling steps, with the helper columns the reports need."""
    rows = fill_family_from_ean(df, ean_family, family, ean, order_col)
    rows = propagate_family_by_label(rows, family, label, order_col)
    rows = code_from_family(rows, family_code, nomenclature, family, order_col)
    rows = rows.withColumn("FAMILY_COICOP", F.col("TRUE_COICOP"))
    rows = code_from_field_survey(rows, survey, variety_code, nomenclature, ean, order_col)
    return fill_code_from_survey(flag_code_conflicts(rows))


def label_receipts(df: DataFrame, *tables: DataFrame, **columns: str) -> DataFrame:
    """`label_with_helpers` without the helper columns."""
    return label_with_helpers(df, *tables, **columns).drop(*HELPERS)


def labelling_report(before: DataFrame, labelled: DataFrame, family: str = "ID_FAMILLE") -> DataFrame:
    """One row of counts and rates; `before` is the table before and `labelled` the result of
    `label_with_helpers`. A rate over nothing is null.

    "field_equal" is counted after the fill, so it includes rows whose family had no code.
    """
    has_family = F.col(family).isNotNull()
    has_code = F.col("TRUE_COICOP").isNotNull()
    has_field = F.col("COICOP_FIELD").isNotNull()
    conflict = F.col("TRUE_COICOP_CONFLICT").isNotNull()
    families_before = before.agg(F.count(family).alias("n")).scalar()
    counts = labelled.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(has_family).alias("families_after"),
        F.count("FAMILY_COICOP").alias("labels_from_family"),
        F.count_if(F.col("FAMILY_COICOP") == OUT_OF_SCOPE).alias("out_of_scope"),
        F.count_if(has_code & ~has_family).alias("field_new"),
        F.count_if(has_family & (F.col("COICOP_FIELD") == F.col("TRUE_COICOP"))).alias("field_equal"),
        F.count_if(conflict & has_field).alias("field_conflict"),
        F.count("LABEL_VARIETE").alias("field_matched"),
        F.count_if(has_code).alias("labelled"),
    )
    counts = counts.withColumn("families_before", families_before)
    used = F.col("field_new") + F.col("field_equal") + F.col("field_conflict")
    return counts.select(
        "rows",
        "families_before",
        "families_after",
        (F.col("families_after") - F.col("families_before")).alias("families_added"),
        "labels_from_family",
        F.round(F.try_divide("labels_from_family", "families_after"), 6).alias("family_rate"),
        "out_of_scope",
        "field_new",
        "field_equal",
        "field_conflict",
        F.round(F.try_divide(used, F.col("field_matched")), 6).alias("field_rate"),
        F.round(F.try_divide("labelled", "rows"), 6).alias("labelled_share"),
    )


def unmatched_varieties(labelled: DataFrame) -> DataFrame:
    """Surveyed varieties that led to no code."""
    return (
        labelled.where(F.col("COICOP_FIELD").isNull() & F.col("LABEL_VARIETE").isNotNull())
        .select("LABEL_VARIETE")
        .distinct()
    )
