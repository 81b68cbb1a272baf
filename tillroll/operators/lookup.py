"""Left look-ups in reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.codes import NOT_ELSEWHERE
from tillroll.plans.skew import join_lookup


def lookup(
    df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str, order_col: str = "ROW_ID"
) -> DataFrame:
    """Add `out`: the value of `key` in `table`, null if absent. `table` is unique on `table_key`.

    A null key finds nothing.
    """
    answers = table.select(F.col(table_key).alias(key), F.col(value).alias(out))
    spread = [order_col] if order_col in df.columns else df.columns
    return join_lookup(df, answers, [key], spread)


def descriptions(nomenclature: DataFrame, level: str) -> DataFrame:
    """(code, description) of one level, without the "not elsewhere classified" suffix."""
    return nomenclature.where(F.col("level") == level).select(
        "code", F.replace("description", F.lit(NOT_ELSEWHERE), F.lit("")).alias("description")
    )


def describe_code(
    df: DataFrame, code: str, out: str, nomenclature: DataFrame, level: str = "poste", order_col: str = "ROW_ID"
) -> DataFrame:
    return lookup(df, code, descriptions(nomenclature, level), "code", "description", out, order_col)
