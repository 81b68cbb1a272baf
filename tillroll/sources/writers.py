"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: marker in front of a class in training lines.
LABEL_PREFIX = "__label__"


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def labelled_line(code: Column, text: Column) -> Column:
    """"__label__<code> <text>", null when either part is null."""
    return F.concat(F.lit(LABEL_PREFIX), code, F.lit(" "), text)


def write_labelled_lines(df: DataFrame, code: str, text: str, path: str) -> None:
    lines = df.select(labelled_line(F.col(code), F.col(text)).alias("value"))
    lines.where(F.col("value").isNotNull()).write.mode("overwrite").text(path)


def strip_label_prefix(pred: Column) -> Column:
    return F.replace(pred.cast("string"), F.lit(LABEL_PREFIX), F.lit(""))


def write_setting(best: DataFrame, path: str) -> None:
    """The best setting as text: a heading, and one line of JSON per row."""
    lines = best.select(F.array(F.lit("Best parameters are:"), F.to_json(F.struct("*"))).alias("lines"))
    lines.select(F.explode("lines").alias("value")).coalesce(1).write.mode("overwrite").text(path)
