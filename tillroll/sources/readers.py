"""Readers for the receipt table and its look-up tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.codes import format_code

RECEIPT_SCHEMA = T.StructType(
    [
        T.StructField("ean", T.StringType()),
        T.StructField("description_ean", T.StringType()),
        T.StructField("id_famille", T.StringType()),
        T.StructField("ca", T.DoubleType()),
        T.StructField("ca_prix_qte", T.DoubleType()),
    ]
)


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def read_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, escape='"')


def read_receipts(
    spark: SparkSession, path: str, extra: T.StructType | None = None
) -> DataFrame:
    """Comma-separated receipts with declared types; names come out in upper case.

    `extra` declares leading columns of the file, such as a row key.
    """
    schema = T.StructType((extra.fields if extra else []) + RECEIPT_SCHEMA.fields)
    return upper_names(spark.read.schema(schema).csv(path, header=True, escape='"'))


def with_row_id(df: DataFrame, out: str = "ROW_ID") -> DataFrame:
    """A row key for sources that have none. Only valid right after a read: it follows file order."""
    return df.select(F.monotonically_increasing_id().alias(out), "*")


def read_labelled(spark: SparkSession, path: str, code: str = "TRUE_COICOP") -> DataFrame:
    """Labelled receipts that have a code."""
    return spark.read.parquet(path).where(F.col(code).isNotNull())


def last_per_key(df: DataFrame, key: str, value: str, order_col: str) -> DataFrame:
    """One row per key; the last row in order wins."""
    return df.groupBy(key).agg(F.max_by(F.struct(value), order_col).alias("__v")).select(
        key, F.col(f"__v.{value}").alias(value)
    )


def first_per_key(df: DataFrame, key: str, value: str, order_col: str) -> DataFrame:
    """One row per key; the first row in order wins."""
    return df.groupBy(key).agg(F.min_by(F.struct(value), order_col).alias("__v")).select(
        key, F.col(f"__v.{value}").alias(value)
    )


def nomenclature(raw: DataFrame, order_col: str = "row_id", level: str | None = None) -> DataFrame:
    """(level, code, description) from raw (level, code, description, order_col).

    Apostrophes leave the code; a repeated code keeps its last description.
    """
    if level is not None:
        raw = raw.where(F.col("level") == level)
    cleaned = raw.withColumn("code", F.replace("code", F.lit("'"), F.lit("")))
    return (
        cleaned.groupBy("level", "code")
        .agg(F.max_by(F.struct("description"), order_col).alias("__v"))
        .select("level", "code", F.col("__v.description").alias("description"))
    )


def ean_family_table(raw: DataFrame, order_col: str = "row_id") -> DataFrame:
    """(ean, id_famille), last row per barcode."""
    return last_per_key(raw, "ean", "id_famille", order_col)


def family_code_table(raw: DataFrame, order_col: str = "row_id") -> DataFrame:
    """(id_famille, code) with the code in dotted form, last row per family."""
    dotted = raw.withColumn("code", format_code(F.col("code_coicop_poste")))
    return last_per_key(dotted, "id_famille", "code", order_col)


def field_survey_table(
    raw: DataFrame,
    brand: str,
    order_col: str = "row_id",
    brand_column: str = "enseigne",
    ean_column: str = "code_barres",
    label_column: str = "libelle",
) -> DataFrame:
    """(EAN_FINAL, LABEL_VARIETE) of one brand, first row per barcode."""
    kept = raw.where(F.col(brand_column) == brand).select(
        F.col(ean_column).alias("EAN_FINAL"),
        F.col(label_column).alias("LABEL_VARIETE"),
        F.col(order_col),
    )
    return first_per_key(kept, "EAN_FINAL", "LABEL_VARIETE", order_col)


def read_survey(
    spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True
) -> DataFrame:
    """Comma-separated survey; lines with more fields than columns are skipped, short ones are filled with null.

    Lines of another length come with their raw text. A mark is put behind it as one more field: it is
    among the first fields of a line that is too short, and beyond them if the line is too long, be the
    surplus fields empty or not.
    """
    raw, mark = "__raw", "\u0001end"
    fields = [T.StructField(c, T.StringType()) for c in columns]
    schema = T.StructType([*fields, T.StructField(raw, T.StringType())])
    lines = spark.read.schema(schema).csv(
        path, header=header, sep=sep, enforceSchema=True, mode="PERMISSIVE", escape='"', columnNameOfCorruptRecord=raw
    )
    again = F.from_csv(
        F.concat(F.col(raw), F.lit(sep + mark)),
        ", ".join(f"`f{i}` string" for i in range(len(columns))),
        {"sep": sep, "escape": '"', "mode": "PERMISSIVE"},
    )
    short = F.array_contains(F.array(*(again[f"f{i}"] for i in range(len(columns)))), mark)
    return lines.where(F.col(raw).isNull() | short).drop(raw)


def variety_code_table(raw: DataFrame, order_col: str = "row_id") -> DataFrame:
    """(LABEL_VARIETE, COICOP_FIELD): "DC_" leaves the label, first row per label, code in dotted form."""
    cleaned = raw.select(
        F.replace("libvariete", F.lit("DC_"), F.lit("")).alias("LABEL_VARIETE"),
        format_code(F.col("idposte"), decimal_tail=True).alias("COICOP_FIELD"),
        F.col(order_col),
    )
    return first_per_key(cleaned, "LABEL_VARIETE", "COICOP_FIELD", order_col)


def parse_labelled_lines(lines: DataFrame, column: str = "value", out: str = "text") -> DataFrame:
    """The text after the first blank of each labelled line."""
    return lines.select(F.regexp_extract(column, r"(?s)^[^ ]* (.*)$", 1).alias(out))
