"""Descriptive statistics of receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _histogram(sizes: DataFrame, size: str) -> DataFrame:
    """(bucket, n, share) of a column of group sizes: buckets 1 to 9 and 10+.

    The share is taken over at most ten rows.
    """
    bucket = F.when(F.col(size) > 9, F.lit("10+")).otherwise(F.col(size).cast("string"))
    counts = sizes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy())
    return counts.select("bucket", "n", F.round(F.col("n") / whole, 6).alias("share"))


def occurrence_histogram(df: DataFrame, column: str) -> DataFrame:
    """How many values of `column` occur once, twice, ... Nulls are not counted."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("size"))
    return _histogram(sizes, "size")


def distinct_histogram(df: DataFrame, group: str, column: str) -> DataFrame:
    """How many groups have one, two, ... distinct values of `column`. Null counts as one value.

    Distinct pairs are formed first, with map-side combining, so a heavy group
    is spread by its values before it is counted.
    """
    pairs = df.where(F.col(group).isNotNull()).select(group, column).distinct()
    sizes = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    return _histogram(sizes, "size")


def receipt_summary(
    df: DataFrame,
    ean: str = "EAN_FINAL",
    label: str = "DESCRIPTION_EAN_FINAL",
    code: str = "TRUE_COICOP",
    sales: str = "CA",
) -> DataFrame:
    """(metric, n, row_share, revenue_share) over all rows and all revenue.

    Rows are first summed up per (barcode, label); everything else, the
    distinct counts included, works on that much smaller table.
    """
    money = F.col(sales).cast(MONEY)
    has_code = F.col(code).isNotNull()
    pairs = df.groupBy(ean, label).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has_code).alias("n_coded"),
        F.sum(money).alias("ca"),
        F.sum(F.when(has_code, money)).alias("ca_coded"),
    )
    long8 = F.length(ean) == 8
    long13 = F.length(ean) == 13
    zero = F.col(ean).startswith("0")

    def where(test: Column, name: str) -> list[Column]:
        return [
            F.sum(F.when(test, F.col("n")).otherwise(0)).alias(f"n_{name}"),
            F.sum(F.when(test, F.col("ca"))).alias(f"ca_{name}"),
        ]

    totals = pairs.agg(
        F.sum("n").alias("n_rows"),
        F.sum("ca").alias("ca_rows"),
        # null counts as one value
        (F.countDistinct(ean) + F.max(F.col(ean).isNull().cast("int"))).alias("n_eans"),
        (F.countDistinct(label) + F.max(F.col(label).isNull().cast("int"))).alias("n_labels"),
        F.sum("n_coded").alias("n_known_code"),
        F.sum("ca_coded").alias("ca_known_code"),
        *where(long8, "length_8"),
        *where(long13, "length_13"),
        *where(zero, "questionable"),
    )

    def line(name: str, shares: bool) -> Column:
        n = F.col(f"n_{name}")
        row_share = F.round(F.try_divide(n, F.col("n_rows")), 6) if shares else F.lit(None).cast("double")
        money_share = (
            F.round(
                F.try_divide(
                    F.coalesce(F.col(f"ca_{name}"), F.lit(0)).cast("double"), F.col("ca_rows").cast("double")
                ),
                6,
            )
            if shares
            else F.lit(None).cast("double")
        )
        return F.struct(
            F.lit(name).alias("metric"),
            n.alias("n"),
            row_share.alias("row_share"),
            money_share.alias("revenue_share"),
        )

    lines = [line(m, False) for m in ("rows", "eans", "labels")]
    lines += [line(m, True) for m in ("known_code", "length_8", "length_13", "questionable")]
    return totals.select(F.inline(F.array(*lines)))
