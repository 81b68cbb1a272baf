"""Ranks inside groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4096


def rank_in_group(df: DataFrame, group: Sequence[str], order_col: str, rows: int, out: str) -> DataFrame:
    """Add `out`: the 0-based rank of each row in its group, in a fixed order that follows the hash `order_col`.

    `order_col` is a well-mixed long, `rows` about the number of rows. Groups are cut into buckets by
    the hash, so that a group of all rows has about 4096 rows in a bucket; rows are ranked in their
    bucket, and buckets are placed by their counts. Group columns must not be null. Rows of equal hash
    are ranked in any order.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    group = list(group)
    bucketed = df.withColumn("__bucket", F.pmod(F.col(order_col), F.lit(buckets)))
    counts = bucketed.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(order_col)
    ranked = bucketed.withColumn("__at", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts, [*group, "__bucket"])
    return ranked.select(*df.columns, (F.col("__before") + F.col("__at")).cast("long").alias(out))
