"""Neighbours and positions by an order column without one big window.

`order_col` is a unique long. All rows whose id agrees above bit 20 form a
block: at most 2**20 rows, since ids are unique. Blocks that agree above bit 40
form a span: at most 2**20 blocks; there are at most 2**24 spans. Every window
below runs inside a block, over the blocks of a span, or over spans, so none
depends on how many rows one group holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 20
SPAN_BITS = 40


def next_in_group(
    df: DataFrame, group: Sequence[str], order_col: str, value: str, out: str
) -> DataFrame:
    """Add `out`: struct(order_col, value) of the next row of the same group, null at its end."""
    group = list(group)
    rows = df.select(
        "*",
        F.shiftright(order_col, BLOCK_BITS).alias("__block"),
        F.shiftright(order_col, SPAN_BITS).alias("__span"),
    )
    in_block = Window.partitionBy(*group, "__block").orderBy(order_col)
    here = F.struct(F.col(order_col), F.col(value))
    rows = rows.select("*", F.lead(here).over(in_block).alias("__next"), F.row_number().over(in_block).alias("__at"))
    blocks = rows.where(F.col("__at") == 1).select(*group, "__span", "__block", here.alias("__head"))
    spans = blocks.groupBy(*group, "__span").agg(F.min_by("__head", "__block").alias("__span_head"))
    spans = spans.select(
        *group,
        "__span",
        F.lead("__span_head").over(Window.partitionBy(*group).orderBy("__span")).alias("__over_span"),
    )
    in_span = Window.partitionBy(*group, "__span").orderBy("__block")
    blocks = blocks.select(*group, "__span", "__block", F.lead("__head").over(in_span).alias("__over_block"))
    blocks = blocks.join(spans, [*group, "__span"], "left").select(
        *group, "__block", F.coalesce("__over_block", "__over_span").alias("__over")
    )
    return rows.join(blocks, [*group, "__block"], "left").select(
        *df.columns, F.coalesce("__next", "__over").alias(out)
    )


def position(df: DataFrame, order_col: str, out: str) -> DataFrame:
    """Add `out`: the 0-based rank of each row by `order_col` over the whole table."""
    rows = df.select(
        "*",
        F.shiftright(order_col, BLOCK_BITS).alias("__block"),
        F.shiftright(order_col, SPAN_BITS).alias("__span"),
    )
    blocks = rows.groupBy("__span", "__block").agg(F.count(F.lit(1)).alias("__rows"))
    spans = blocks.groupBy("__span").agg(F.sum("__rows").alias("__rows"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "__span",
        F.sum("__rows").over(before.orderBy("__span")).alias("__before_span"),
    )
    blocks = blocks.select(
        "__span",
        "__block",
        F.sum("__rows").over(before.partitionBy("__span").orderBy("__block")).alias("__before_block"),
    ).join(spans, "__span")
    ranked = rows.withColumn(
        "__rank", F.row_number().over(Window.partitionBy("__block").orderBy(order_col)) - 1
    )
    start = F.coalesce("__before_span", F.lit(0)) + F.coalesce("__before_block", F.lit(0))
    return ranked.join(blocks.drop("__span"), "__block").select(
        *df.columns, (start + F.col("__rank")).alias(out)
    )
