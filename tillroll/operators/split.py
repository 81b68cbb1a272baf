"""Hold-out and fold assignment that depends on keys only, not on row order or partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.plans.ordering import position

TWO_32 = 2**32


def unit_hash(key: Column, seed: Column) -> Column:
    """First eight hex digits of md5(key || seed) as a number below 2**32."""
    digest = F.md5(F.concat(key.cast("string"), seed.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def is_test(key: Column, seed: Column, test: float = 0.2) -> Column:
    return unit_hash(key, seed) < int(test * TWO_32)


def train_test_split(
    df: DataFrame, key: str, test: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    held_out = is_test(F.col(key), F.lit(seed), test)
    return df.where(~held_out), df.where(held_out)


def with_fold(
    df: DataFrame, k: int = 5, key: str = "ROW_ID", method: str = "hash", seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Add the fold number 1..k. `hash`: by key. `contiguous`: equal runs in key order, the first ones
    one row longer where k does not divide the rows; the key is then a unique long."""
    if method == "hash":
        return df.withColumn(out, F.pmod(unit_hash(F.col(key), F.lit(seed)), F.lit(k)) + 1)
    if method != "contiguous":
        raise ValueError(f"unknown method: {method}")
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = position(df, key, "__at").withColumn("__rows", rows)
    at, n = F.col("__at"), F.col("__rows")
    short = F.floor(n / k)
    long_rows = (n % k) * (short + 1)
    fold = F.when(at < long_rows, F.floor(at / (short + 1))).otherwise(
        n % k + F.floor((at - long_rows) / F.greatest(short, F.lit(1)))
    )
    return ranked.select(*df.columns, (fold + 1).cast("long").alias(out))
