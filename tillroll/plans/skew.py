"""Joins of rows to one answer per key that hold when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import stage

# A key is heavy when it holds more than 1/HEAVY_PARTS of all rows, so there
# are fewer than HEAVY_PARTS heavy keys whatever the size of the data. This is
# the bound that makes broadcasting their answers safe.
HEAVY_PARTS = 10_000

# Answers of heavy keys are broadcast up to this size; beyond it they are
# copied to SALTS places each and joined by shuffle.
BROADCAST_BYTES = 64 << 20
SALTS = 64


def size_in_bytes(table: DataFrame) -> int:
    """Catalyst's own size estimate; for a written table the size of its files."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(table: DataFrame) -> bool:
    """Whether Catalyst's own size estimate lets it broadcast `table`."""
    conf = table.sparkSession._jsparkSession.sessionState().conf()
    return size_in_bytes(table) <= conf.autoBroadcastJoinThreshold()


def heaviest(counted: DataFrame, weight: str) -> DataFrame:
    """Rows of `counted` whose `weight` is more than 1/HEAVY_PARTS of the total, without that column."""
    total = counted.agg(F.sum(weight)).scalar()
    return counted.where(F.col(weight) * HEAVY_PARTS > total).drop(weight)


def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = rows.dropna(subset=list(keys)).select(*keys)
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))


def join_weighted(
    rows: DataFrame, answers: DataFrame, keys: Sequence[str], spread_by: Sequence[str], weight: str
) -> DataFrame:
    """Left join of `rows` to `answers`, which has one row per key and knows how many rows
    each concerns (`weight`, not part of the result).

    The answers are written to the shared folder first. So `rows` is read once
    to find them and once to receive them, and their size is known, not guessed:
    Catalyst broadcasts them if they are below its threshold.
    """
    return join_staged(rows, stage(answers, "answers"), keys, spread_by, weight)


def join_staged(
    rows: DataFrame, answers: DataFrame, keys: Sequence[str], spread_by: Sequence[str], weight: str
) -> DataFrame:
    """`join_weighted` for answers that are a written table already."""
    if fits_broadcast(answers):
        return _plain(rows, answers.drop(weight), keys)
    answers = answers.drop(weight)
    return join_answers(rows, answers, keys, spread_by, heavy_answers(rows, answers, keys))


def heavy_answers(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for every frequent key of `rows`, with its answer from `table` or nulls where it has none."""
    keys = list(keys)
    frequent = stage(heaviest(stage(key_counts(rows, keys), "counts"), "__n"), "frequent")
    found = table.join(F.broadcast(frequent), keys, "left_semi")
    return stage(frequent.join(found, keys, "left").select(*table.columns), "heavy")


def join_lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], spread_by: Sequence[str]
) -> DataFrame:
    """Left join of `rows` to a reference table that is unique on `keys`.

    A table below the broadcast threshold is joined plainly. Where the estimate
    says more, the table is written out to learn its size; if it really is
    larger, the frequent keys of `rows` are counted and the join is skew-proof.
    """
    if fits_broadcast(table):
        return _plain(rows, table, keys)
    table = stage(table, "lookup")
    if fits_broadcast(table):
        return _plain(rows, table, keys)
    return join_answers(rows, table, keys, spread_by, heavy_answers(rows, table, keys))


def _plain(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in table.columns if c not in keys]
    return rows.join(table, list(keys), "left").select(*rows.columns, *values)


def join_answers(
    rows: DataFrame,
    answers: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    heavy: DataFrame,
) -> DataFrame:
    """Left join of `rows` to `answers`, which has one row per key; `heavy` has the heavy keys, with
    their answers or nulls.

    Answers of heavy keys travel by broadcast, or salted where they are too large for that. The other
    keys are joined by shuffle; rows of heavy keys and rows with a null key take part in that shuffle
    under a 64-bit hash of `spread_by`, so no partition receives a whole heavy key.

    Keys (`k`) and values (`v`) have prefixes of their own, so that they may be called like the columns made here.
    """
    keys = list(keys)
    values = [c for c in answers.columns if c not in keys]
    heavy_side = heavy.select(
        *[F.col(k).alias(f"__h_k_{k}") for k in keys],
        F.struct(*values, F.lit(True).alias("__hit")).alias("__hot"),
    )
    if size_in_bytes(heavy) <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(heavy_side), _all_equal(rows, heavy_side, keys, "__h_k_"), "left")
    else:
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
        heavy_side = heavy_side.withColumn("__h_salt", F.explode(salts))
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
        on = _all_equal(salted, heavy_side, keys, "__h_k_") & (salted["__salt"] == heavy_side["__h_salt"])
        met = salted.join(heavy_side, on, "left").drop("__salt", "__h_salt")
    met = met.drop(*[f"__h_k_{k}" for k in keys])

    answered = F.col("__hot").isNotNull()
    idle = answered
    for k in keys:
        idle = idle | F.col(k).isNull()
    bucket = F.xxhash64(*spread_by)
    met = met.select(
        "*",
        *[F.when(~answered, F.col(k)).alias(f"__l_k_{k}") for k in keys],
        F.when(idle, bucket).otherwise(F.lit(0).cast("long")).alias("__l_bucket"),
    )
    cold_side = answers.dropna(subset=keys).select(
        *[F.col(k).alias(f"__c_k_{k}") for k in keys],
        # always 0, but not a literal: it has to stay a join key
        F.pmod(F.xxhash64(*keys), F.lit(1)).cast("long").alias("__c_bucket"),
        *[F.col(v).alias(f"__c_v_{v}") for v in values],
    )
    on = F.col("__l_bucket") == F.col("__c_bucket")
    for k in keys:
        on = on & (F.col(f"__l_k_{k}") == F.col(f"__c_k_{k}"))
    joined = met.join(cold_side, on, "left")
    return joined.select(
        *rows.columns,
        *[
            F.when(F.col("__hot").isNotNull(), F.col(f"__hot.{v}"))
            .otherwise(F.col(f"__c_v_{v}"))
            .alias(v)
            for v in values
        ],
    )


def heavy_parts(counted: DataFrame, weight: str) -> DataFrame:
    """The heavy keys of `counted` with `__parts`, the number of parts of 1/HEAVY_PARTS of all rows that each makes up.
    So there are at most HEAVY_PARTS parts more than keys."""
    total = counted.agg(F.sum(weight)).scalar()
    heavy = counted.where(F.col(weight) * HEAVY_PARTS > total)
    return heavy.withColumn("__parts", F.ceil(F.col(weight) * HEAVY_PARTS / total).cast("int")).drop(weight)


def join_dealt(
    rows: DataFrame, answers: DataFrame, keys: Sequence[str], spread_by: Sequence[str], heavy: DataFrame
) -> DataFrame:
    """Left join of `rows` to wide `answers`, which has one row per key; `heavy` are keys with their `__parts`.

    Only the heavy keys are broadcast, not their answers: the rows of such a key are dealt over its parts by a
    64-bit hash of `spread_by`, its answer is copied to each part, and the join is one by shuffle. Rows with a
    null key are dealt out alike. Whatever the size of the files, the answers are not broadcast.
    """
    keys = list(keys)
    values = [c for c in answers.columns if c not in keys]
    named = heavy.select(*[F.col(k).alias(f"__h_k_{k}") for k in keys], F.col("__parts").alias("__h_parts"))

    def with_parts(table: DataFrame) -> DataFrame:
        met = table.join(F.broadcast(named), _all_equal(table, named, keys, "__h_k_"), "left")
        return met.select(*table.columns, F.coalesce("__h_parts", F.lit(1)).alias("__parts"))

    idle = F.lit(False)
    for k in keys:
        idle = idle | F.col(k).isNull()
    bucket = F.xxhash64(*spread_by)
    part = F.when(idle, bucket).otherwise(F.pmod(bucket, F.col("__parts").cast("long")))
    asked = with_parts(rows).withColumn("__l_part", part).drop("__parts")
    told = with_parts(answers.dropna(subset=keys)).select(
        *[F.col(k).alias(f"__c_k_{k}") for k in keys],
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts").cast("long") - 1)).alias("__c_part"),
        *[F.col(v).alias(f"__c_v_{v}") for v in values],
    )
    on = _all_equal(asked, told, keys, "__c_k_") & (asked["__l_part"] == told["__c_part"])
    joined = asked.join(told.hint("merge"), on, "left")
    return joined.select(*rows.columns, *[F.col(f"__c_v_{v}").alias(v) for v in values])


def _all_equal(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & (left[k] == right[f"{prefix}{k}"])
    return on
