"""Mixing sources to target weights by subset-sum budget fitting.

Targets share all words by weight, none above three times its source. What a target asks beyond whole
passes over its source is fitted on the histogram of document lengths: an even share of every length
first, then a bounded knapsack over the rest of the budget. Documents are drawn by a seeded hash
within each length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.ranks import rank_in_group
from tillroll.llm.rowwise import workers_can_import
from tillroll.session import stage

# Words, weights by place of the source, most passes over a source.
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3

KNAPSACK = 16384  # words that the knapsack fits; the even share and single documents come down to it
SEED = 42


def fit(lengths: list[int], counts: list[int], budget: int, capacity: int = KNAPSACK) -> list[int]:
    """How many documents of each length to take, so that their words come as near to `budget` from below as found.

    Even share first; then one more of the longest lengths while more than `capacity` words are
    left; then the best subset sum of what is left, exact over all lengths.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if total <= budget:
        return list(counts)
    taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= capacity:
            break
        more = min(counts[i] - taken[i], (left - capacity + lengths[i] - 1) // lengths[i], left // lengths[i])
        taken[i] += more
        left -= more * lengths[i]
    for i, extra in _knapsack([(i, lengths[i], counts[i] - taken[i]) for i in order], min(left, capacity)):
        taken[i] += extra
    return taken


def _knapsack(items: list[tuple[int, int, int]], budget: int) -> list[tuple[int, int]]:
    """Bounded subset sum: reachable sums as bits, counts split into powers of two, until the budget is reached."""
    mask = (1 << (budget + 1)) - 1
    sums, steps = 1, []
    for i, length, count in items:
        count = min(count, budget // length if length else 0)
        part = 1
        while count > 0 and not sums >> budget & 1:
            part = min(part, count)
            new = (sums | sums << (part * length)) & mask
            if new != sums:
                steps.append((i, part, part * length, sums))
                sums = new
            count -= part
            part *= 2
        if sums >> budget & 1:
            break
    at, chosen = sums.bit_length() - 1, []
    for i, part, words, before in reversed(steps):
        if not before >> at & 1:
            chosen.append((i, part))
            at -= words
    return chosen


def _fit_source(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size")
    got = fit(frame["size"].tolist(), frame["n"].tolist(), int(frame["budget"].iloc[0]))
    return pd.DataFrame({"source_key": frame["source_key"], "size": frame["size"], "extra": got})


def targets(sources: DataFrame) -> DataFrame:
    """(source_key, source_size) to the same with `target` and `passes`.

    `sources` has one row per source: ranked by code point, the empty key (null) last. Targets stand
    below the cap at a common rate per weight; the rate follows from sorting sources by where they
    reach their cap. The windows here hold one row per source, not per document.
    """
    place = Window.orderBy(F.col("source_key") == "", "source_key")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(place) - 1) % len(WEIGHTS) + 1)
    s = sources.withColumn("w", weight.cast("double")).withColumn("cap", (MOST_PASSES * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "source_key")
    every = Window.partitionBy(F.lit(1))
    s = s.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(every).cast("double"),
        }
    ).withColumn("rate", (F.col("all") - F.col("capped")) / F.col("open"))
    # the first source whose cap lies above the rate of the sources still open; later ones give lower rates
    s = s.withColumn("rate", F.max(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.col("rate"))).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("rate") * F.col("w"), F.col("cap")))
    passes = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0)
    return s.select("source_key", "source_size", target.alias("target"), F.least(passes, F.lit(MOST_PASSES)).alias("passes"))


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORDS)).cast("long")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
        carry: tuple[str, ...] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """Columns `carry`, then size, source_size, target, copies and taken, one row per row of `docs`.

    taken is size times copies. Null sources form one source, the last; null texts and texts without
    words have size 0 and are never taken. Equal rows may be told apart in either order, so that
    repeats change nothing in the sums. Of other columns only `carry` stays.
    """
    workers_can_import(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(
        *(F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)),
        key.alias("source_key"),
        size_of(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("draw"),
    )
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    histogram = stage(rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = histogram.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = stage(targets(sources), "targets")
    budget = F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    ask = histogram.where("size > 0").join(goals.select("source_key", budget.alias("budget")), "source_key")
    extra = ask.groupBy("source_key").applyInPandas(_fit_source, "source_key string, size long, extra long")
    plan = histogram.drop("n").join(goals, "source_key").join(extra, ["source_key", "size"], "left")
    plan = plan.withColumns(
        {"passes": F.when(F.col("size") > 0, F.col("passes")).otherwise(0), "extra": F.coalesce("extra", F.lit(0))}
    )
    # ranks and copies are found without what the rows carry
    narrow = rows.select("row", "source_key", "size", "draw")
    ranked = rank_in_group(narrow, ["source_key", "size"], "draw", rows.count(), "__rank")
    copies = (F.col("passes") + (F.col("__rank") < F.col("extra")).cast("long")).cast("long")
    planned = ranked.join(plan, ["source_key", "size"]).select(
        "row", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
    return rows.join(planned, "row").select(
        *(F.col(f"__carry_{i}").alias(c) for i, c in enumerate(carry)),
        "size", "source_size", "target", "copies", "taken",
    )


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of the mix, with the columns of `docs`: each row as often as it is taken."""
    rows = mix(docs, text_col, id_col, source_col, carry=tuple(docs.columns))
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    rows = rows.toDF(*inner, "__size", "__source_size", "__target", "__copies", "__taken").where("__copies > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.select(*(F.col(i).alias(c) for i, c in zip(inner, docs.columns)))
