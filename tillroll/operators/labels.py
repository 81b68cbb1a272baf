"""Description cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import ean as fe
from tillroll.functions import text as ft
from tillroll.functions.rules import LABEL_RULES, apply_rules
from tillroll.functions.stem import stems
from tillroll.functions.stopwords import FRENCH
from tillroll.operators.ean import keep_columns
from tillroll.plans.ordering import next_in_group
from tillroll.plans.skew import join_lookup, join_weighted
from tillroll.session import stage
from tillroll.sources.readers import upper_names

KEEP = ("EAN_FINAL", "ID_FAMILLE", "CA", "CA_PRIX_QTE")


def drop_editions(df: DataFrame, ean: str = "EAN_FINAL") -> DataFrame:
    flagged = df.withColumn("Edition", fe.is_edition(F.col(ean)))
    return flagged.where(~F.col("Edition"))


def pre_process(label: Column, rules: Sequence[tuple[str, str]] = LABEL_RULES, mask: str = "original") -> Column:
    return ft.collapse_spaces(apply_rules(F.upper(label), rules, mask))


def drop_short_labels(df: DataFrame, label: str = "DESCRIPTION_EAN", len_min: int = 3) -> DataFrame:
    return df.where(F.length(label) >= len_min)


def drop_similar_labels(
    df: DataFrame,
    threshold: float = 75,
    label: str = "DESCRIPTION_EAN",
    ean: str = "EAN_FINAL",
    order_col: str = "ROW_ID",
) -> DataFrame:
    """Of two neighbouring rows of one barcode whose labels are too similar, drop the shorter (on a tie the earlier).

    Similarity is computed once per distinct pair of labels.
    """
    known = df.where(F.col(ean).isNotNull()).select(ean, label, order_col)
    rows = next_in_group(known, [ean], order_col, label, "__next")
    pairs = rows.where(F.col("__next").isNotNull()).select(
        F.col(order_col).alias("__this"),
        F.col(label).alias("__a"),
        F.col(f"__next.{order_col}").alias("__that"),
        F.col(f"__next.{label}").alias("__b"),
    )
    a, b = F.col("__a"), F.col("__b")
    candidates = pairs.where((a == b) | (ft.similarity_bound(a, b) > threshold))
    kinds = candidates.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n"))
    alike = kinds.withColumn("__alike", ft.similarity(a, b) > threshold)
    found = join_weighted(candidates, alike, ["__a", "__b"], ["__this"], "__n").where("__alike")
    losers = found.select(
        F.when(F.length(a) > F.length(b), F.col("__that")).otherwise(F.col("__this")).alias(order_col)
    ).distinct()
    return df.join(losers, order_col, "left_anti")


def normalise_tokens(
    df: DataFrame,
    dictionary: DataFrame,
    label: str = "DESCRIPTION_EAN",
    order_col: str = "ROW_ID",
) -> DataFrame:
    """Replace each word by its base form in upper case; words outside the dictionary stay.

    `dictionary` has one row (token, base) per token. Works on distinct labels,
    so a label is taken apart and put together once.
    """
    counted = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    forms = _base_forms(counted, dictionary, label, label)
    joined = join_weighted(df, forms, [label], [order_col], "__n")
    return joined.withColumn(label, F.col("__form")).select(*df.columns)


def _base_forms(labels: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, __n, __form): the words of `text` in base form, for each row (key, __n, text) of `labels`."""
    known = dictionary.select(F.col("token").alias("__token"), F.col("base").alias("__base"))
    pieces = labels.select(key, "__n", F.posexplode_outer(ft.words(F.col(text))).alias("__pos", "__token"))
    pieces = join_lookup(pieces, known, ["__token"], [key, "__pos"])
    piece = F.struct("__pos", F.coalesce("__base", "__token", F.lit("")).alias("w"))
    ordered = F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["w"])
    glued = F.regexp_replace(F.upper(F.array_join(ordered, " ")), r"(?U)#\s", "#")
    return pieces.groupBy(key, "__n").agg(glued.alias("__form"))


def stem_labels(df: DataFrame, label: str = "DESCRIPTION_EAN", order_col: str = "ROW_ID") -> DataFrame:
    """Replace each word by its French stem in upper case; every distinct word is stemmed once."""
    return normalise_tokens(df, _stem_table(df.select(label), label), label, order_col)


def _stem_table(labels: DataFrame, label: str) -> DataFrame:
    """(token, base) of every word of the labels. Written out, so that its size is known to the join."""
    tokens = labels.select(F.explode(ft.words(F.col(label))).alias("token")).distinct()
    return stage(stems(tokens), "stems")


def clean_text(label: Column, stop: Sequence[str] = FRENCH, rules=LABEL_RULES, mask: str = "original") -> Column:
    """The row-level steps of label cleaning, up to the base forms."""
    cleaned = pre_process(label, rules, mask)
    cleaned = ft.fold_ascii(ft.drop_words(cleaned, stop))
    return ft.collapse_spaces(ft.drop_short_words(ft.strip_digits(cleaned)))


def clean_label(
    df: DataFrame,
    dictionary: DataFrame | None = None,
    ean: str = "EAN_FINAL",
    label: str = "DESCRIPTION_EAN",
    out: str = "DESCRIPTION_EAN_FINAL",
    order_col: str = "ROW_ID",
    keep: Sequence[str] | None = KEEP,
    stop: Sequence[str] = FRENCH,
    len_min: int = 3,
    stem: bool = False,
) -> DataFrame:
    """Clean labels and drop editions and labels that end up too short.

    Words get their base form from `dictionary`, or with `stem` their French stem. Every distinct label is
    cleaned once; the result is joined back to the rows.
    """
    if stem and dictionary is not None:
        raise ValueError("words are stemmed or looked up, not both")
    rows = drop_editions(df, ean)
    counted = (
        rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    )
    cleaned = counted.withColumn("__clean", clean_text(F.col(label), stop))
    if stem:
        cleaned = stage(cleaned, "cleaned")
        dictionary = _stem_table(cleaned, "__clean")
    if dictionary is None:
        cleaned = cleaned.withColumnRenamed("__clean", "__form")
    else:
        cleaned = _base_forms(cleaned, dictionary, label, "__clean")
    # The length test waits until after the join: pushed below the rules it would run them twice.
    answers = cleaned.select(label, "__n", F.col("__form").alias(out))
    joined = join_weighted(rows, answers, [label], [order_col], "__n")
    joined = drop_short_labels(joined, out, len_min).drop(label)
    if keep is not None:
        joined = keep_columns(joined, [*keep, out, order_col])
    return upper_names(joined)


def cleaning_report(
    df: DataFrame,
    dictionary: DataFrame | None = None,
    ean: str = "EAN_FINAL",
    label: str = "DESCRIPTION_EAN",
    order_col: str = "ROW_ID",
    stop: Sequence[str] = FRENCH,
    len_min: int = 3,
) -> DataFrame:
    """(step, rows_removed) of `clean_label`: editions, then labels that are too short once cleaned.

    A missing label counts as too short. The rows removed and the rows `clean_label` returns add up to
    the rows of `df`.
    """
    out = "__final"
    kept = clean_label(df, dictionary, ean, label, out, order_col, None, stop, len_min)
    counts = df.agg(F.count(F.lit(1)).alias("all"))
    left = drop_editions(df, ean).agg(F.count(F.lit(1)).alias("rows"))
    both = stage(left.select("rows", kept.agg(F.count(F.lit(1)).alias("kept")).scalar().alias("kept")), "left")
    rows, final = both.select("rows").scalar(), both.select("kept").scalar()
    steps = [
        F.struct(F.lit("edition").alias("step"), (F.col("all") - rows).alias("rows_removed")),
        F.struct(F.lit("short").alias("step"), (rows - final).alias("rows_removed")),
    ]
    return counts.select(F.inline(F.array(*steps)))
