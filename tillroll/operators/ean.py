"""Barcode cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import ean as fe
from tillroll.plans.skew import join_weighted

KEEP = ("DESCRIPTION_EAN", "ID_FAMILLE", "CA", "CA_PRIX_QTE")


def normalise(df: DataFrame, ean: str = "EAN", out: str = "EAN_CLEAN") -> DataFrame:
    trimmed = df.withColumn(ean, fe.trim_ean(F.col(ean)))
    return trimmed.withColumn(out, fe.normalise_ean(F.col(ean)))


def split_valid(
    df: DataFrame, ean: str = "EAN_RECONSTRUCTED", flag: str = "EAN_REMOVE"
) -> tuple[DataFrame, DataFrame]:
    """Rows with a standard barcode, and the others with a flag column. A null barcode is rejected."""
    flagged = df.withColumn(flag, ~F.coalesce(fe.is_standard(F.col(ean)), F.lit(False)))
    return flagged.where(~F.col(flag)).drop(flag), flagged.where(F.col(flag))


def reconstruct(
    df: DataFrame,
    label: str = "DESCRIPTION_EAN",
    ean: str = "EAN_CLEAN",
    out: str = "EAN_RECONSTRUCTED",
    order_col: str = "ROW_ID",
    mode: str = "first",
    min_length: int = 4,
) -> DataFrame:
    """Replace non-standard barcodes by a standard one seen under the same label.

    `mode="first"`: the first standard barcode of the label, for barcodes of at
    least `min_length` characters. `mode="lcs"`: the first standard barcode
    that shares a subsequence of `min_length` characters, not all zeros.
    Rows without label or barcode are dropped.
    """
    if mode not in ("first", "lcs"):
        raise ValueError(f"unknown mode: {mode}")
    rows = df.where(F.col(label).isNotNull())
    standard = fe.has_length(F.col(ean), fe.STANDARD_LENGTHS)
    other = [n for n in range(min_length, max(fe.STANDARD_LENGTHS)) if n not in fe.STANDARD_LENGTHS]
    repairable = fe.has_length(F.col(ean), other, above=max(fe.STANDARD_LENGTHS))
    hopeless = [n for n in range(min_length) if n not in fe.STANDARD_LENGTHS]
    # Standard barcodes, usually nearly all rows, stay where they are: only
    # the repairable ones are shuffled.
    settled = rows.where(fe.has_length(F.col(ean), [*hopeless, *fe.STANDARD_LENGTHS])).withColumn(out, F.col(ean))
    broken = rows.where(repairable)
    # Pairs first: hash aggregation with map-side combining, and a frequent
    # label is spread over its barcodes before it is reduced to one row.
    pairs = rows.groupBy(label, ean).agg(F.count(F.lit(1)).alias("__n"), F.min(order_col).alias("__first"))
    find = _first_standard if mode == "first" else _by_subsequence
    keys, answers = find(pairs, label, ean, standard, repairable, min_length)
    repaired = join_weighted(broken, answers, keys, [order_col], "__n")
    repaired = repaired.withColumn(out, F.coalesce("__found", ean)).drop("__found")
    return settled.unionByName(repaired)


def _first_standard(pairs, label, ean, standard, repairable, size) -> tuple[list[str], DataFrame]:
    """(label, __found, __n) for labels with barcodes to repair and one to repair them with."""
    answers = pairs.groupBy(label).agg(
        F.min_by(F.when(standard, F.col(ean)), F.when(standard, F.col("__first"))).alias("__found"),
        F.sum(F.when(repairable, F.col("__n")).otherwise(0)).alias("__n"),
    )
    return [label], answers.where(F.col("__found").isNotNull() & (F.col("__n") > 0))


def _by_subsequence(pairs, label, ean, standard, repairable, size) -> tuple[list[str], DataFrame]:
    """(label, ean, __found, __n) for the barcodes to repair that have a partner.

    Each barcode is cut into its subsequences of `size` characters; per label
    and subsequence only the first standard barcode survives, so nothing is
    paired up within a label.
    """
    pieces = F.explode(
        F.filter(fe.subsequences(F.col(ean), size), lambda s: s != "0" * size)
    ).alias("__piece")
    broken = pairs.where(repairable)
    whole = pairs.where(standard).join(broken.select(label).distinct(), label, "left_semi")
    offers = whole.select(label, "__first", pieces).groupBy(label, "__piece").agg(F.min("__first").alias("__first"))
    # only the place of the offer is looked for; its barcode is fetched once per answer
    answers = (
        broken.select(label, ean, "__n", pieces)
        .join(offers, [label, "__piece"])
        .groupBy(label, ean)
        .agg(F.min("__first").alias("__first"), F.max("__n").alias("__n"))
        .join(whole.select(label, "__first", F.col(ean).alias("__found")), [label, "__first"])
        .select(label, ean, "__found", "__n")
    )
    return [label, ean], answers


def keep_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns of `keep` that exist, in the order of the table."""
    wanted = {c.upper() for c in keep}
    return df.select(*[c for c in df.columns if c.upper() in wanted])


def clean_ean(
    df: DataFrame,
    ean: str = "EAN",
    label: str = "DESCRIPTION_EAN",
    out: str = "EAN_FINAL",
    order_col: str = "ROW_ID",
    keep: Sequence[str] | None = KEEP,
    mode: str = "first",
) -> DataFrame:
    """Normalise, repair and filter barcodes. `keep=None` keeps the helper columns."""
    rows = reconstruct(normalise(df, ean), label=label, order_col=order_col, mode=mode)
    valid, _ = split_valid(rows)
    valid = valid.withColumnRenamed("EAN_RECONSTRUCTED", out)
    return valid if keep is None else keep_columns(valid, [*keep, out, order_col])
