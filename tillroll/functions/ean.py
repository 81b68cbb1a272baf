"""Column expressions on barcodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of a standard barcode, prefixes of printed editions.
STANDARD_LENGTHS = (8, 13)
EDITION_PREFIXES = ("378", "977", "978", "979")
# Padding that hides an 8-digit barcode; both look at the text before its last 7 characters.
LONG_PADDING = r"550+2"
ANY_PADDING = r"(?:55)?0+2"

# What counts as whitespace at the ends of a barcode: the Unicode blanks and the ASCII separators.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def trim_ean(ean: Column) -> Column:
    return F.btrim(ean, F.lit(WHITESPACE))


def normalise_ean(ean: Column) -> Column:
    """Cut padded barcodes to 13 or 8 characters; the first rule that applies wins.

    One pattern with both rules, so that the column appears once: filters on
    the result are pushed below it and would repeat a longer expression.
    """
    to_13 = f"(?!{LONG_PADDING}.{{7}}).+(.{{13}})"
    to_8 = f"(?={ANY_PADDING}.{{7}}).+(.{{8}})"
    return F.regexp_replace(ean, rf"(?s)^(?:{to_13}|{to_8})\z", "$1$2")


def has_length(ean: Column, lengths: Sequence[int], above: int | None = None) -> Column:
    """Whether the text has one of these lengths or more than `above` characters.

    A single use of the column, since a filter on it is pushed below the cleaning.
    """
    options = [f".{{{n}}}" for n in lengths] + ([f".{{{above + 1},}}"] if above is not None else [])
    return ean.rlike(rf"(?s)^(?:{'|'.join(options)})\z")


def is_standard(ean: Column) -> Column:
    return F.length(ean).isin(*STANDARD_LENGTHS)


def is_edition(ean: Column) -> Column:
    return F.coalesce(F.substring(ean, 1, 3).isin(*EDITION_PREFIXES), F.lit(False))


def subsequences(text: Column, size: int) -> Column:
    """Distinct subsequences of exactly `size` characters.

    Two texts share a common subsequence of at least `size` characters exactly
    when these sets meet, which turns a pairwise test into an equi-join.
    """
    grown = F.aggregate(
        F.split(text, ""),
        F.array(F.lit("")),
        lambda acc, ch: F.array_distinct(
            F.concat(
                acc,
                F.transform(F.filter(acc, lambda s: F.length(s) < size), lambda s: F.concat(s, ch)),
            )
        ),
    )
    return F.filter(grown, lambda s: F.length(s) == size)
