"""Ordered clean-up rules for product labels.

A rule applies only to labels whose *original* upper-case text matches its
pattern; the replacement then works on the text as the earlier rules left it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.text import let

# Pattern and replacement, in the order of application.
LABEL_RULES: tuple[tuple[str, str], ...] = (
    # notes that are no part of a product name
    ("NON RENSEIGNE", ""),
    ("NON CONNUE", ""),
    ("INCONNU", ""),
    ("QUEL GROUPE:", ""),
    ("FIN DE SERIE", ""),
    ("THIRD PARTY ITEM", ""),
    ("DECOTE", ""),
    ("SOLDES", ""),
    ("DEGAGEMENT", ""),
    ("PROMO DATE COURTE", ""),
    ("DLC COURTE", ""),
    ("FIELD COLLECTED IMAGE RECEIVED", ""),
    # damaged character entities
    ("&AMP", " "),
    ("&QT", ""),
    ("&QUOT", ""),
    ("&TILT", ""),
    ("&GT", ""),
    # apostrophes and punctuation
    (r"[a-zA-Z]\'", ""),
    (r"\'", " "),
    (r"\.", " "),
    (",", " "),
    (";", " "),
    (r"\(", ""),
    (r"\)", ""),
    (r"\*", ""),
    (r"\-", ""),
    (r"\!", ""),
    (r"\?", ""),
    ("&", " "),
    ("/", " "),
    (r"\+", " "),
    # words and quantities that become tags
    (r"\b(LR|AOP|IGP|VPF|VBF|LAB. ROUGE|BIO|HALAL|VVF)\b", "#LABEL"),
    (r"\b\d*(MOIS|JOUR|SEMAINE)[S]?\b", "#MATURATION"),
    (r"\b(HOMME|FEMME|GARÇON|FILLE)\b", "#SEXE"),
    (r"^\d+(?!\S*\/)\b", "#LOT"),
    (r"\d+\s?(V|W)\b", "#PUISSANCE"),
    (r"\d+\s?(X|\*)\s?\d*\s?(G)", "#LOT #POIDS"),
    (r"\b\d*\.?\d*\s?(K?GR?)\b", " #POIDS "),
    (r"\d+\s?(C?M?)\s?(X)\s?\d+\s?(C|M|CM)+\b", "#DIMENSION"),
    (r"\d+\.?\d*\s?(C?MM?)\b", " #DIMENSION "),
    (r"\d+\.?\d*\s?([CM]?L)\b", " #VOLUME "),
    (r"\d+\.?\d*\s?%", " #POURCENTAGE "),
    (r"\b\d+\s?(P)\b", "#LOT"),
    (r"\d+\s?(X|\*)\s?\d*\b", " #LOT "),
    (r"\d*\s?(X|\*)\s?\d+\b", " #LOT "),
    (r"\b(LOT)\s(DE)\b", "#LOT"),
    (r"\d+\.?\d*\s?(CT)\b", " #UNITE "),
    (r"(\sX*S\b)|(\sM\b)|(\sX*L\b)", " #TAILLE "),
    (r"\s\d{2,}\/\d{2,}\b", " #TAILLE "),
    # numbers that are left, and characters outside Latin letters
    (r"\s\d+\b", " "),
    (r"^\d+ ", ""),
    (r"^[0-9]+$", ""),
    (r"[^a-zA-Z\d\s#À-ÖØ-öø-ÿ]", ""),
    (r"\b(\d+)\b", ""),
)

_SPECIAL = set("\\.^$*+?{}[]|()")


def literal_of(pattern: str) -> str | None:
    """The plain text a pattern stands for, or None when it is a real pattern."""
    if len(pattern) == 2 and pattern[0] == "\\" and not pattern[1].isalnum():
        return pattern[1]
    return None if _SPECIAL & set(pattern) else pattern


def apply_rules(
    label: Column,
    rules: Sequence[tuple[str, str]] = LABEL_RULES,
    mask: str = "original",
) -> Column:
    """Run `rules` in order over `label`.

    `mask="original"` ties each rule to the text as it came in, `mask="none"`
    runs the rules one after the other without that condition.
    """
    if mask not in ("original", "none"):
        raise ValueError(f"unknown mask: {mask}")
    text = label
    put_in: set[str] = set()  # characters that replacements may have brought in
    drop_from, drop_to = "", ""  # neighbouring one-character rules, run as one translate

    for pattern, to in rules:
        plain = literal_of(pattern)
        # A character that only the original can contain needs no mask.
        single = plain is not None and len(plain) == 1 and len(to) <= 1
        if single and plain not in put_in:
            if plain not in drop_from:
                # translate() deletes characters that have no counterpart
                if to:
                    drop_from, drop_to = plain + drop_from, to + drop_to
                else:
                    drop_from += plain
            put_in |= set(to)
            continue
        if drop_from:
            text = F.translate(text, drop_from, drop_to)
            drop_from, drop_to = "", ""
        text = _one_rule(text, label, pattern, to, mask)
        put_in |= set(to)
    return F.translate(text, drop_from, drop_to) if drop_from else text


def _one_rule(text: Column, original: Column, pattern: str, to: str, mask: str) -> Column:
    plain = literal_of(pattern)
    if plain is not None:
        # replace() leaves the text alone when it searches for ""
        search = F.lit(plain)
        if mask == "original":
            search = F.when(F.contains(original, search), search).otherwise(F.lit(""))
        return F.replace(text, search, F.lit(to))
    pattern = "(?U)" + pattern
    if mask == "none":
        return F.regexp_replace(text, pattern, to)
    # The running text is bound once, so the expression grows by one step per
    # rule, and most rules end with the first test: no match, nothing to do.
    return let(
        text,
        lambda now: F.when(
            now.rlike(pattern) & original.rlike(pattern), F.regexp_replace(now, pattern, to)
        ).otherwise(now),
    )
