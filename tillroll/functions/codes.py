"""Column expressions on dotted five-level consumption codes (DD.g.c.s.p)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level name -> (characters of a code at that level, name in report tables).
LEVELS = {
    "poste": (10, "Poste"),
    "sous-classe": (8, "Sous-classe"),
    "classe": (6, "Classe"),
    "groupe": (4, "Groupe"),
    "division": (2, "Division"),
}
CODE_LENGTH = 10
OUT_OF_SCOPE = "99.9.9.9.9"
# Fixed value: suffix that descriptions lose.
NOT_ELSEWHERE = " n.c.a."


def format_code(code: Column, decimal_tail: bool = False) -> Column:
    """Digits to dotted code. `decimal_tail` first removes the ".0" of codes that were read as numbers."""
    if decimal_tail:
        code = F.when(code.endswith(".0"), F.replace(code, F.lit(".0"), F.lit(""))).otherwise(code)
    padded = F.when(F.length(code) == 5, F.concat(F.lit("0"), code)).otherwise(code)
    return F.regexp_replace(padded, r"(?<!^)(?<!^.)(.)", r".$1")


def truncate_code(code: Column, steps: int) -> Column:
    """Drop the last `steps` levels, counted from the end of the code."""
    return F.substring(code, F.lit(1), F.greatest(F.length(code) - 2 * steps, F.lit(0)))


def level_name(code: Column) -> Column:
    """Report name of the level a code belongs to, "0" when its length fits none."""
    name = F.lit("0")
    for length, label in LEVELS.values():
        name = F.when(F.length(code) == length, label).otherwise(name)
    return name


def prefixes(code: Column) -> Column:
    """The code and its ancestors, coarsest first, as far as the code goes."""
    steps = F.transform(
        F.array(*[F.lit(n) for n, _ in reversed(LEVELS.values())]),
        lambda n: F.when(n <= F.length(code), F.substring(code, F.lit(1), n)),
    )
    return F.array_compact(steps)
