"""Column expressions on product labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII forms of the Latin-1 letters.
ONE_LETTER = {
    "ÀÁÂÃÄÅ": "A", "Ç": "C", "ÈÉÊË": "E", "ÌÍÎÏ": "I", "Ð": "D", "Ñ": "N",
    "ÒÓÔÕÖØ": "O", "ÙÚÛÜ": "U", "Ý": "Y",
    "àáâãäå": "a", "ç": "c", "èéêë": "e", "ìíîï": "i", "ð": "d", "ñ": "n",
    "òóôõöø": "o", "ùúûü": "u", "ýÿ": "y",
}
MORE_LETTERS = {"Æ": "AE", "Þ": "Th", "ß": "ss", "æ": "ae", "þ": "th"}
FOLD_FROM = "".join(ONE_LETTER)
FOLD_TO = "".join(to * len(chars) for chars, to in ONE_LETTER.items())

# Fixed value: words of one or two characters, but not ST and WC.
SHORT_WORD = r"\b(?!(?:ST|WC)\b)\w{1,2}\b"


def collapse_spaces(label: Column) -> Column:
    return F.regexp_replace(label, " {2,}", " ")


def words(label: Column) -> Column:
    """Whitespace-separated words, none empty."""
    return F.filter(F.split(label, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def drop_words(label: Column, stop: Sequence[str]) -> Column:
    return F.array_join(F.filter(words(label), lambda w: ~w.isin(*stop)), " ")


def fold_ascii(label: Column) -> Column:
    folded = F.translate(label, FOLD_FROM, FOLD_TO)
    for letter, to in MORE_LETTERS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(to))
    return folded


def strip_digits(label: Column) -> Column:
    return F.regexp_replace(label, r"(?U)\d", "")


def drop_short_words(label: Column) -> Column:
    return F.regexp_replace(label, "(?U)" + SHORT_WORD, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Labels up to this length fit the bits of a long.
BITS = 62


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    by_bits = let(F.split(b, ""), lambda chars: _lcs_bits(a, chars))
    by_words = let(F.split(b, ""), lambda chars: _lcs_words(a, chars))
    return F.when(F.length(b) <= BITS, by_bits).otherwise(by_words)


def _bit(j: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), j)


def _lcs_bits(a: Column, b_chars: Column) -> Column:
    """One long per row of the table: bit j is cleared where character j of `b` lengthens the subsequence."""
    size = F.size(b_chars)
    full = _bit(size) - 1
    places = F.sequence(F.lit(0), size - 1)

    def places_of(ch: Column) -> Column:
        return F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda bits, j: F.when(
                F.get(b_chars, j) == ch, bits + _bit(j)
            ).otherwise(bits),
        )

    by_char = F.map_from_entries(
        F.transform(F.array_distinct(b_chars), lambda ch: F.struct(ch, places_of(ch)))
    )
    hits = let(
        by_char,
        lambda found: F.transform(
            F.split(a, ""), lambda ch: F.coalesce(F.try_element_at(found, ch), F.lit(0).cast("long"))
        ),
    )
    left = F.aggregate(
        hits,
        full,
        lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full),
    )
    return size - F.bit_count(left)


def _lcs_words(a: Column, b_chars: Column) -> Column:
    """As `_lcs_bits`, with the bits of a row in as many longs as `b` needs; sums carry from one to the next."""
    size = F.size(b_chars)
    numbers = F.sequence(F.lit(0), F.ceil(size / BITS).cast("int") - 1)
    nothing = F.transform(numbers, lambda _: F.lit(0).cast("long"))

    def full(word: Column) -> Column:
        return _bit(F.least(size - word * BITS, F.lit(BITS))) - 1

    def places_of(ch: Column, word: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(BITS - 1)),
            F.lit(0).cast("long"),
            lambda bits, j: F.when(F.get(b_chars, word * BITS + j) == ch, bits + _bit(j)).otherwise(bits),
        )

    by_char = F.map_from_entries(
        F.transform(
            F.array_distinct(b_chars), lambda ch: F.struct(ch, F.transform(numbers, lambda w: places_of(ch, w)))
        )
    )
    hits = let(
        by_char,
        lambda found: F.transform(F.split(a, ""), lambda ch: F.coalesce(F.try_element_at(found, ch), nothing)),
    )

    def next_row(row: Column, hit: Column) -> Column:
        def add(done: Column, word: Column) -> Column:
            v, m = F.get(row, word), F.get(hit, word)
            total = v + v.bitwiseAND(m) + done["carry"]
            kept = total.bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full(word))
            return F.struct(F.concat(done["row"], F.array(kept)).alias("row"), F.shiftright(total, BITS).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("row"), F.lit(0).cast("long").alias("carry"))
        return F.aggregate(numbers, start, add)["row"]

    last = F.aggregate(hits, F.transform(numbers, full), next_row)
    return size - F.aggregate(last, F.lit(0), lambda n, v: n + F.bit_count(v))


def similarity(a: Column, b: Column) -> Column:
    """200 * LCS / (len(a) + len(b)): 100 for equal labels, 0 for labels with nothing in common."""
    total = F.length(a) + F.length(b)
    return (
        F.when(a == b, F.lit(100.0))
        .when(F.least(F.length(a), F.length(b)) == 0, F.lit(0.0))
        .otherwise(F.lit(200.0) * common_subsequence(a, b) / total)
    )


def similarity_bound(a: Column, b: Column) -> Column:
    """What `similarity` cannot exceed, from the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        F.lit(200.0) * F.least(F.length(a), F.length(b)) / F.greatest(total, F.lit(1))
    )
