"""French stems by the published Snowball rules, as columns of a table of distinct words.

Three regions of a word are found once as places: RV, R1 and R2, each running to the end. A rule looks for the
longest suffix of its list and changes the word if the suffix lies in the region it names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The letters and suffixes of the published rules. U, I and Y stand for letters that are no vowels.
VOWELS = "aeiouyâàëéêèïîôûù"
R2_DELETED = ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes")
AGENTS = ("atrice", "ateur", "ation", "atrices", "ateurs", "ations")
REPLACED = {
    ("logie", "logies"): "log",
    ("usion", "ution", "usions", "utions"): "u",
    ("ence", "ences"): "ent",
}
ADVERBS = ("ement", "ements")
QUALITIES = ("ité", "ités")
ADJECTIVES = ("if", "ive", "ifs", "ives")
FEMININE = ("euse", "euses")
ACTIONS = ("issement", "issements")
MANNERS = ("ment", "ments")
VERBS_I = (
    "îmes", "ît", "îtes", "i", "ie", "ies", "ir", "ira", "irai", "iraIent", "irais", "irait", "iras", "irent", "irez",
    "iriez", "irions", "irons", "iront", "is", "issaIent", "issais", "issait", "issant", "issante", "issantes",
    "issants", "isse", "issent", "isses", "issez", "issiez", "issions", "issons", "it",
)
VERBS_E = (
    "é", "ée", "ées", "és", "èrent", "er", "era", "erai", "eraIent", "erais", "erait", "eras", "erez", "eriez",
    "erions", "erons", "eront", "ez", "iez",
)
VERBS_A = (
    "âmes", "ât", "âtes", "a", "ai", "aIent", "ais", "ait", "ant", "ante", "antes", "ants", "as", "asse", "assent",
    "asses", "assiez", "assions",
)
RESIDUES = ("ion", "ier", "ière", "Ier", "Ière", "e", "ë")
DOUBLED = ("enn", "onn", "ett", "ell", "eill")
RV_PREFIXES = ("par", "col", "tap")

STEP_1 = (
    *R2_DELETED, *AGENTS, *(s for group in REPLACED for s in group), *ADVERBS, *QUALITIES, *ADJECTIVES, *FEMININE,
    *ACTIONS, *MANNERS, "eaux", "aux", "amment", "emment",
)


def longest_suffix(word: Column, suffixes: Sequence[str]) -> Column:
    """The longest of the suffixes that the word ends in, "" if none: the leftmost match up to the end."""
    return F.regexp_extract(word, f"(?:{'|'.join(suffixes)})$", 0)


def _cut(word: Column, n: int | Column) -> Column:
    """The word without its last `n` letters."""
    return F.substring(word, F.lit(1), F.length(word) - n)


def _from(word: Column, place: Column) -> Column:
    return F.substring(word, place + 1, F.length(word))


def _mark_letters(word: Column) -> Column:
    """u and i between vowels, y beside a vowel and u after q in upper case: they do not count as vowels."""
    vowel = f"[{VOWELS}]"
    for pattern, to in (
        ("(?<=q)u", "U"), (f"(?<={vowel})u(?={vowel})", "U"), (f"(?<={vowel})i(?={vowel})", "I"),
        (f"(?<={vowel})y|y(?={vowel})", "Y"),
    ):
        word = F.regexp_replace(word, pattern, to)
    return word


def _after(word: Column, pattern: str) -> Column:
    """Place behind the first match at the beginning of the word, its length if there is none."""
    found = F.regexp_extract(word, pattern, 0)
    return F.when(found != "", F.length(found)).otherwise(F.length(word))


def _ends(word: Column, suffix: str, region: Column) -> Column:
    """Whether the word ends in the suffix and the suffix lies in the region."""
    return word.endswith(suffix) & (F.length(word) - len(suffix) >= region)


def _strip(word: Column, suffix: str, region: Column, otherwise: Column | None = None) -> Column:
    """Without the suffix where it lies in the region; `otherwise` where the word ends in it elsewhere."""
    out = F.when(_ends(word, suffix, region), _cut(word, len(suffix)))
    if otherwise is not None:
        out = out.when(word.endswith(suffix), otherwise)
    return out.otherwise(word)


def _step_1(rows: DataFrame) -> DataFrame:
    """Adds `one`, the word after the standard suffixes, and `verbs`, whether verb suffixes are to be tried."""
    w, p1, p2, pv = (F.col(c) for c in ("w", "p1", "p2", "pv"))
    rows = rows.withColumn("s", longest_suffix(w, STEP_1))
    rows = rows.withColumn("b", _cut(w, F.length("s")))
    s, b = F.col("s"), F.col("b")
    place = F.length(b)
    r1, r2, rv = place >= p1, place >= p2, place >= pv
    iqu = F.concat(_cut(b, 2), F.lit("iqU"))
    after_at = _strip(_cut(b, 2), "at", p2)
    adverb = (
        F.when(_ends(b, "iv", p2), after_at)
        .when(b.endswith("iv"), b)
        .when(_ends(b, "eus", p2), _cut(b, 3))
        .when(_ends(b, "eus", p1), F.concat(_cut(b, 3), F.lit("eux")))
        .when(b.endswith("eus"), b)
        .when(_ends(b, "abl", p2) | _ends(b, "iqU", p2), _cut(b, 3))
        .when(_ends(b, "ièr", pv) | _ends(b, "Ièr", pv), F.concat(_cut(b, 3), F.lit("i")))
        .otherwise(b)
    )
    quality = (
        F.when(_ends(b, "abil", p2), _cut(b, 4))
        .when(b.endswith("abil"), F.concat(_cut(b, 4), F.lit("abl")))
        .when(b.endswith("ic"), _strip(b, "ic", p2, iqu))
        .otherwise(_strip(b, "iv", p2))
    )
    cut_at = _cut(b, 2)
    adjective = F.when(_ends(b, "at", p2), _strip(cut_at, "ic", p2, F.concat(_cut(cut_at, 2), F.lit("iqU")))).otherwise(b)
    vowel_before = F.substring(b, -1, 1).rlike(f"[{VOWELS}]")
    one = F.when(s.isin(*R2_DELETED) & r2, b).when(s.isin(*AGENTS) & r2, _strip(b, "ic", p2, iqu))
    for group, to in REPLACED.items():
        one = one.when(s.isin(*group) & r2, F.concat(b, F.lit(to)))
    one = (
        one.when(s.isin(*ADVERBS) & rv, adverb)
        .when(s.isin(*QUALITIES) & r2, quality)
        .when(s.isin(*ADJECTIVES) & r2, adjective)
        .when(s == "eaux", F.concat(b, F.lit("eau")))
        .when((s == "aux") & r1, F.concat(b, F.lit("al")))
        .when(s.isin(*FEMININE) & r2, b)
        .when(s.isin(*FEMININE) & r1, F.concat(b, F.lit("eux")))
        .when(s.isin(*ACTIONS) & r1 & ~vowel_before, b)
    )
    manner = (
        F.when((s == "amment") & rv, F.concat(b, F.lit("ant")))
        .when((s == "emment") & rv, F.concat(b, F.lit("ent")))
        .when(s.isin(*MANNERS) & vowel_before & (place - 1 >= pv), b)
    )
    return rows.withColumns({"gone": one, "manner": manner}).withColumns(
        {"one": F.coalesce("gone", "manner", "w"), "verbs": F.col("gone").isNull()}
    )


def _verbs(rows: DataFrame) -> DataFrame:
    """Adds `two`, the word after the verb suffixes, all of which have to lie in RV."""
    one, pv, p2 = F.col("one"), F.col("pv"), F.col("p2")
    rows = rows.withColumn("rv", F.when(F.length(one) > pv, _from(one, pv)).otherwise(F.lit("")))
    rv = F.col("rv")
    rows = rows.withColumns({"si": longest_suffix(rv, VERBS_I), "se": longest_suffix(rv, (*VERBS_E, *VERBS_A, "ions"))})
    si, se = F.col("si"), F.col("se")
    before = F.regexp_extract(_cut(rv, F.length(si)), f"[^{VOWELS}]$", 0)
    first = F.when((si != "") & (before != ""), _cut(one, F.length(si)))
    base = _cut(one, F.length(se))
    second = (
        F.when((se == "ions") & (F.length(base) >= p2), base)
        .when(se.isin(*VERBS_E), base)
        .when(se.isin(*VERBS_A), _strip(base, "e", pv))
    )
    return rows.withColumn("two", F.when(F.col("verbs"), F.coalesce(first, second, "one")).otherwise(F.col("one"))).withColumn(
        "changed", F.when(F.col("verbs"), first.isNotNull() | second.isNotNull()).otherwise(True)
    )


def _ending(rows: DataFrame) -> DataFrame:
    """Adds `stem`: what is left of endings, double letters and accents."""
    two, pv, p2 = F.col("two"), F.col("pv"), F.col("p2")
    # a word that changed ends in i for Y and c for ç; any other loses what is left of an ending
    soft = F.when(two.endswith("Y"), F.concat(_cut(two, 1), F.lit("i"))).when(two.endswith("ç"), F.concat(_cut(two, 1), F.lit("c")))
    rows = rows.withColumn("x", F.regexp_replace(two, "(?<=[^aiouès])s$", ""))
    x = F.col("x")
    rows = rows.withColumn("sr", longest_suffix(F.when(F.length(x) > pv, _from(x, pv)).otherwise(F.lit("")), RESIDUES))
    sr, base = F.col("sr"), _cut(x, F.length("sr"))
    rest = (
        F.when(sr == "ion", F.when((F.length(base) >= p2) & base.rlike("[st]$") & (F.length(base) > pv), base).otherwise(x))
        .when(sr.isin("ier", "ière", "Ier", "Ière"), F.concat(base, F.lit("i")))
        .when(sr == "e", base)
        .when((sr == "ë") & base.endswith("gu"), base)
        .otherwise(x)
    )
    rows = rows.withColumn("y", F.when(F.col("changed"), F.coalesce(soft, two)).otherwise(rest))
    y = F.col("y")
    rows = rows.withColumn("y", F.when(longest_suffix(y, DOUBLED) != "", _cut(y, 1)).otherwise(y))
    plain = F.regexp_replace("y", f"[éè](?=[^{VOWELS}]+$)", "e")
    return rows.withColumn("stem", F.lower(plain))


def stems(words: DataFrame, word: str = "token", out: str = "base") -> DataFrame:
    """(word, out) for every row of `words`: its French stem in lower case. A null stays null, an empty word empty."""
    vowel, other = f"[{VOWELS}]", f"[^{VOWELS}]"
    rows = words.select(F.col(word).alias("given"), _mark_letters(F.lower(F.col(word))).alias("w"))
    w = F.col("w")
    to_r1 = f"^.*?{vowel}{other}"
    pv = F.when(w.rlike(f"^(?:{'|'.join(RV_PREFIXES)}|{vowel}{vowel}.)"), F.lit(3)).otherwise(_after(w, f"^.+?{vowel}"))
    rows = rows.withColumns({"pv": F.least(pv, F.length(w)), "p1": _after(w, to_r1)})
    rows = rows.withColumn("p2", F.col("p1") + _after(_from(F.col("w"), F.col("p1")), to_r1))
    rows = _ending(_verbs(_step_1(rows)))
    return rows.select(F.col("given").alias(word), F.col("stem").alias(out))
