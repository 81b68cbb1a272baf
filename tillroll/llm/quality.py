"""Quality rules with thresholds that adapt to each language and source.

Each document is measured by built-in functions only. Its measures per thousand go into quantile
sketches: counts in buckets that are exact below 64 and keep five leading bits above, so that sketches
merge by adding counts, in any order. The sketch of a language and source gives the thresholds; where
it holds too few documents, the sketches of the language are merged, and beyond that all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.plans.skew import join_lookup
from tillroll.session import stage

# Word, line and symbol patterns, and the base rule.
BLANKS = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
LEAST_WORDS, MOST_REPEATED = 50, 50

#: measure, slack above the fence, slack below it (none: no lower fence)
MEASURES = (
    ("symbols", 50, None),  # symbols per 1000 words
    ("repeats", 300, None),  # repeated words per 1000 words
    ("dup_lines", 300, None),  # repeated lines per 1000 lines with words
    ("word_length", 3000, 2000),  # thousandths of a character per word
)
REACH = 3  # interquartile ranges from the quartiles to the fences
LEAST_DOCUMENTS = 100


def _let(value: Column, body) -> Column:
    """`body` of `value`, with `value` computed once per row and not once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice among `words`."""

    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        in_order = F.array_sort(F.transform(h, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            def place(e: Column, i: Column) -> Column:
                again = (e["g"] == F.get(s, i - 1)["g"]) | (e["g"] == F.get(s, i + 1)["g"])
                return F.when(again, e["i"])

            return F.array_sort(F.filter(F.transform(s, place), lambda p: p.isNotNull()))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            _let(in_order, places),
            start,
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    return _let(
        _let(words, windows),
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)),
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    A null text has no words. Columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHARACTER))
    counted = docs.withColumns(
        {
            "__words": _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again"))),
            "__lines": _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))),
            "word_chars": F.length(F.regexp_replace(text, BLANKS, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long"),
        }
    )
    counted = counted.withColumns(
        {
            "n_words": F.col("__words.n").cast("long"),
            "n_repeat_words": F.col("__words.again").cast("long"),
            "n_lines": F.col("__lines.n").cast("long"),
            "n_dup_lines": (F.col("__lines.n") - F.col("__lines.d")).cast("long"),
        }
    ).drop("__words", "__lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _measures() -> Column:
    def rate(a: str, b: str) -> Column:
        return F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")

    values = (
        rate("n_symbols", "n_words"), rate("n_repeat_words", "n_words"), rate("n_dup_lines", "n_lines"),
        rate("word_chars", "n_words"),
    )
    return F.struct(*(v.alias(name) for (name, _, _), v in zip(MEASURES, values)))


def _key(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per language, source, measure and bucket; documents that fail the base rule stay out."""
    pairs = F.array(
        *(F.struct(F.lit(name).alias("measure"), F.col("__m")[name].alias("v")) for name, _, _ in MEASURES)
    )
    rows = measured.where(~F.col("base_failed")).select("__lang", "__source", F.explode(pairs).alias("p"))
    bits = F.length(F.bin("p.v"))
    shift = F.when(F.col("p.v") < 64, F.lit(0)).otherwise(bits - 6)
    rows = rows.select("__lang", "__source", "p.measure", F.col("p.v").alias("v"), shift.alias("shift"))
    step = F.expr("shiftleft(1L, shift)")
    rows = rows.withColumn("low", F.expr("shiftleft(shiftright(v, shift), shift)")).withColumn(
        "high", F.col("low") + step - 1
    )
    return rows.groupBy("__lang", "__source", "measure", "low", "high").agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with `n` documents and a map from measure to its fences."""
    merged = sketch.groupBy(*keys, "measure", "low", "high").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "measure")
    upto = whole.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    quartiles = merged.groupBy(*keys, "measure").agg(
        F.max("total").alias("n"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("low"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("high"))).alias("q3"),
    )
    spread = REACH * (F.col("q3") - F.col("q1"))
    aggregates = [F.max("n").alias("n")]
    for name, above, below in MEASURES:
        here = F.col("measure") == name
        aggregates.append(F.max(F.when(here, F.col("q3") + F.greatest(spread, F.lit(above)))).alias(f"{name}_most"))
        if below is not None:
            aggregates.append(F.max(F.when(here, F.col("q1") - F.greatest(spread, F.lit(below)))).alias(f"{name}_least"))
    return quartiles.groupBy(*keys).agg(*aggregates)


def thresholds(sketch: DataFrame) -> DataFrame:
    """Fences per language and source, from the finest sketch that holds `LEAST_DOCUMENTS`."""
    names = [f"{name}_most" for name, _, _ in MEASURES] + [
        f"{name}_least" for name, _, below in MEASURES if below is not None
    ]

    def packed(df: DataFrame, keys: list[str], out: str) -> DataFrame:
        return df.select(*keys, F.col("n").alias(f"n_{out}"), F.struct(*names).alias(out))

    fine = packed(_fences(sketch, ["__lang", "__source"]), ["__lang", "__source"], "fine")
    lang = packed(_fences(sketch, ["__lang"]), ["__lang"], "lang")
    every = packed(_fences(sketch.withColumn("__all", F.lit(1)), ["__all"]), ["__all"], "every")
    best = (
        F.when(F.col("n_fine") >= LEAST_DOCUMENTS, F.col("fine"))
        .when(F.col("n_lang") >= LEAST_DOCUMENTS, F.col("lang"))
        .otherwise(F.col("every"))
    )
    joined = fine.join(lang, "__lang").withColumn("__all", F.lit(1)).join(every, "__all")
    return joined.select("__lang", "__source", best.alias("__fence"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `carry`, the measures, base_failed and kept.

    kept is false where the base rule fails or a measure lies beyond its fence. Null languages and
    sources form groups of their own; repeated rows are judged each; of other columns only `carry` stays.
    The measured table is written once to the shared folder: sketches and verdicts read it back. So are the
    fences, one row per language and source: they are broadcast if they are small, else joined with heavy
    keys set apart, and the measured rows do not gather by language and source.
    """
    keys = docs.select(
        *(F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)),
        F.col(text_col).alias("__text"),
        _key(lang_col).alias("__lang"),
        _key(source_col).alias("__source"),
    )
    measured = measure(keys, "__text").drop("__text").withColumn("__m", _measures())
    measured = stage(measured, "quality")
    fences = stage(thresholds(sketches(measured)), "fences")
    inside = F.lit(True)
    for name, _, below in MEASURES:
        inside = inside & (F.col("__m")[name] <= F.col("__fence")[f"{name}_most"])
        if below is not None:
            inside = inside & (F.col("__m")[name] >= F.col("__fence")[f"{name}_least"])
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    spread_by = ["__carry_0", "n_words", "word_chars"]
    return join_lookup(measured, fences, ["__lang", "__source"], spread_by).select(
        *(F.col(f"__carry_{i}").alias(c) for i, c in enumerate(carry)),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns of `docs`, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    judged = judge(docs.toDF(*names), of[text_col], of[lang_col], of[source_col], carry=tuple(names))
    return judged.where("kept").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
