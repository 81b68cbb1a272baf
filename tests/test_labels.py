import random

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from tests.test_ean import lcs
from tillroll.functions import text as ft
from tillroll.functions.rules import LABEL_RULES, apply_rules
from tillroll.functions.stopwords import FRENCH
from tillroll.operators import labels


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "label, want",
    [
        ("EAU 1.5L", "EAU   #VOLUME "),
        ("1.5KG RIZ", "#LOT  #POIDS  RIZ"),
        ("3/4 BAGUETTE", "  BAGUETTE"),
        ("L'EAU BIO", "EAU #LABEL"),
        ("3 SAVONS", "#LOT SAVONS"),
        (None, None),
    ],
)
def test_rules(spark, label, want):
    assert one(spark, apply_rules, label) == want


def test_rules_look_at_the_original(spark):
    rules = [(r"\(", ""), (r"^\d+", "#LOT")]
    assert one(spark, lambda c: apply_rules(c, rules), "(3 SAVONS") == "3 SAVONS"
    assert one(spark, lambda c: apply_rules(c, rules, mask="none"), "(3 SAVONS") == "#LOT SAVONS"
    chain = [("a", "c"), ("c", "d")]
    assert one(spark, lambda c: apply_rules(c, chain), "ab") == "cb"
    assert one(spark, lambda c: apply_rules(c, chain, mask="none"), "ab") == "db"


def test_rule_table_is_complete_and_mask_is_checked():
    assert len(LABEL_RULES) == 54
    with pytest.raises(ValueError):
        apply_rules(None, mask="other")


def test_row_level_steps(spark):
    assert one(spark, ft.drop_short_words, "DE ST WC AB SAVON") == " ST WC  SAVON"
    assert one(spark, ft.collapse_spaces, "A   B  ") == "A B "
    assert one(spark, ft.strip_digits, "A1B٣2") == "AB"
    assert one(spark, ft.fold_ascii, "ÇÉÆÞßØŸ") == "CEAEThssOŸ"
    assert one(spark, lambda c: ft.drop_words(c, ["DE", "LA"]), " PAIN  DE LA VILLE ") == "PAIN VILLE"


def test_stop_words_are_those_of_spark(spark):
    assert sorted(FRENCH) == sorted(w.upper() for w in StopWordsRemover.loadDefaultStopWords("french"))


def test_common_subsequence(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choices("ABé D", k=rnd.randint(1, n)))
    pairs = [(word(20), word(20)) for _ in range(100)] + [(word(100), word(100)) for _ in range(20)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", ft.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == lcs(r.a, r.b)


def test_common_subsequence_of_long_labels(spark):
    """Lengths around the borders of the words of bits, carries over several of them, letters beyond ASCII."""
    rnd = random.Random(5)
    pairs = [("A" * n, "A" * m) for n in (62, 63, 124, 125, 186) for m in (61, 63, 124, 187)]
    pairs += [("".join(rnd.choices("ABÉ", k=rnd.randint(1, 500))), "".join(rnd.choices("ABÉ", k=500))) for _ in range(12)]
    pairs += [("".join(rnd.choices("ABCDEFGHIJ ", k=200)), "".join(rnd.choices("ABCDEFGHIJ ", k=n))) for n in (63, 90, 124, 125, 300)]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    got = df.select("a", "b", ft.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()
    assert len(got) == len(pairs) and all(r.n == lcs(r.a, r.b) for r in got)


def similar_by_loop(rows, threshold=75):
    gone = set()
    by_ean = {}
    for row in sorted(rows):
        by_ean.setdefault(row[1], []).append(row)
    for ean, members in by_ean.items():
        for (i, _, a), (j, _, b) in zip(members, members[1:]):
            if ean is not None and 200 * lcs(a, b) / (len(a) + len(b)) > threshold:
                gone.add(j if len(a) > len(b) else i)
    return {r[0] for r in rows} - gone


@pytest.mark.parametrize("large", [False, True])
def test_drop_similar(spark, request, large):
    if large:
        request.getfixturevalue("no_broadcast")
    rnd = random.Random(7)
    base = ["SAVON DOUX", "SAVON DOUX BIO", "PAIN", "PAINS", "SAVON", "TARTE AUX POMMES"]
    # ids on both sides of the block and span borders
    ids = rnd.sample(range(300), 100) + [(1 << 20) * k + d for k in (1, 2, 7) for d in range(20)]
    ids += [(1 << 40) * k + d for k in (1, 3) for d in range(10)]
    rows = [(i, rnd.choice(["E1", "E1", "E1", "E2", None]), rnd.choice(base)) for i in ids]
    df = spark.createDataFrame(rows, "ROW_ID long, EAN_FINAL string, DESCRIPTION_EAN string").repartition(5)
    assert {r.ROW_ID for r in labels.drop_similar_labels(df).collect()} == similar_by_loop(rows)


def test_similar_example(spark):
    df = spark.createDataFrame(
        [(1, "E", "SAVON DOUX"), (2, "E", "SAVON DOUX BIO")], "ROW_ID long, EAN_FINAL string, DESCRIPTION_EAN string"
    )
    assert [r.ROW_ID for r in labels.drop_similar_labels(df).collect()] == [2]


def test_editions_and_short_labels(spark):
    df = spark.createDataFrame(
        [(1, "9781", "ABCD"), (2, None, "ABC"), (3, "376", "AB"), (4, "376", None)],
        "ROW_ID long, EAN_FINAL string, DESCRIPTION_EAN string",
    )
    assert {r.ROW_ID for r in labels.drop_editions(df).collect()} == {2, 3, 4}
    assert {r.ROW_ID for r in labels.drop_short_labels(df).collect()} == {1, 2}


def test_clean_label(spark):
    df = spark.createDataFrame(
        [
            (1, "3761", "Crème de la forêt 2x150g", "F1", 2.0, 1.0),
            (2, "3761", "si", "F1", 2.0, 1.0),
            (3, "9781", "roman", "F1", 2.0, 1.0),
            (4, "3761", None, "F1", 2.0, 1.0),
        ],
        "ROW_ID long, EAN_FINAL string, DESCRIPTION_EAN string, ID_FAMILLE string, CA double, CA_PRIX_QTE double",
    )
    words = spark.createDataFrame([("CREME", "creme"), ("FORET", "forets")], "token string, base string")
    out = labels.clean_label(df, words)
    assert [r.DESCRIPTION_EAN_FINAL for r in out.collect()] == ["CREME FORETS #LOT #POIDS"]
    assert set(out.columns) == {"ROW_ID", "EAN_FINAL", "ID_FAMILLE", "CA", "CA_PRIX_QTE", "DESCRIPTION_EAN_FINAL"}
    plain = labels.clean_label(df)
    assert [r.DESCRIPTION_EAN_FINAL for r in plain.collect()] == ["CREME FORET #LOT #POIDS"]
