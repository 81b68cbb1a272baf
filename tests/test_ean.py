import itertools
import random

import pytest
from pyspark.sql import functions as F

from tillroll.functions import ean as fe
from tillroll.operators import ean

NORMALISED = [
    ("000000020000001", "0000020000001"),
    ("55000020000001", "20000001"),
    (" 3000000000001 ", "3000000000001"),
    (" 3000000000001\t", "3000000000001"),
    ("000020000001", "20000001"),
    ("003000000000001", "3000000000001"),
    ("55000030000001", "5000030000001"),
    ("12345", "12345"),
    ("5502000000", "5502000000"),
    ("123456789", "123456789"),
    ("", ""),
    (None, None),
]


def test_normalise(spark):
    rows = spark.createDataFrame([(i, e) for i, (e, _) in enumerate(NORMALISED)], "ROW_ID long, EAN string")
    got = {r.ROW_ID: r.EAN_CLEAN for r in ean.normalise(rows).collect()}
    assert [got[i] for i in range(len(NORMALISED))] == [want for _, want in NORMALISED]


def test_trim_is_idempotent(spark):
    rows = spark.createDataFrame([("  x \n",), ("a b",), (" y",)], "e string")
    once = rows.select(fe.trim_ean(F.col("e")).alias("e"))
    assert once.collect() == once.select(fe.trim_ean(F.col("e")).alias("e")).collect()


def test_split_halves_add_up(spark):
    rows = spark.createDataFrame([("1" * n,) for n in range(16)] + [(None,)], "EAN_RECONSTRUCTED string")
    valid, rejected = ean.split_valid(rows)
    assert sorted(len(r[0]) for r in valid.collect()) == [8, 13]
    assert valid.columns == ["EAN_RECONSTRUCTED"]
    assert rejected.count() == 15


def group(spark, codes, label="A"):
    return spark.createDataFrame(
        [(i, label, c) for i, c in enumerate(codes)], "ROW_ID long, DESCRIPTION_EAN string, EAN_CLEAN string"
    )


def repaired(df):
    return {r.ROW_ID: r.EAN_RECONSTRUCTED for r in df.collect()}


def test_reconstruct_first(spark):
    rows = group(spark, ["12345", "123", "20000001", "3000000000001", None])
    rows = rows.unionByName(spark.createDataFrame([(9, None, "12345")], rows.schema))
    assert repaired(ean.reconstruct(rows)) == {0: "20000001", 1: "123", 2: "20000001", 3: "3000000000001"}


def test_reconstruct_does_not_depend_on_partitions(spark):
    rows = group(spark, ["12345", "3000000000001", "20000001", "99999"])
    want = repaired(ean.reconstruct(rows))
    assert repaired(ean.reconstruct(rows.orderBy(F.desc("ROW_ID")).repartition(3))) == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def shares(a, b, size):
    """A common subsequence of at least `size` characters that is not all zeros."""
    subs = lambda t: {"".join(c) for c in itertools.combinations(t, size)}
    common = subs(a) & subs(b)
    assert bool(common) == (lcs(a, b) >= size)
    return bool(common - {"0" * size})


@pytest.mark.parametrize("large", [False, True])
def test_reconstruct_lcs_against_brute_force(spark, request, large):
    if large:
        request.getfixturevalue("no_broadcast")
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        size = rnd.choice([3, 5, 6, 8, 9, 13, 14])
        rows.append((i, rnd.choice("AB"), "".join(rnd.choices("0012", k=size))))
    df = spark.createDataFrame(rows, "ROW_ID long, DESCRIPTION_EAN string, EAN_CLEAN string")
    want = {}
    for i, label, code in rows:
        want[i] = code
        if len(code) not in (8, 13) and len(code) >= 4:
            partners = [c for _, lab, c in rows if lab == label and len(c) in (8, 13) and shares(code, c, 4)]
            want[i] = partners[0] if partners else code
    assert repaired(ean.reconstruct(df, mode="lcs")) == want


def test_clean_ean_keeps_listed_columns(spark):
    rows = spark.createDataFrame(
        [(1, "3000000000001", "A", "F1", 1.0, 1.0), (2, "12", "A", "F1", 1.0, 1.0)],
        "ROW_ID long, EAN string, DESCRIPTION_EAN string, ID_FAMILLE string, CA double, CA_PRIX_QTE double",
    )
    out = ean.clean_ean(rows)
    assert sorted(out.columns) == ["CA", "CA_PRIX_QTE", "DESCRIPTION_EAN", "EAN_FINAL", "ID_FAMILLE", "ROW_ID"]
    assert [r.EAN_FINAL for r in out.collect()] == ["3000000000001"]
