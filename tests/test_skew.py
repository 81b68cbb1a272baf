import pytest
from pyspark.sql import functions as F

from tillroll.plans import skew
from tillroll.plans.ordering import position


@pytest.fixture
def rows(spark):
    """30,000 rows: a third under one key, a third without key, the rest under 5,000 keys."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 5000))
    return spark.range(30_000).select("id", key.alias("key"))


@pytest.fixture
def answers(rows):
    counts = skew.key_counts(rows, ["key"])
    return counts.where("key != 'k7'").select("key", "__n", F.concat(F.lit("for "), "key").alias("answer"))


def check(joined):
    wrong = joined.where(
        ~F.col("answer").eqNullSafe(F.when(F.col("key") != "k7", F.concat(F.lit("for "), "key")))
    )
    assert joined.count() == 30_000
    assert wrong.count() == 0


def test_all_rows_get_their_answer(rows, answers, no_broadcast):
    check(skew.join_weighted(rows, answers, ["key"], ["id"], "__n"))


@pytest.mark.parametrize("large", [False, True])
def test_names_of_the_join_itself(spark, no_broadcast, monkeypatch, large):
    """Keys and values that are called like columns the join makes."""
    if large:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    bucket = F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, F.col("id") % 500).otherwise(-1))
    rows = spark.range(3_000).select("id", bucket.alias("bucket"), F.lit("s").alias("salt"), F.lit(1).alias("hit"))
    counts = skew.key_counts(rows, ["bucket", "salt"]).where("bucket != 7")
    table = counts.select("bucket", "salt", "__n", (F.col("bucket") * 2).alias("k_bucket"), F.lit("v").alias("bucket_"))
    joined = skew.join_weighted(rows, table, ["bucket", "salt"], ["id"], "__n")
    assert joined.columns == ["id", "bucket", "salt", "hit", "k_bucket", "bucket_"]
    got = joined.collect()
    assert len(got) == 3_000
    for r in got:
        want = None if r["bucket"] in (None, 7) else 2 * r["bucket"]
        assert r["k_bucket"] == want and r["bucket_"] == (None if want is None else "v")


def test_lookup_in_a_large_table(rows, answers, no_broadcast):
    check(skew.join_lookup(rows, answers.drop("__n"), ["key"], ["id"]))


def test_lookup_in_a_small_table(rows, answers):
    check(skew.join_lookup(rows, answers.drop("__n"), ["key"], ["id"]))


def test_no_partition_gets_a_heavy_key(spark, rows, answers, no_broadcast):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = skew.heaviest(answers, "__n")
        assert 0 < found.where("key = 'hot'").count() <= found.count() < skew.HEAVY_PARTS
        heavy = answers.drop("__n").where("key = 'hot'")
        joined = skew.join_answers(rows, answers.drop("__n"), ["key"], ["id"], heavy)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 30_000
    assert max(sizes) < 2 * 30_000 / len(sizes)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("lookup", [False, True])
def test_heavy_key_without_answer_is_split(spark, rows, no_broadcast, monkeypatch, lookup, large):
    if large:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    counts = skew.key_counts(rows, ["key"]).where("key != 'hot'")
    table = counts.select("key", "__n", F.concat(F.lit("for "), "key").alias("answer"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        if lookup:
            joined = skew.join_lookup(rows, table.drop("__n"), ["key"], ["id"])
        else:
            joined = skew.join_weighted(rows, table, ["key"], ["id"], "__n")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = F.when(F.col("key") != "hot", F.concat(F.lit("for "), "key"))
    assert joined.where(~F.col("answer").eqNullSafe(want)).count() == 0
    assert sum(sizes) == 30_000 and max(sizes) < 2 * 30_000 / len(sizes)


@pytest.mark.parametrize("answered", [False, True])
def test_heavy_key_is_dealt_without_broadcast_of_its_answer(spark, rows, answers, no_broadcast, answered):
    counts = skew.key_counts(rows, ["key"])
    heavy = skew.heavy_parts(counts, "__n")
    parts = {r["key"]: r["__parts"] for r in heavy.collect()}
    assert parts["hot"] == 5000 and sum(parts.values()) <= skew.HEAVY_PARTS + len(parts)
    table = answers if answered else answers.where("key != 'hot'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.join_dealt(rows, table.drop("__n"), ["key"], ["id"], heavy)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert joined.columns == ["id", "key", "answer"]
    missing = ["k7"] if answered else ["k7", "hot"]
    want = F.when(~F.col("key").isin(missing), F.concat(F.lit("for "), "key"))
    assert joined.where(~F.col("answer").eqNullSafe(want)).count() == 0
    assert sum(sizes) == 30_000 and max(sizes) < 2 * 30_000 / len(sizes)


def test_position_over_block_and_span_borders(spark):
    ids = sorted({*range(50), *[(1 << 20) * k + 3 for k in range(1, 30)], *[(1 << 40) * k for k in range(1, 9)], 1 << 41 | 5})
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r.id: r.at for r in position(df, "id", "at").collect()}
    assert got == {i: n for n, i in enumerate(ids)}
