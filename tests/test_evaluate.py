import random

import pytest

from tillroll.operators import evaluate, reports

A, B, C = "01.1.1.1.1", "01.1.2.1.1", "02.1.1.1.1"


@pytest.fixture
def three(spark):
    return spark.createDataFrame(
        [(A, A, 10.0), (A, B, 5.0), (B, C, 20.0), (None, A, 7.0)], "TRUE_COICOP string, COICOP_PREDICTED string, CA double"
    )


@pytest.fixture
def names(spark):
    levels = {2: "division", 4: "groupe", 6: "classe", 8: "sous-classe", 10: "poste"}
    codes = sorted({(levels[n], c[:n]) for c in (A, B, C) for n in levels})
    return spark.createDataFrame([(lv, c, f"{c} n.c.a.") for lv, c in codes], "level string, code string, description string")


def test_revenue_weighted(three):
    row = evaluate.revenue_weighted_metrics(three, "TRUE_COICOP", "COICOP_PREDICTED", "CA").first()
    assert tuple(row) == (10.0, 5.0, 25.0, 0.666667, 0.285714, 0.4)


def test_hierarchical(spark):
    df = spark.createDataFrame([(A, B)], "t string, p string")
    assert tuple(evaluate.hierarchical_metrics(df, "t", "p").first()) == (0.4, 0.4, 0.4)


def test_weighted_scores_against_loops(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), rnd.choice("abcd")) for _ in range(200)]
    got = evaluate.classification_metrics(spark.createDataFrame(rows, "t string, p string"), "t", "p").first()
    sums = [0.0, 0.0, 0.0]
    for c in "abc":
        tp = sum(t == p == c for t, p in rows)
        said, real = sum(p == c for _, p in rows), sum(t == c for t, _ in rows)
        precision, recall = tp / said if said else 0, tp / real
        f1 = 2 * precision * recall / (precision + recall) if tp else 0
        sums = [s + v * real / len(rows) for s, v in zip(sums, (precision, recall, f1))]
    assert [got.precision, got.recall, got.f1] == [pytest.approx(s, abs=1e-6) for s in sums]
    # average recall is plain accuracy
    assert got.recall == pytest.approx(sum(t == p for t, p in rows) / len(rows), abs=1e-6)


def test_accuracy_by_level(three):
    got = {r.level: (r.digits, r.row_share, r.revenue_share) for r in
           evaluate.accuracy_by_level(three, "TRUE_COICOP", "COICOP_PREDICTED", "CA").collect()}
    assert got["poste"] == (6, 0.333333, round(10 / 35, 6))
    assert got["division"] == (2, 0.666667, round(15 / 35, 6))
    assert got["division"][1] >= got["poste"][1]
    plain = evaluate.accuracy_by_level(three, "TRUE_COICOP", "COICOP_PREDICTED")
    assert "revenue_share" not in plain.columns


def test_accuracy_table(three, names):
    rows = reports.accuracy_table(three, names).collect()
    poste = [r for r in rows if r.CATEGORY == "Poste"]
    assert [tuple(r) for r in poste] == [(A, 1, 2, 0.5, A, "Poste")]


def test_confusion_matrix(three, names):
    rows = reports.confusion_matrix(three, names).collect()
    assert [(r.true, r.pred) for r in rows] == [(t, p) for t in (A, B) for p in (A, B, C)]
    assert sum(r.nb for r in rows) == 3 and sum(r.nb == 0 for r in rows) == 3
    assert rows[0].desc_groupe == "01.1"


def test_confusion_pairs(three, names):
    rows = reports.confusion_pairs(three, names).collect()
    assert [(r.true, r.pred, r.nb, r.share) for r in rows] == [(A, A, 1.0, 0.5), (A, B, 1.0, 0.5), (B, C, 1.0, 1.0)]
    with pytest.raises(ValueError):
        reports.confusion_matrix(three, names, most_cells=5)


def test_sankey(three, names):
    table = reports.sankey_table(three, names.where("code != '02.1.1.1.1'"))
    flows = {(r.source, r.target): r.value for r in reports.sankey_flows(table).collect()}
    assert flows == {(A, f"{A} "): 1, (A, f"{B} "): 1, (B, "Non suivi"): 1}
    assert [r.CATEGORY for r in table.collect()][0] == "Poste"


def test_missing_prediction_counts_against_recall(spark):
    df = spark.createDataFrame([("01.1.1.1.1", "01.1.1.1.1"), ("02.1.1.1.1", None)], "t string, p string")
    got = evaluate.hierarchical_metrics(df, "t", "p").first()
    assert (got["precision"], got["recall"]) == (1.0, 0.5)
