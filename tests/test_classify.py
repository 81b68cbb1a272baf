import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillroll import session
from tillroll.operators import classify, features, split
from tillroll.operators.tune import RESULT, best_setting, grid_search, linear_classifier, settings
from tillroll.plans.flow import write_full_report

CODES = ["01.1.1.1.1", "01.1.1.1.2", "01.2.1.1.1", "02.1.1.1.1", "02.1.1.2.1"]
WORDS = ["PAIN", "LAIT", "EAU", "RIZ", "SEL", "VIN", "THE"]


def sample(n, seed):
    rnd = random.Random(seed)
    return [
        (i, " ".join(rnd.choices(WORDS[rnd.randrange(5) :], k=rnd.randint(1, 4))), rnd.choice(CODES)) for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ROW_ID long, label string, code string").repartition(4)


def bayes(train, text):
    """(best child, confidence, margin) of one node; `train` has (text, child) pairs."""
    rows, words = Counter(c for _, c in train), {}
    for t, c in train:
        words.setdefault(c, Counter()).update(t.split())
    known = set().union(*words.values())
    score = {}
    for c, n in rows.items():
        s = math.log(n / len(train))
        for w in text.split():
            if w in known:
                s += math.log((words[c][w] + 1) / (sum(words[c].values()) + len(known)))
        score[c] = round(s, 6)
    ranked = sorted(score, key=lambda c: (-score[c], c))
    odds = [math.exp(score[c] - score[ranked[0]]) for c in ranked] + [0.0]
    total = sum(odds)
    return ranked[0], 1 / total, (1 - odds[1]) / total


@pytest.mark.parametrize("large", [False, True])
def test_flat(spark, request, large):
    if large:
        request.getfixturevalue("no_broadcast")
    train, test = sample(150, 1), sample(40, 2) + [(99, "UNKNOWN WORDS", CODES[0])]
    out = classify.flat_classifier(frame(spark, train), frame(spark, test), "code", "label").collect()
    assert len(out) == len(test)
    for r in out:
        best, confidence, _ = bayes([(t, c) for _, t, c in train], r.label)
        assert r.FLAT_PRED == best
        assert r.CONFIDENCE == pytest.approx(confidence, abs=2e-6)


def test_lcpn(spark):
    train, test = sample(150, 3), sample(60, 4)
    out = classify.lcpn_classifier(frame(spark, train), frame(spark, test), "code", "label").collect()
    first = {}
    for i, t, _ in sorted(test):
        first.setdefault(t, i)
    assert {r.label: r.ROW_ID for r in out} == first
    for r in out:
        path = ""
        for n in (2, 4, 6, 8, 10):
            node = [(t, c[:n]) for _, t, c in train if c.startswith(path)]
            path = bayes(node, r.label)[0]
        assert r.LCPN_PRED == path


def test_lcpn_drops_paths_that_end_early(spark):
    train = frame(spark, [(1, "PAIN", "01.1"), (2, "VIN", "02.1.1.1.1")])
    test = frame(spark, [(1, "PAIN", "01.1"), (2, "VIN", "02.1.1.1.1")])
    out = classify.lcpn_classifier(train, test, "code", "label").collect()
    assert [r.label for r in out] == ["VIN"]


def test_lcpl_and_backoff(spark):
    train, test = sample(150, 5), sample(30, 6)
    out = classify.lcpl_classifier(frame(spark, train), frame(spark, test), "code", "label", 0.3).collect()
    for r in out:
        choice = ""
        for name, n in (("DIVISION", 2), ("GROUPE", 4), ("CLASSE", 6), ("SOUS-CLASSE", 8), ("POSTE", 10)):
            best, _, margin = bayes([(t, c[:n]) for _, t, c in train], r.label)
            assert r[f"{name}_PRED"] == best
            assert r[f"DIFF_PROB_{name}"] == pytest.approx(margin, abs=2e-6)
            if r[f"DIFF_PROB_{name}"] > 0.3:
                choice = best
        assert r.CONFIDENCE_PRED == choice


def test_training_sets(spark):
    df = frame(spark, [(1, "PAIN", "01.1.2.3.4")])
    pairs = {(r.parent, r.child) for r in classify.lcpn_training_sets(df, "code", "label").collect()}
    assert pairs == {("division", "01"), ("01", "1"), ("01.1", "2"), ("01.1.2", "3"), ("01.1.2.3", "4")}
    assert classify.lcpn_model_count(frame(spark, sample(100, 1)), "code").first().models == 2 + 3 + 3 + 4


def test_split_is_stable_and_complete(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    train, test = split.train_test_split(df, "k")
    assert train.count() + test.count() == 5000
    assert 0.17 < test.count() / 5000 < 0.23
    again = split.train_test_split(df.orderBy(F.desc("k")).repartition(3), "k")[1]
    assert {r.k for r in test.collect()} == {r.k for r in again.collect()}


def test_contiguous_folds(spark):
    df = spark.range(103).select((F.col("id") * 7 + 5).alias("ROW_ID"))
    folds = Counter(r.fold for r in split.with_fold(df, 5, method="contiguous").collect())
    assert folds == {1: 21, 2: 21, 3: 21, 4: 20, 5: 20}


def test_settings_use_gamma_only_where_it_exists():
    out = settings([0.5, 1.0], [(1, 1)], [1.0], ["linear", "rbf"], [0.1, 0.2])
    assert len(out) == 2 * (1 + 2)
    assert {s.gamma for s in out if s.kernel == "linear"} == {None}


def learnable(n):
    """The code follows from the first word, which never comes second."""
    return [(i, f"{WORDS[i % 3]} {WORDS[3 + i % 4]}", CODES[i % 3]) for i in range(n)]


def test_linear_classifier(spark):
    train, test = frame(spark, learnable(90)), frame(spark, learnable(30))
    for kernel in ("logistic", "linear"):
        setting = settings([1.0], [(1, 1)], [10.0], [kernel], [])[0]
        out = linear_classifier(train, test, "code", "label", setting, max_iter=5).collect()
        assert len(out) == 30
        assert all(r.FLAT_PRED == r.code for r in out)
        assert (out[0].CONFIDENCE is not None) == (kernel == "logistic")


def test_grid_search_lists_what_fails_last(spark):
    choices = settings([1.0], [(1, 1), (1, 2)], [10.0], ["logistic", "poly"], [0.1])
    results = grid_search(frame(spark, learnable(90)), choices, "code", "label", k=2, max_iter=10)
    rows = results.collect()
    assert [r.kernel for r in rows] == ["logistic", "logistic", "poly", "poly"]
    assert all((r.f1 is None) == (r.kernel == "poly") == (r.reason is not None) for r in rows)
    assert best_setting(results).first().f1 == max(r.f1 for r in rows if r.f1 is not None)


def test_grid_search_lists_what_spark_rejects(spark):
    one_code = spark.createDataFrame([(i, f"PAIN {i}", CODES[0]) for i in range(20)], "ROW_ID long, label string, code string")
    choices = settings([1.0], [(1, 1)], [-1.0], ["logistic"], [])
    (row,) = grid_search(one_code, choices, "code", "label", k=2, max_iter=2).collect()
    assert row.f1 is None and row.reason


def test_best_setting_decides_ties_by_the_choices(spark):
    rows = [(1.0, 1, 2, 1.0, "linear", None, 0.5, None), (1.0, 1, 1, 1.0, "linear", None, 0.5, None), (0.5, 1, 1, 1.0, "linear", None, 0.4, None),
            (0.1, 1, 1, 1.0, "rbf", 0.1, None, "no")]
    results = spark.createDataFrame(rows, RESULT)
    assert tuple(best_setting(results).first()) == rows[1]
    assert best_setting(results.where("false")).count() == 0


@pytest.mark.parametrize("cut", [features.words_and_ngrams, features.words_and_char_ngrams])
def test_ngram_features_tell_word_order_apart(spark, cut):
    train = frame(spark, [(1, "VIN ROUGE", CODES[0]), (2, "ROUGE VIN", CODES[1])])
    test = frame(spark, [(3, "VIN ROUGE", CODES[0]), (4, "ROUGE VIN", CODES[1])])
    out = classify.flat_classifier(train, test, "code", "label", cut=cut).collect()
    assert len(out) == 2 and all(r.FLAT_PRED == r.code for r in out)


def test_character_ngrams_know_parts_of_unseen_words(spark):
    train = frame(spark, [(1, "TOMATE", CODES[0]), (2, "POISSON", CODES[1])])
    test = frame(spark, [(3, "TOMATES", CODES[0]), (4, "POISSONS", CODES[1])])
    out = classify.flat_classifier(train, test, "code", "label", cut=features.words_and_char_ngrams).collect()
    assert all(r.FLAT_PRED == r.code for r in out)


def test_full_report_is_written_and_leaves_nothing_staged(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(shared))
    nomenclature = spark.createDataFrame(
        [("poste", c, f"name of {c}") for c in CODES], "level string, code string, description string"
    )
    rows = [(i, f"{WORDS[i % 5]} {i}", CODES[i % 5]) for i in range(200)]
    write_full_report(frame(spark, rows), nomenclature, str(tmp_path / "out"), "code", "label")
    assert list(shared.iterdir()) == []
    for table in ("predictions", "scores", "accuracy", "flows"):
        assert spark.read.parquet(str(tmp_path / "out" / table)).columns
    scores = {r.kind for r in spark.read.parquet(str(tmp_path / "out" / "scores")).collect()}
    assert scores == {"flat", "hierarchical"}
