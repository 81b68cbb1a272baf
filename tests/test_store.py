"""A kept model gives the same predictions, and its words are not shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_classify import frame, sample
from tillroll.operators import bayes, classify, store


@pytest.fixture
def model(spark):
    docs = bayes.count_docs(frame(spark, sample(300, 3)), "code", "label")
    return bayes.fit(docs, classify.tree_edges)


def answers(items, model):
    rows = bayes.predict(classify.at_root(items), model)
    return sorted(tuple(r) for r in rows.select("id", "pred", "score", "confidence").collect())


def test_another_session_predicts_the_same(spark, model, tmp_path):
    path = str(tmp_path / "model")
    store.save_model(model, path, buckets=4)
    other = spark.newSession()
    kept = store.load_model(other, path)
    rows = [tuple(r) for r in frame(spark, sample(80, 4)).collect()]
    items = classify.distinct_labels(frame(spark, sample(80, 4)), "label")
    again = classify.distinct_labels(other.createDataFrame(rows, "ROW_ID long, label string, code string"), "label")
    assert answers(items, model) == answers(again, kept) != []
    assert kept.by == () and kept.cut is model.cut


def test_words_of_a_kept_model_are_not_shuffled(spark, model, tmp_path, no_broadcast):
    path = str(tmp_path / "model")
    store.save_model(model, path, buckets=8)
    kept = store.load_model(spark, path)
    asked = kept.tokens.select("parent", "token").distinct().repartition(3).withColumn("x", F.rand())
    joined = asked.join(kept.tokens, ["parent", "token"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.rindex("FileScan parquet") - 400 :]
    assert "SelectedBucketsCount: 8 out of 8" in plan
    # one side of the join, the model's, comes straight from its files
    below = re.split(r"SortMergeJoin|ShuffledHashJoin", plan)[1]
    scans = [part for part in below.split(":- ") if "FileScan" in part]
    assert scans and "Exchange" not in side.split("FileScan")[0].rsplit("+- ", 2)[-1]
    assert joined.count() == kept.tokens.count()


def test_only_named_features_are_kept(model, tmp_path):
    odd = bayes.Model(model.nodes, model.tokens, (), lambda c: F.split(c, "x"))
    with pytest.raises(ValueError):
        store.save_model(odd, str(tmp_path / "odd"))


def test_a_folder_without_a_model(spark, tmp_path):
    spark.createDataFrame([('{"version": 0}',)], "value string").write.text(str(tmp_path / "bad" / "manifest"))
    with pytest.raises(ValueError):
        store.load_model(spark, str(tmp_path / "bad"))
