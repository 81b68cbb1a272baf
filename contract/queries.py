"""One query per operator over the derived views."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contract.views import view
from tillroll.functions import codes, ean as fe, text as ft
from tillroll.functions.rules import apply_rules
from tillroll.functions.stopwords import FRENCH
from tillroll.operators import (
    classify,
    ean,
    embed,
    evaluate,
    features,
    hierarchy,
    labelling,
    labels,
    linear,
    lookup,
    reports,
    split,
    stats,
    store,
    tune,
)
from tillroll.plans import flow
from tillroll.session import shared_dir
from tillroll.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def upper(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return readers.upper_names(view(spark, sf, name))


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, name: str, sep: str = ",") -> str:
    path = _path(df.sparkSession, name)
    df.write.csv(
        path, header=True, sep=sep, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


# sources and sinks


@query
def read_receipts(spark, sf):
    path = _csv(view(spark, sf, "receipts"), "receipts")
    key = T.StructType([T.StructField("row_id", T.LongType())])
    return readers.read_receipts(spark, path, extra=key)


@query
def read_labelled(spark, sf):
    path = _path(spark, "labelled")
    view(spark, sf, "coded").write.parquet(path)
    return readers.read_labelled(spark, path, "true_coicop")


@query
def nomenclature(spark, sf):
    return readers.nomenclature(view(spark, sf, "nomenclature_rows"))


@query
def ean_family_table(spark, sf):
    raw = readers.read_strings(spark, _csv(view(spark, sf, "ean_family_rows"), "ean_family"))
    return readers.ean_family_table(raw.withColumn("row_id", F.col("row_id").cast("long")))


@query
def family_code_table(spark, sf):
    raw = readers.read_strings(spark, _csv(view(spark, sf, "family_code_rows"), "family_code", ";"), sep=";")
    return readers.family_code_table(raw.withColumn("row_id", F.col("row_id").cast("long")))


@query
def field_survey_table(spark, sf):
    rows = view(spark, sf, "field_survey_rows")
    # every 50th line has one field too many and has to be skipped
    surplus = F.when(F.col("row_id") % 100 == 0, F.lit("surplus")).when(F.col("row_id") % 50 == 0, F.lit(""))
    line = F.concat_ws(",", *rows.columns, surplus)
    path = _path(spark, "survey")
    rows.select(line).write.text(path)
    raw = readers.read_survey(spark, path, rows.columns, header=False)
    return readers.field_survey_table(raw.withColumn("row_id", F.col("row_id").cast("long")), "BRAND_A")


@query
def variety_code_table(spark, sf):
    raw = readers.read_strings(spark, _csv(view(spark, sf, "variety_code_rows"), "variety_code"))
    return readers.variety_code_table(raw.withColumn("row_id", F.col("row_id").cast("long")))


@query
def write_report(spark, sf):
    path = _path(spark, "accuracy")
    writers.write_report(accuracy_table(spark, sf), path)
    return spark.read.parquet(path)


@query
def labelled_lines(spark, sf):
    rows = view(spark, sf, "coded")
    line = writers.labelled_line(F.col("true_coicop"), F.col("description_ean_final"))
    return rows.select("row_id", line.alias("line"))


@query
def parse_labelled_lines(spark, sf):
    path = _path(spark, "lines")
    writers.write_labelled_lines(view(spark, sf, "coded"), "true_coicop", "description_ean_final", path)
    return readers.parse_labelled_lines(spark.read.text(path))


@query
def strip_label_prefix(spark, sf):
    rows = view(spark, sf, "predictions")
    raw = F.concat(F.lit(writers.LABEL_PREFIX), "coicop_predicted")
    return rows.select("row_id", writers.strip_label_prefix(raw).alias("pred"))


# barcodes


@query
def trim_ean(spark, sf):
    return view(spark, sf, "receipts").select("row_id", fe.trim_ean(F.col("ean")).alias("ean"))


@query
def normalise_ean(spark, sf):
    return ean.normalise(upper(spark, sf, "receipts")).select("ROW_ID", "EAN", "EAN_CLEAN")


@query
def split_valid_ean(spark, sf):
    rows = ean.normalise(upper(spark, sf, "receipts")).select("ROW_ID", "EAN_CLEAN")
    valid, rejected = ean.split_valid(rows, "EAN_CLEAN")
    return valid.withColumn("EAN_REMOVE", F.lit(False)).unionByName(rejected)


@query
def reconstruct_ean(spark, sf):
    rows = ean.reconstruct(ean.normalise(upper(spark, sf, "receipts")))
    return rows.select("ROW_ID", "EAN_CLEAN", "EAN_RECONSTRUCTED")


@query
def reconstruct_ean_lcs(spark, sf):
    rows = ean.reconstruct(ean.normalise(upper(spark, sf, "receipts")), mode="lcs")
    return rows.select("ROW_ID", "EAN_CLEAN", "EAN_RECONSTRUCTED")


@query
def clean_ean(spark, sf):
    return ean.clean_ean(upper(spark, sf, "receipts"))


# descriptions


def _label(spark, sf, expr) -> DataFrame:
    rows = view(spark, sf, "raw_labels")
    return rows.select("row_id", expr(F.upper("label")).alias("label"))


@query
def drop_editions(spark, sf):
    return labels.drop_editions(view(spark, sf, "raw_labels"), "ean")


@query
def upper_label(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.upper("text").alias("text"))


@query
def apply_label_rules(spark, sf):
    return _label(spark, sf, apply_rules)


@query
def apply_label_rules_sequential(spark, sf):
    return _label(spark, sf, lambda c: apply_rules(c, mask="none"))


@query
def collapse_spaces(spark, sf):
    padded = F.replace("text", F.lit(" e"), F.lit("   e"))
    return view(spark, sf, "documents").select("doc_id", ft.collapse_spaces(padded).alias("text"))


@query
def remove_stopwords(spark, sf):
    return _label(spark, sf, lambda c: ft.drop_words(c, FRENCH))


@query
def fold_ascii(spark, sf):
    return view(spark, sf, "documents").select("doc_id", ft.fold_ascii(F.col("text")).alias("text"))


@query
def strip_digits(spark, sf):
    return view(spark, sf, "documents").select("doc_id", ft.strip_digits(F.col("text")).alias("text"))


@query
def drop_short_words(spark, sf):
    return _label(spark, sf, ft.drop_short_words)


@query
def normalise_tokens(spark, sf):
    rows = _label(spark, sf, lambda c: c)
    return labels.normalise_tokens(rows, view(spark, sf, "tokens_base"), "label", "row_id")


@query
def drop_short_labels(spark, sf):
    return labels.drop_short_labels(view(spark, sf, "raw_labels"), "label")


@query
def drop_similar_labels(spark, sf):
    return labels.drop_similar_labels(view(spark, sf, "raw_labels"), 75, "label", "ean", "row_id")


@query
def clean_label(spark, sf):
    rows = view(spark, sf, "raw_labels").toDF("ROW_ID", "EAN_FINAL", "DESCRIPTION_EAN")
    return labels.clean_label(rows, view(spark, sf, "tokens_base"))


@query
def keep_columns(spark, sf):
    return ean.keep_columns(upper(spark, sf, "receipts"), ["CA", "EAN", "DESCRIPTION_EAN", "ABSENT"])


# labelling


@query
def lookup_(spark, sf):
    rows = upper(spark, sf, "cleaned").select("ROW_ID", "EAN_FINAL")
    return lookup.lookup(rows, "EAN_FINAL", view(spark, sf, "ean_family"), "ean", "id_famille", "FAMILY")


@query
def fill_family_from_ean(spark, sf):
    return labelling.fill_family_from_ean(upper(spark, sf, "cleaned"), view(spark, sf, "ean_family"))


@query
def propagate_family_by_label(spark, sf):
    return labelling.propagate_family_by_label(upper(spark, sf, "cleaned"))


@query
def format_code(spark, sf):
    family = view(spark, sf, "family_code_rows").select(
        "row_id", codes.format_code(F.col("code_coicop_poste")).alias("family_code")
    )
    survey = view(spark, sf, "variety_code_rows").select(
        "row_id", codes.format_code(F.col("idposte"), decimal_tail=True).alias("survey_code")
    )
    return family.join(survey, "row_id")


def _family_code(spark, sf) -> DataFrame:
    return view(spark, sf, "family_code").select(
        "id_famille", codes.format_code(F.col("code_coicop_poste")).alias("code")
    )


@query
def code_from_family(spark, sf):
    return labelling.code_from_family(
        upper(spark, sf, "cleaned"), _family_code(spark, sf), view(spark, sf, "label_nomen")
    )


@query
def describe_code(spark, sf):
    rows = view(spark, sf, "predictions").select("row_id", "coicop_predicted")
    return lookup.describe_code(rows, "coicop_predicted", "description", view(spark, sf, "nomen"), order_col="row_id")


def _survey(spark, sf) -> tuple[DataFrame, DataFrame]:
    survey = readers.field_survey_table(view(spark, sf, "field_survey"), "BRAND_A")
    variety = readers.variety_code_table(view(spark, sf, "variety_code").withColumn("row_id", F.lit(0)))
    return survey, variety


@query
def code_from_field_survey(spark, sf):
    return labelling.code_from_field_survey(
        upper(spark, sf, "cleaned"), *_survey(spark, sf), view(spark, sf, "label_nomen")
    )


def _labelled(spark, sf) -> DataFrame:
    return labelling.label_with_helpers(
        upper(spark, sf, "cleaned"),
        view(spark, sf, "ean_family"),
        _family_code(spark, sf),
        *_survey(spark, sf),
        view(spark, sf, "label_nomen"),
    )


def _both_codes(spark, sf) -> DataFrame:
    rows = labelling.code_from_family(
        upper(spark, sf, "cleaned"), _family_code(spark, sf), view(spark, sf, "label_nomen")
    )
    return labelling.code_from_field_survey(rows, *_survey(spark, sf), view(spark, sf, "label_nomen"))


@query
def flag_code_conflicts(spark, sf):
    return labelling.flag_code_conflicts(_both_codes(spark, sf)).select(
        "ROW_ID", "TRUE_COICOP", "TRUE_COICOP_CONFLICT", "DESC_COICOP_TRUE_CONFLICT"
    )


@query
def fill_code_from_survey(spark, sf):
    return labelling.fill_code_from_survey(_both_codes(spark, sf)).select(
        "ROW_ID", "TRUE_COICOP", "DESC_COICOP_TRUE"
    )


@query
def labelling_report(spark, sf):
    return labelling.labelling_report(upper(spark, sf, "cleaned"), _labelled(spark, sf))


@query
def unmatched_varieties(spark, sf):
    return labelling.unmatched_varieties(_labelled(spark, sf))


@query
def label_receipts(spark, sf):
    return _labelled(spark, sf).drop(*labelling.HELPERS)


# statistics


@query
def ean_occurrence_histogram(spark, sf):
    return stats.occurrence_histogram(view(spark, sf, "cleaned"), "ean_final")


@query
def label_occurrence_histogram(spark, sf):
    return stats.occurrence_histogram(view(spark, sf, "cleaned"), "description_ean_final")


@query
def labels_per_ean_histogram(spark, sf):
    return stats.distinct_histogram(view(spark, sf, "cleaned"), "ean_final", "description_ean_final")


@query
def eans_per_label_histogram(spark, sf):
    return stats.distinct_histogram(view(spark, sf, "cleaned"), "description_ean_final", "ean_final")


@query
def receipt_summary(spark, sf):
    return stats.receipt_summary(upper(spark, sf, "coded"))


@query
def cleaning_report(spark, sf):
    rows = view(spark, sf, "raw_labels").toDF("ROW_ID", "EAN_FINAL", "DESCRIPTION_EAN")
    return labels.cleaning_report(rows, view(spark, sf, "tokens_base"))


@query
def stem_labels(spark, sf):
    """French stems of every word."""
    return labels.stem_labels(view(spark, sf, "raw_labels"), "label", "row_id")


# hierarchy


@query
def truncate_code(spark, sf):
    rows = view(spark, sf, "predictions")
    cut = [codes.truncate_code(F.col("true_coicop"), k).alias(f"cut_{k}") for k in range(6)]
    return rows.select("row_id", *cut)


@query
def hierarchy_columns(spark, sf):
    return hierarchy.hierarchy_columns(upper(spark, sf, "coded"))


@query
def code_level_name(spark, sf):
    rows = view(spark, sf, "nomenclature")
    shorter = F.substring("code", F.lit(1), F.length("code") - 1)
    return rows.select(
        "code",
        codes.level_name(F.col("code")).alias("level_name"),
        codes.level_name(shorter).alias("shorter_name"),
    )


@query
def explode_levels(spark, sf):
    rows = view(spark, sf, "predictions").select("row_id", "true_coicop", "coicop_predicted")
    return hierarchy.explode_levels(rows, "true_coicop", "coicop_predicted")


# classification


def _split(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf, "predictions").select("row_id", "label", "ca", "true_coicop")
    return split.train_test_split(rows, "row_id")


@query
def train_test_split(spark, sf):
    train, test = _split(spark, sf)
    part = F.lit("train").alias("part")
    return train.select("row_id", part).unionByName(test.select("row_id", F.lit("test").alias("part")))


@query
def predict_distinct(spark, sf):
    train, test = _split(spark, sf)
    model = classify.fit_flat(train, "true_coicop", "label")
    return classify.predict_distinct(test, model, view(spark, sf, "nomen"), "label", order_col="row_id")


@query
def text_features(spark, sf):
    return features.text_features(view(spark, sf, "raw_labels"), "label")


@query
def tfidf_features(spark, sf):
    return features.tfidf_features(view(spark, sf, "raw_labels"), "label", max_df=0.2)


@query
def flat_classifier(spark, sf):
    return classify.flat_classifier(*_split(spark, sf), "true_coicop", "label", "row_id")


@query
def kept_model(spark, sf):
    """The model is kept in a folder and loaded again before it predicts."""
    train, test = _split(spark, sf)
    path = _path(spark, "model")
    store.save_model(classify.fit_flat(train, "true_coicop", "label"), path, buckets=8)
    return classify.predict_flat(test, store.load_model(spark, path), "label", "row_id")


def _unseen(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Split on the label, so that no test label occurs in training."""
    return split.train_test_split(view(spark, sf, "coded_labels"), "label")


@query
def flat_classifier_unseen_labels(spark, sf):
    return classify.flat_classifier(*_unseen(spark, sf), "true_coicop", "label", "row_id")


@query
def embedding_classifier(spark, sf):
    return embed.embedding_classifier(*_unseen(spark, sf), "true_coicop", "label", "row_id")


@query
def flat_classifier_ngrams(spark, sf):
    """Runs of up to three words, and three to six characters of a word, as features."""
    return classify.flat_classifier(
        *_split(spark, sf), "true_coicop", "label", "row_id", features.words_and_char_ngrams
    )


@query
def flat_classifier_documents(spark, sf):
    """Language of a text from its words, whole texts."""
    rows = view(spark, sf, "documents").select("doc_id", "text", "lang")
    train, test = split.train_test_split(rows, "doc_id")
    return classify.flat_classifier(train, test, "lang", "text", "doc_id").select(
        "doc_id", "lang", "FLAT_PRED", "CONFIDENCE"
    )


@query
def linear_classifier(spark, sf):
    """Weights per term for all codes, labels as receipts print them."""
    rows = view(spark, sf, "coded_labels")
    train, test = split.train_test_split(rows, "row_id")
    return linear.linear_classifier(train, test, "true_coicop", "label", "row_id")


@query
def linear_tree_classifier(spark, sf):
    """Weights per term under every node of the code tree."""
    rows = view(spark, sf, "coded_labels")
    train, test = split.train_test_split(rows, "row_id")
    return linear.linear_tree_classifier(train, test, "true_coicop", "label", "row_id")


@query
def lcpn_training_sets(spark, sf):
    return classify.lcpn_training_sets(view(spark, sf, "predictions"), "true_coicop", "label")


@query
def lcpn_model_count(spark, sf):
    return classify.lcpn_model_count(view(spark, sf, "predictions"), "true_coicop")


@query
def lcpn_classifier(spark, sf):
    return classify.lcpn_classifier(*_split(spark, sf), "true_coicop", "label", "row_id")


@query
def lcpl_classifier(spark, sf):
    return classify.lcpl_classifier(*_split(spark, sf), "true_coicop", "label", 0.5, "row_id")


@query
def backoff_prediction(spark, sf):
    """Margins that grow with the row key, so that each level is the answer of some rows."""
    rows = view(spark, sf, "predictions")
    columns = []
    for step, name in enumerate(codes.LEVELS):
        columns.append(codes.truncate_code(F.col("coicop_predicted"), step).alias(f"{name.upper()}_PRED"))
        margin = (F.col("row_id") * (step + 3)) % 10 / F.lit(10.0)
        columns.append(margin.alias(f"DIFF_PROB_{name.upper()}"))
    return rows.select("row_id", *columns).select(
        "row_id", classify.backoff_prediction(0.65).alias("CONFIDENCE_PRED")
    )


@query
def repeated_holdout(spark, sf):
    rows = view(spark, sf, "predictions")
    return classify.repeated_holdout(rows, "true_coicop", "label", "row_id")


@query
def repeated_holdout_lcpn(spark, sf):
    rows = view(spark, sf, "predictions")
    return classify.repeated_holdout(rows, "true_coicop", "label", "row_id", model="lcpn")


@query
def kfold_scores_lcpn(spark, sf):
    return classify.kfold_scores(view(spark, sf, "predictions"), "true_coicop", "label", 5, "row_id", model="lcpn")


@query
def kfold_scores(spark, sf):
    return classify.kfold_scores(view(spark, sf, "predictions"), "true_coicop", "label", 5, "row_id")


@query
def kfold_scores_contiguous(spark, sf):
    rows = view(spark, sf, "predictions")
    return classify.kfold_scores(rows, "true_coicop", "label", 5, "row_id", "contiguous")


def _grid(spark, sf) -> DataFrame:
    choices = tune.settings(
        max_dfs=[0.1, 1.0], ngram_ranges=[(1, 1), (1, 2)], cs=[1.0], kernels=["linear", "rbf", "sigmoid"], gammas=[0.5]
    )
    return tune.grid_search(view(spark, sf, "predictions"), choices, "true_coicop", "label", key="row_id")


@query
def grid_search(spark, sf):
    return _grid(spark, sf)


@query
def best_setting(spark, sf):
    """The best setting of the grid, written and read again."""
    path = _path(spark, "best")
    writers.write_setting(tune.best_setting(_grid(spark, sf)), path)
    return spark.read.text(path)


# evaluation

TRUE, PRED = "true_coicop", "coicop_predicted"


@query
def classification_metrics(spark, sf):
    return evaluate.classification_metrics(view(spark, sf, "predictions"), TRUE, PRED)


@query
def revenue_weighted_metrics(spark, sf):
    return evaluate.revenue_weighted_metrics(view(spark, sf, "predictions"), TRUE, PRED, "ca")


@query
def accuracy_by_level(spark, sf):
    return evaluate.accuracy_by_level(view(spark, sf, "predictions"), TRUE, PRED, "ca")


@query
def hierarchical_metrics(spark, sf):
    return evaluate.hierarchical_metrics(view(spark, sf, "predictions"), TRUE, PRED)


@query
def flat_metrics(spark, sf):
    return evaluate.flat_metrics(view(spark, sf, "predictions"), TRUE, PRED)


# reports


def _named(spark, sf) -> DataFrame:
    return upper(spark, sf, "predictions")


@query
def accuracy_table(spark, sf):
    return reports.accuracy_table(_named(spark, sf), view(spark, sf, "nomen"))


@query
def sankey_table(spark, sf):
    return reports.sankey_table(_named(spark, sf), view(spark, sf, "nomen"))


@query
def confusion_matrix(spark, sf):
    return reports.confusion_matrix(_named(spark, sf), view(spark, sf, "nomen"))


@query
def confusion_pairs(spark, sf):
    return reports.confusion_pairs(_named(spark, sf), view(spark, sf, "nomen"))


@query
def overall_accuracy(spark, sf):
    return reports.overall_accuracy(accuracy_table(spark, sf))


@query
def top_codes(spark, sf):
    return reports.top_codes(accuracy_table(spark, sf), "Poste", 10, "size")


@query
def top_codes_by_rate(spark, sf):
    return reports.top_codes(accuracy_table(spark, sf), "Sous-classe", 20, "rate", ascending=True)


@query
def sankey_flows(spark, sf):
    return reports.sankey_flows(sankey_table(spark, sf), "Poste")


@query
def sankey_sources(spark, sf):
    return reports.sankey_sources(sankey_flows(spark, sf))


@query
def flows_of(spark, sf):
    return reports.flows_of(sankey_flows(spark, sf), reports.NOT_TRACKED)


@query
def column_range(spark, sf):
    return reports.column_range(accuracy_table(spark, sf), "Classe")


# whole jobs


@query
def clean_and_label(spark, sf):
    survey, variety = _survey(spark, sf)
    tables = flow.ReferenceTables(
        view(spark, sf, "ean_family"),
        _family_code(spark, sf),
        survey,
        variety,
        view(spark, sf, "label_nomen"),
        view(spark, sf, "tokens_base"),
    )
    return flow.clean_and_label(upper(spark, sf, "receipts"), tables)


@query
def predict_and_report(spark, sf):
    rows = view(spark, sf, "predictions").select("row_id", "label", "true_coicop")
    return flow.predict_and_report(rows, view(spark, sf, "nomen"), "true_coicop", "label", "row_id")


@query
def report_scores(spark, sf):
    rows = view(spark, sf, "predictions").select("row_id", "label", "true_coicop")
    return flow.full_report(rows, view(spark, sf, "nomen"), "true_coicop", "label", "row_id").scores


@query
def report_flows(spark, sf):
    rows = view(spark, sf, "predictions").select("row_id", "label", "true_coicop")
    return flow.full_report(rows, view(spark, sf, "nomen"), "true_coicop", "label", "row_id").flows
