"""The two batch jobs: clean and label receipts; train, predict and report."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.classify import lcpn_classifier
from tillroll.operators.ean import clean_ean
from tillroll.operators.evaluate import classification_metrics, hierarchical_metrics
from tillroll.operators.labelling import label_receipts
from tillroll.operators.labels import clean_label
from tillroll.operators.reports import accuracy_table, sankey_table
from tillroll.operators.split import train_test_split
from tillroll.session import stage, staging
from tillroll.sources.writers import write_report


@dataclass(frozen=True)
class ReferenceTables:
    """Tables as the readers of `tillroll.sources` return them."""

    ean_family: DataFrame
    family_code: DataFrame
    survey: DataFrame
    variety_code: DataFrame
    nomenclature: DataFrame
    dictionary: DataFrame | None = None


def clean_and_label(receipts: DataFrame, tables: ReferenceTables, order_col: str = "ROW_ID") -> DataFrame:
    """Raw receipts to labelled receipts.

    Each phase reads its input twice, so the phases are written out between
    one another: the work stays linear, and a lost executor costs one phase at
    most.
    """
    rows = stage(clean_ean(receipts, order_col=order_col), "clean-ean")
    rows = stage(clean_label(rows, tables.dictionary, order_col=order_col), "clean-label")
    return label_receipts(
        rows,
        tables.ean_family,
        tables.family_code,
        tables.survey,
        tables.variety_code,
        tables.nomenclature,
        order_col=order_col,
    )


@dataclass(frozen=True)
class Report:
    """Predictions of the held-out descriptions and the tables made of them."""

    predictions: DataFrame
    scores: DataFrame
    accuracy: DataFrame
    flows: DataFrame


def full_report(
    labelled: DataFrame,
    nomenclature: DataFrame,
    code: str = "TRUE_COICOP",
    label: str = "DESCRIPTION_EAN_FINAL",
    key: str = "ROW_ID",
) -> Report:
    """Hold out a fifth of the rows, predict them top-down, score them and tabulate accuracy and flows.

    The predictions are made once and written out; all tables read them.
    """
    train, test = train_test_split(labelled.where(F.col(code).isNotNull()), key)
    said = stage(lcpn_classifier(train, test, code, label, key), "predictions")
    scores = [
        measure(said, code, "LCPN_PRED").select(F.lit(kind).alias("kind"), "precision", "recall", "f1")
        for kind, measure in (("flat", classification_metrics), ("hierarchical", hierarchical_metrics))
    ]
    return Report(
        said,
        scores[0].unionByName(scores[1]),
        accuracy_table(said, nomenclature, code, "LCPN_PRED"),
        sankey_table(said, nomenclature, code, "LCPN_PRED"),
    )


def write_full_report(
    labelled: DataFrame,
    nomenclature: DataFrame,
    path: str,
    code: str = "TRUE_COICOP",
    label: str = "DESCRIPTION_EAN_FINAL",
    key: str = "ROW_ID",
) -> None:
    """The tables of `full_report` as `predictions`, `scores`, `accuracy` and `flows` under `path`.

    Intermediate tables are deleted.
    """
    with staging(labelled.sparkSession):
        report = full_report(labelled, nomenclature, code, label, key)
        for table in fields(report):
            write_report(getattr(report, table.name), f"{path}/{table.name}")


def predict_and_report(
    labelled: DataFrame,
    nomenclature: DataFrame,
    code: str = "TRUE_COICOP",
    label: str = "DESCRIPTION_EAN_FINAL",
    key: str = "ROW_ID",
) -> DataFrame:
    """The accuracy per code and level of `full_report`."""
    return full_report(labelled, nomenclature, code, label, key).accuracy
