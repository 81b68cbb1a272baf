from pyspark.sql import functions as F

from tillroll.functions import codes
from tillroll.operators import labelling, stats


def test_format_and_truncate(spark):
    df = spark.createDataFrame([("011111", "11120.0"), ("11111", "111207.0")], "a string, b string")
    out = df.select(
        codes.format_code(F.col("a")).alias("a"), codes.format_code(F.col("b"), decimal_tail=True).alias("b")
    ).collect()
    assert [tuple(r) for r in out] == [("01.1.1.1.1", "01.1.1.2.0"), ("01.1.1.1.1", "11.1.2.0.7")]
    code = F.lit("01.1.2.3.4")
    cuts = spark.range(1).select(*[codes.truncate_code(code, k).alias(f"c{k}") for k in range(6)]).first()
    assert list(cuts) == ["01.1.2.3.4", "01.1.2.3", "01.1.2", "01.1", "01", ""]


def families(spark, values):
    df = spark.createDataFrame(
        [(i, lab, f) for i, (lab, f) in enumerate(values)],
        "ROW_ID long, DESCRIPTION_EAN_FINAL string, ID_FAMILLE string",
    )
    return {r.ROW_ID: r.ID_FAMILLE for r in labelling.propagate_family_by_label(df).collect()}


def test_propagation(spark):
    got = families(
        spark,
        [("A", "F1"), ("A", None), ("A", None), ("B", "F1"), ("B", "F2"), ("B", None), ("C", None), (None, "F1")],
    )
    assert got == {0: "F1", 1: "F1", 2: "F1", 3: "F1", 4: "F2", 5: None, 6: None}


def labelled(spark):
    rows = spark.createDataFrame(
        [(1, "e1", "L1", "F1"), (2, "e2", "L2", None), (3, "e3", "L3", None), (4, "e4", "L4", "F2"), (5, None, "L5", "F1"),
         (6, "e5", "L6", "F9"), (7, "e6", "L7", None)],
        "ROW_ID long, EAN_FINAL string, DESCRIPTION_EAN_FINAL string, ID_FAMILLE string",
    )
    table = spark.createDataFrame
    out = labelling.label_with_helpers(
        rows,
        table([("e2", "F2"), ("e1", "F2")], "ean string, id_famille string"),
        table([("F1", "01.1.1.1.1"), ("F2", "99.9.9.9.9"), ("F3", "nan")], "id_famille string, code string"),
        table([("e1", "V1"), ("e3", "V1"), ("e4", "V2"), ("e5", "V1"), ("e6", "V3")], "EAN_FINAL string, LABEL_VARIETE string"),
        table([("V1", "02.2.2.2.2"), ("V2", "99.9.9.9.9")], "LABEL_VARIETE string, COICOP_FIELD string"),
        table([("poste", "02.2.2.2.2", "Two n.c.a.")], "level string, code string, description string"),
    )
    return rows, out


def test_labelling_steps(spark):
    _, out = labelled(spark)
    got = {r.ROW_ID: (r.TRUE_COICOP, r.DESC_COICOP_TRUE, r.TRUE_COICOP_CONFLICT) for r in out.collect()}
    assert got == {
        1: ("01.1.1.1.1", "Two", "02.2.2.2.2"),
        2: ("99.9.9.9.9", None, None),
        3: ("02.2.2.2.2", "Two", None),
        4: ("99.9.9.9.9", None, None),
        6: ("02.2.2.2.2", "Two", None),
        7: (None, None, None),
    }


def test_labelling_report(spark):
    rows, out = labelled(spark)
    report = labelling.labelling_report(rows, out).first().asDict()
    assert report == {
        "rows": 6, "families_before": 4, "families_after": 4, "families_added": 0, "labels_from_family": 3,
        "family_rate": 0.75, "out_of_scope": 2, "field_new": 1, "field_equal": 2, "field_conflict": 1,
        "field_rate": 0.8, "labelled_share": round(5 / 6, 6),
    }
    assert [r[0] for r in labelling.unmatched_varieties(out).collect()] == ["V3"]


def test_report_over_nothing(spark):
    rows, out = labelled(spark)
    report = labelling.labelling_report(rows.limit(0), out.limit(0)).first()
    assert report.family_rate is None and report.field_rate is None and report.rows == 0


def test_histogram_counts_all_buckets_and_null(spark):
    values = [("a", 1)] * 12 + [("b", 1), ("b", None), ("c", None), (None, 5)]
    df = spark.createDataFrame(values, "g string, v long")
    sizes = {r.bucket: (r.n, r.share) for r in stats.occurrence_histogram(df, "g").collect()}
    assert sizes == {"10+": (1, 0.333333), "2": (1, 0.333333), "1": (1, 0.333333)}
    distinct = {r.bucket: r.n for r in stats.distinct_histogram(df, "g", "v").collect()}
    assert distinct == {"1": 2, "2": 1}
