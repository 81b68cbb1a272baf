import pytest

from tillroll import session
from tillroll.operators import labels
from tillroll.sources.readers import read_survey


def test_over_long_lines_go_even_if_the_surplus_is_empty(spark, tmp_path):
    lines = ["1,A,111,V1", "2,A,222,V2,", "3,A,333,V3,x", "4,A,444", "5,A,,", '6,"A, B",666,V6', "7,A,777,,", "8"]
    (tmp_path / "survey.csv").write_text("\n".join(lines) + "\n")
    got = read_survey(spark, str(tmp_path / "survey.csv"), ["row_id", "brand", "ean", "label"], header=False)
    assert sorted(map(tuple, got.collect())) == [
        ("1", "A", "111", "V1"), ("4", "A", "444", None), ("5", "A", None, None), ("6", "A, B", "666", "V6"), ("8", None, None, None),
    ]


def test_removed_rows_add_up(spark):
    names = ["INCONNU", "12 500", "SAVON DOUX", "SI", "DE LA", None, "LIVRE"]
    rows = [(i, "9780000000001" if n == "LIVRE" else "3000000000001", n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "ROW_ID long, EAN_FINAL string, DESCRIPTION_EAN string")
    report = {r["step"]: r["rows_removed"] for r in labels.cleaning_report(df).collect()}
    kept = labels.clean_label(df, keep=None).count()
    assert report["edition"] == 1 and sum(report.values()) + kept == len(rows)


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Cluster:
        conf = Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Cluster())
