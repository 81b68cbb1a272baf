"""Odd documents for every operator, and the given ones as plain rows."""

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, size long"


def given(sf=SF):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def odd_rows(extra=()):
    """Nulls in every column, empty and long texts, repeats, non-ASCII, extra columns with clashing names."""
    texts = [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one",
        "two words",
        "Ünïcödé 漢字 😀 'quoted' text\n\nagain\nagain\n",
        "word " * 30000,
        "\x00\x01 control \x1c characters   and   spaces",
        *extra,
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], None, "x", 7) for i, t in enumerate(texts)]
    rows.append((None, "no identifier here " * 5, None, None, 3, None, None))
    return rows + rows[3:6]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)
