"""Queries with check SQL against DuckDB on the given tables."""

import duckdb
import pytest

from contract.check import compare
from tests.llm import cases
from tillroll.llm.oracle import ORACLE
from tillroll.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{cases.SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_result(spark, con, name):
    assert compare(QUERIES[name](spark, cases.SF), con, ORACLE[name]) == ""
