"""Every query against its check SQL on the smallest tables."""

import pytest

from contract.check import compare, connect
from contract.oracle import ORACLE
from contract.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_only_trained_weights_and_stems_have_no_check_sql():
    trained = {"grid_search", "best_setting", "linear_classifier", "linear_tree_classifier", "embedding_classifier", "stem_labels"}
    assert set(QUERIES) - set(ORACLE) == trained
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_result(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]) == ""


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
