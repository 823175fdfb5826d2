"""The queries that SQL can express against that SQL on another engine."""

import pytest
from compare import compare, connect

from tableinsight.llm import catalog, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(catalog.queries()[name](spark, SF), con, oracle.oracle_sql()[name]) == []
