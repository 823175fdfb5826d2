"""Every catalog query against the same query in plain SQL on another engine."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from tableinsight.plans import catalog, oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


def test_every_query_but_the_stream_has_sql():
    assert set(QUERIES) - set(SQL) == {"stream_gate"}
    assert not set(SQL) - set(QUERIES)


def test_stream_gate_sees_every_table(spark):
    files = QUERIES["stream_gate"](spark, SF_DIR).collect()
    assert len(files) == 14
    assert sum(f.reason == "pas_assez_de_donnees" for f in files) == 2


def test_entry(spark):
    assert entry.entry(spark).columns == ["week", "value"]
