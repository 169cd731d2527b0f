"""Every query of the core library against its SQL on another engine; corpus operators have tests of their own."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck
from docproof.plans.catalog import QUERIES
from oracle.sql import ORACLE

SQL = ORACLE


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf_dir, name):
    assert difference(spark, con, name, QUERIES[name], SQL[name], sf_dir) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "status", "flagged", "error", "rules"]
