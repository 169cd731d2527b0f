"""Every query of the corpus operators that has SQL against this SQL on another engine."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck
from docproof.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ORACLE)
def test_query(spark, sf_dir, name):
    assert difference(spark, duck(sf_dir), name, QUERIES[name], ORACLE[name], sf_dir) is None


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
