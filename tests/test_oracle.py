"""Every registered query against its independent DuckDB SQL (sf0.001), plus the
driver contract of __spark_entry__."""

import pytest

import __spark_entry__ as E
from citegraph.plans.oracle import ORACLE
from citegraph.plans.queries import QUERIES
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"extract_prose"}  # held against a parser of its own (test_prose.py)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    same, ns, nd, s_only, d_only = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert same, (name, ns, nd, s_only, d_only)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "title", "citations"] and df.count() > 0
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
