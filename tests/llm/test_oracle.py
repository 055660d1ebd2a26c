"""The registered queries that SQL expresses, against DuckDB."""

import pytest

from citegraph.llm.oracle import ORACLE
from citegraph.llm.queries import QUERIES
from tools.check import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    same, ns, nd, s_only, d_only = compare(QUERIES[name](spark, sf), duck(sf), ORACLE[name])
    assert same, (name, ns, nd, s_only, d_only)
