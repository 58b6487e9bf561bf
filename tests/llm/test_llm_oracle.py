"""Every operator query with SQL equals it (sf0.01)."""

import pytest

from candela.llm import registry
from conftest import SF_ORACLE
from oracle import compare, duck


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, name):
    res = compare(registry.QUERIES[name](spark, SF_ORACLE), registry.ORACLE[name], duck(SF_ORACLE))
    assert res["ok"], res
