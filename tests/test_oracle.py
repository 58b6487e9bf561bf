"""Every registered query with an oracle equals its DuckDB SQL twin (sf0.001)."""

import pytest

from oracle import compare, duck
from conftest import SF_SMALL

from candela.plans import catalog

KEYS = sorted(catalog.ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, name):
    res = compare(catalog.QUERIES[name](spark, SF_SMALL), catalog.ORACLE[name], con)
    assert res["ok"], res
