"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def _names():
    from __spark_entry__ import queries
    return list(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    rep = compare(spark, SF, name, queries()[name], oracle_sql().get(name), con)
    assert rep.get("match", rep.get("oracle") == "none"), rep


def test_every_query_has_an_oracle():
    from __spark_entry__ import oracle_sql, queries
    from txnclean.plans.registry import ORACLES, QUERIES
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())
