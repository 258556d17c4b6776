import pytest
from oracle import compare, duck

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    assert compare(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name]) == ""
