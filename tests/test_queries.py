"""Every registered query against its SQL, on the smallest tables."""

import pytest

import oracle
from assayer.plans.bindings import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    agrees, message = oracle.compare(spark, con, name, SF_DIR)
    assert agrees, message


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(oracle.driver.queries()) and set(ORACLE) <= set(oracle.driver.oracle_sql())
