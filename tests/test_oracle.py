"""Every registered query against its SQL twin on the smallest driver tables."""

import pytest
from conftest import TESTDATA
from oracle import compare, connect

from lodgeframe.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(TESTDATA)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, TESTDATA), duck, ORACLES[name]) is None
