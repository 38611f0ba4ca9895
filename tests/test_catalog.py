"""Every named query against its SQL."""

import os

import pytest
from compare import differences, oracle

from placeweave import catalog

SF_DIR = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    found = differences(catalog.QUERIES[name](spark, SF_DIR), con, catalog.ORACLES[name])
    assert not found, found
