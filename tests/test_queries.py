"""Every registered query against its SQL twin on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from caseflow.plans import catalog

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries()) and set(catalog.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    result = oracle.compare(spark, con, catalog.queries()[name], catalog.oracle_sql().get(name), SF_DIR)
    assert result["ok"], result["note"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
