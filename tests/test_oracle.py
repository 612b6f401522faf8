"""Every registered query against its SQL."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry.base import QUERIES
from tests.compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, duck, name):
    assert name in oracle_sql()
    assert difference(queries()[name](spark, SF_DIR), duck, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0
