"""Every registered query gives the rows and types of its SQL."""

import pytest

import __spark_entry__ as registry
from sessionloom.plans.oracles import oracles
from sessionloom.plans.queries import QUERIES
from tests.compare import connect, difference


@pytest.fixture(scope="session")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracles())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    assert difference(spark, con, folder, name) is None


def test_entry(spark):
    assert registry.entry(spark).count() > 0
