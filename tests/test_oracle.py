"""Every registered query gives what its SQL says, on the smallest supplied tables."""

import pytest
from compare import connect, difference
from conftest import SF_SMALL

import __spark_entry__ as entry
from newsloom.checks.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF_SMALL), duck, entry.oracle_sql()[name]) is None
