"""Every query of the core runs, and equals its SQL where it has one."""

import os

import pytest

from granary.plans import catalogue
from tests.oracle import DATA, actual, expected

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, name):
    assert actual(catalogue.QUERIES[name](spark, DATA)) == expected(catalogue.SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_lists_all():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
