"""Every registered query on the smallest tables, next to its SQL."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, views

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")

# Ten suppliers and 150 customers leave nothing above some report cut-offs.
MAY_BE_EMPTY = {"turnover_density"}


@pytest.fixture(scope="module")
def connection():
    return views(FOLDER)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    problem = compare(spark, connection, FOLDER, name)
    assert problem == "" or (problem == "no rows" and name in MAY_BE_EMPTY)


def test_entry(spark):
    assert entry.entry(spark).columns == ["year", "state", "turnover"]
