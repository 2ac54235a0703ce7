"""Every registered query against its SQL in DuckDB."""

import re

import pytest
from compare import connect, difference
from conftest import TESTDATA

import __spark_entry__ as entry

SF_DIR = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    of_panels = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
    assert of_panels <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
