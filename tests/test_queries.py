"""Every registered query against its SQL counterpart on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import connect, difference

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, SQL[name]) is None


def test_every_query_has_sql():
    """But for those of the text operators that SQL cannot express; they have tests of their own."""
    assert set(entry.QUERIES) == set(entry.ORACLES) and set(entry.ORACLES) <= set(SQL) <= set(entry.queries())


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns == ["topic", "reason", "records"] and result.count() > 3
