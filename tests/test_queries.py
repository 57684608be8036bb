"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check
from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    ok, message = check.compare(spark, con, name, SMALL)
    assert ok, message


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert {"risk_score", "risk_label", "reasons"} <= set(df.columns)
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
