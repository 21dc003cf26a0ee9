"""Every registered query runs on the smallest driver tables with a stable
schema, and the flagship returns rows."""

import pytest

import __spark_entry__ as entry
from cashweave.plans.queries import ORACLES, QUERIES
from conftest import SF_SMALL

def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "summary" in df.columns


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_rows(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    assert len(set(c.lower() for c in df.columns)) == len(df.columns)
    assert df.count() > 0
