"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    n, problems = compare.differences(spark, db, FOLDER, name)
    assert not problems
    assert n > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n"] for r in rows) > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
