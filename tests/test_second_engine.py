"""Every registered query against its SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    names, got = spark_rows(entry.queries()[name](spark, SF))
    want_names, want = sql_rows(duck, entry.oracle_sql()[name])
    assert names == want_names
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 38
