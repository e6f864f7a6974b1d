"""Every registered query against its SQL counterpart at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, sql_connection

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return sql_connection(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    run = entry.queries()[name]
    if name in SQL:
        ok, note = compare(spark, con, name, run, SQL[name], SF)
        assert ok, note
    else:
        assert run(spark, SF).count() >= 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
