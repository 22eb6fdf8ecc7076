"""Every query of the catalog against its SQL, on the smallest tables."""

import pytest
from oracle import connection, rows_of, sql_rows

from lotwise import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert rows_of(catalog.queries()[name](spark, SMALL)) == sql_rows(con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    rows = catalog.queries()[name](spark, SMALL).collect()
    assert rows and len(rows) == len({repr(r) for r in rows})  # no query without SQL repeats a row


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
