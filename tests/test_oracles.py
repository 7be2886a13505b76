"""Each query against its SQL on the smallest tables; queries without SQL must at least give rows."""

import pytest

from lodestrata import catalog
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_sql_names_are_queries():
    assert set(SQL) <= set(catalog.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    if name in SQL:
        assert difference(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0
